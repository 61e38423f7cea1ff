"""Range lookups by dyadic blocks, the base of every proximity operator.

A range join written as "same chromosome and |a - b| <= d" makes Spark compare
all pairs of a chromosome, and even a binned version emits every pair of a hot
bin.  Here each range is instead cut into at most two aligned blocks per power
of two, and the searched table is summarised once per block.  The join is then
an equality join on (key, level, block): its size depends on the number of
ranges and on the logarithm of their width, not on how many rows fall in them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.operators.ordering import top_per_group


def levels_for(width: int) -> int:
    """How many block sizes a range of at most ``width`` positions can need."""
    return max(1, width.bit_length())


def block_start() -> Column:
    """First position of a block."""
    return F.call_function("shiftleft", F.col("block"), F.col("level"))


def cut_into_blocks(ranges: DataFrame, levels: int) -> DataFrame:
    """Replace the closed range [low, high] of each row by the blocks that tile it.

    At level l the aligned part of the range is [ceil(low/2^l), (high+1)/2^l);
    an odd end of it cannot be merged further up and becomes a block.  Positions
    may be any bigint; an empty range (low > high) has no blocks.
    """
    level = F.col("level")

    def shifted(c: Column) -> Column:
        return F.call_function("shiftright", c, level)

    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
    rest = [c for c in ranges.columns if c not in ("low", "high")]
    per_level = ranges.select(
        *rest, "low", "high", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
    )
    ends = per_level.select(
        *rest, "level", shifted(F.col("low") + size - 1).alias("first"), shifted(F.col("high") + 1).alias("stop")
    ).filter(F.col("first") < F.col("stop"))

    def if_odd(end: str, block: Column) -> Column:
        return F.when(F.col(end).bitwiseAND(F.lit(1)) == 1, block)

    found = F.array_compact(F.array(if_odd("first", F.col("first")), if_odd("stop", F.col("stop") - 1)))
    return ends.select(*rest, "level", F.explode(found).alias("block"))


def with_blocks(df: DataFrame, pos: Column, levels: int) -> DataFrame:
    """Each row once per level, with the block that holds its position."""
    per_level = F.array(*[F.shiftright(pos, level) for level in range(levels)])
    return df.select("*", F.posexplode(per_level).alias("level", "block"))


def block_stats(positions: DataFrame, key: Sequence[str], levels: int) -> DataFrame:
    """Count, sum of offsets, first and last position per block.

    ``positions`` has ``pos`` and ``n``, one row per distinct position.
    """
    base = block_start()
    rows = with_blocks(positions, F.col("pos"), levels)
    return rows.groupBy(*key, "level", "block").agg(
        F.sum("n").alias("b_n"),
        F.sum(F.col("n") * (F.col("pos") - base)).alias("b_offsets"),
        F.min("pos").alias("b_first"),
        F.max("pos").alias("b_last"),
    )


def block_top(rows: DataFrame, key: Sequence[str], levels: int, k: int, order: Sequence[Column]) -> DataFrame:
    """The k first rows of every block in ``order``.

    Rows should hold at most k per position already, since no block can use
    more of them; that keeps a hot position from being spread over all levels.
    """
    spread = with_blocks(rows, F.col("pos"), levels)
    return top_per_group(spread, [*key, "level", "block"], k, order)
