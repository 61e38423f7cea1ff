"""Sorting, paging, top-k, distributed row numbers."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varloom.operators.filters import BadRequest
from varloom.roles import col, require_columns

# Subgroups a group is ranked in first where the planner's own cut is off.
SALTS = 32

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediate data.

    The cluster names it in ``spark.checkpoint.dir``, or the session has set a
    checkpoint folder.  Without either a temporary one is made on a single
    machine; on a cluster that is an error, as executors would not share it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise BadRequest("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="varloom-")
        atexit.register(shutil.rmtree, _own_folders[app], ignore_errors=True)
    return _own_folders[app]


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the query inside ends, as only its written result is used again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there, for what is read several times."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _directed(name: str | Column, descending: bool) -> Column:
    c = col(name) if isinstance(name, str) else name
    return c.desc() if descending else c.asc()


def sort(df: DataFrame, by: str, key: Sequence[str], descending: bool = False) -> DataFrame:
    """Sort by one column; the key makes the order total."""
    require_columns(df, [by, *key])
    return df.orderBy(_directed(by, descending), *[col(k).asc() for k in key])


#: Pages that end within so many rows are cut from a top-k; deeper ones are looked up by counting.
EARLY_ROWS = 10_000
#: Rows that propose range borders in one look-up round, and ranges they are cut into.
PROPOSED_ROWS, RANGES = 2048, 64


def page(
    df: DataFrame,
    number: int,
    size: int,
    by: str | None,
    key: Sequence[str],
    descending: bool = False,
    max_size: int = 1000,
    early: int = EARLY_ROWS,
) -> DataFrame:
    """Page ``number`` (from 1), in order.  Paging needs a total order, hence the key, which must be unique.

    A page that ends within ``early`` rows is a top-k, of which each task sends no more
    than these.  For a deeper one the ordered rows are counted by range until the ranges
    that hold the page are known (:func:`_window_of_rows`), and only their rows are
    sorted.  Nothing is sorted or written as a whole, and both ways have the same order.
    """
    if number < 1 or not 1 <= size <= max_size:
        raise BadRequest(f"page must be >= 1 and page size in 1..{max_size}")
    names = list(dict.fromkeys([*([by] if by else []), *key]))
    require_columns(df, names)
    parts = [(n, n == by and descending) for n in names]
    order = [_directed(n, down) for n, down in parts]
    skip = (number - 1) * size
    if skip + size > early:
        df, skip = _window_of_rows(df, parts, skip, size, early)
    return df.orderBy(*order).offset(skip).limit(size)


def _before(parts: Sequence[tuple[str, bool]], border: Sequence[str | None], kinds: dict[str, str]) -> Column:
    """Whether a row stands before the border, a tuple of values as text, in the order of ``parts``.

    Null is smallest, as in the sort: first where it ascends, last where it descends.
    """
    found = F.lit(False)
    for (name, down), value in reversed(list(zip(parts, border, strict=True))):
        c, v = col(name), F.lit(value).cast(kinds[name])
        if value is None:
            less, same = (c.isNotNull() if down else F.lit(False)), c.isNull()
        else:
            less, same = ((c > v) if down else (c < v)), c.eqNullSafe(v)
            less = F.coalesce(less, F.lit(not down))
        found = less | (same & found)
    return found


def _place(borders: Sequence[Sequence[str | None]], before: Callable[[Sequence[str | None]], Column], first: int = 0) -> Column:
    """Number of the range a row is in, by a binary search over ascending borders."""
    if not borders:
        return F.lit(first)
    middle = len(borders) // 2
    left = _place(borders[:middle], before, first)
    return F.when(before(borders[middle]), left).otherwise(_place(borders[middle + 1 :], before, first + middle + 1))


def _window_of_rows(
    df: DataFrame, parts: Sequence[tuple[str, bool]], skip: int, size: int, early: int
) -> tuple[DataFrame, int]:
    """The rows among which rows skip .. skip + size - 1 of the order are, and where they begin there.

    Each round takes as borders an even cut of ``PROPOSED_ROWS`` rows that a hash picks (a
    top-k, so every task sends at most these), counts the rows of each range and goes on
    inside the ranges that hold the page, until these have at most ``early`` rows.  A round
    is two scans of the order columns and divides the rows by about ``RANGES``.
    """
    kinds = {n: df.select(col(n)).dtypes[0][1] for n, _ in parts}
    order = [_directed(n, down) for n, down in parts]
    left = None
    while True:
        keys = df.select(*[col(n) for n, _ in parts])
        picked = keys.orderBy(F.xxhash64(*[col(n) for n, _ in parts]), *order).limit(PROPOSED_ROWS)
        told = picked.orderBy(*order).select(*[col(n).cast("string") for n, _ in parts]).collect()
        step = max(1, len(told) // RANGES)
        borders = list(dict.fromkeys(tuple(r) for r in told[step::step]))
        if not borders:
            return df, skip

        def before(b: Sequence[str | None]) -> Column:
            return _before(parts, b, kinds)

        counts = dict.fromkeys(range(len(borders) + 1), 0)
        for r in keys.groupBy(_place(borders, before).alias("_range")).count().collect():
            counts[r["_range"]] = r["count"]
        total = sum(counts.values())
        first, passed = 0, 0
        while first < len(borders) and passed + counts[first] <= skip:
            passed, first = passed + counts[first], first + 1
        last, held = first, counts[first]
        while last < len(borders) and passed + held < skip + size:
            last, held = last + 1, held + counts[last + 1]
        if first > 0:
            df = df.filter(~before(borders[first - 1]))
        if last < len(borders):
            df = df.filter(before(borders[last]))
        skip -= passed
        if held <= early or held == total or held == left:
            return df, skip
        left = held


def with_row_index(df: DataFrame, order: Sequence[Column], name: str = "row_index") -> DataFrame:
    """Number rows 0, 1, ... in a total order without a single-task window.

    Rows are range-partitioned and sorted, the result is checkpointed so that
    partitions stay as they are, and each partition is shifted by the number of
    rows before it.  The offset table has one row per partition.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(placed.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    in_part = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(name, (F.col("_offset") + in_part).cast("bigint"))
        .drop("_id", "_part", "_offset")
    )


def top(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """The first k rows; planned as a per-partition top-k."""
    if k < 1:
        raise BadRequest("limit must be at least 1")
    return df.orderBy(*order).limit(k)


def top_per_group(
    df: DataFrame, group: Sequence[str], k: int, order: Sequence[Column], rank: str | None = None
) -> DataFrame:
    """The first k rows of each group.

    A row_number with an upper bound is cut per partition before the shuffle,
    so a hot group sends at most k rows per task.  Spark does so up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``; for a larger k each group is
    cut to k rows within subgroups first, which are ranked in tasks of their own.
    """
    name = rank or "_rank"
    if k > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        salt = F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(SALTS))
        within = Window.partitionBy(*[col(g) for g in group], "_salt").orderBy(*order)
        df = df.withColumn("_salt", salt).withColumn("_cut", F.row_number().over(within))
        df = df.filter(F.col("_cut") <= k).drop("_cut", "_salt")
    window = Window.partitionBy(*[col(g) for g in group]).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def by_list_position(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """Rows in the order of a caller's list; others are left out."""
    position = F.array_position(F.array(*[F.lit(v) for v in order]), col(name))
    return df.filter(col(name).isin(list(order))).orderBy(position)


def sort_nulls_as_zero(
    df: DataFrame, by: str, key: Sequence[str], descending: bool = False, limit: int | None = None
) -> DataFrame:
    """Sort small results by any output column, null counting as 0."""
    require_columns(df, [by, *key])
    c = col(by)
    if dict(df.dtypes)[by] != "string":
        c = F.coalesce(c, F.lit(0))
    out = df.orderBy(_directed(c, descending), *[col(k).asc() for k in key])
    return out if limit is None else out.limit(limit)
