"""Files out: delimited text, one folder per result."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators.ordering import shared_folder, shuffles_dropped
from varloom.roles import col


def write_delimited(
    df: DataFrame, path: str, sep: str = "\t", header: bool = True, mode: str = "errorifexists", compression: str = "none"
) -> None:
    """One file per task; null and the empty text both come out empty.  Shuffle files go when all is written.

    Packed files are packed at the codec's fastest level.
    """
    writer = df.write.mode(mode).option("sep", sep).option("header", header).option("emptyValue", "")
    writer = writer.option("zlib.compress.level", "BEST_SPEED")
    with shuffles_dropped(df.sparkSession):
        writer.option("compression", compression).csv(path)


def write_sorted(df: DataFrame, path: str, by: Sequence[str], sep: str = "\t") -> None:
    """As above, in global order over the files."""
    write_delimited(df.orderBy(*[col(b).asc() for b in by]), path, sep)


def fresh_path(df: DataFrame, name: str) -> str:
    """A new folder in the shared folder of the session."""
    return f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"


def written_and_read(df: DataFrame, sep: str = "\t", sort_by: Sequence[str] = ()) -> DataFrame:
    """Round trip through delimited files, as the next job would see the data."""
    path = fresh_path(df, "export")
    if sort_by:
        write_sorted(df, path, sort_by, sep)
    else:
        write_delimited(df, path, sep)
    back = df.sparkSession.read.schema(df.schema).option("sep", sep).option("header", True).csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) if t == "string" else c for c, t in df.dtypes])
