"""Shared pieces of the corpus operators: durable tables, Arrow helpers, tokens."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the contracts: runs of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that go to Python at once, and Spark's setting for it.
BATCH, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, from ``spark.checkpoint.dir``.

    Where the session names none (tests on one machine) a temporary folder is
    set; on a cluster that would lose data, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="varloom-checkpoint-")
    sc.setCheckpointDir(root)
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read from there.

    Cuts the lineage: a lost executor costs a re-read.  The folder belongs to the
    cluster, which clears it; ``scratch`` has tables that go earlier.  ``by`` names
    folder columns.
    """
    return written(df, name, *by)[0]


def written(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    """What ``stored`` gives, and the folder, for ``drop_tables``."""
    spark = df.sparkSession
    path = f"{durable_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with _shuffles_dropped(spark):
        (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of written tables."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a function like ``stored`` whose tables are deleted at the end.

    What leaves the block must not read them any more.
    """
    paths: list[str] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        found, path = written(df, name)
        paths.append(path)
        return found

    try:
        yield put
    finally:
        drop_tables(spark, paths)


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
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


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of at most ``BATCH`` bytes, or one row.

    Spark's own bound is 64 MB, which each task holds in the JVM, outside its heap, and again in Python.
    A smaller bound of the session stays.
    """
    bound = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING))
    if not 0 < bound <= BATCH:
        spark.conf.set(BATCH_SETTING, str(BATCH))


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for tables that are small beside the corpus."""
    durable_dir(df.sparkSession)
    return df.checkpoint()


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Text column as one array, null as empty.

    The copy begins at its own first byte: the string kernels misread arrays that
    were cast while they were a slice of a longer one.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pa.concat_arrays([pc.fill_null(column.cast(pa.large_string()), "")])


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut at row borders into pieces of about ``most_bytes`` of text.

    A longer single text is a piece of its own; nothing is cut inside a row.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words of all texts in one flat array, and the number per text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    filled = pc.not_equal(pc.binary_length(flat), 0)
    owner = pc.list_parent_indices(lists).filter(filled)
    counts = np.bincount(owner.to_numpy(), minlength=len(texts))
    return flat.filter(filled), counts.astype(np.int64)


def held_out(doc_id: str, modulus: int, remainder: int):
    """True where crc32 of the id as text leaves ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder
