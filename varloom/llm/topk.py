"""Exact top-k by inner product: a KD-tree per shard, best-first search.

Median splits of a bounded sample send vectors to regions of space; a region is dealt
out at random to as many shards as its rows need, so equal vectors do not make a shard
larger.  A shard's tree is built once, by median splits along the widest side, and kept
as one row per node with its tight bounding box.  A query walks the nodes in the order
of the largest inner product that their box allows, until no box can beat its k-th score.

The boxes of the roots choose the shards too: first each query goes to the one shard
whose box allows most; its k-th score there goes along to all others whose box allows as
much, and to no more.  Queries travel to trees; a tree is copied only where more than
``BLOCK_ROWS`` queries ask for it, once for each so many.  The best of all shards are
merged by rank.

Bounds: the sample has at most ``SAMPLE_ROWS`` rows; shards hold ``SHARD_ROWS`` rows, or
more where there would be over ``MOST_SHARDS`` of them, so the table of root boxes (two
vectors a shard), which goes to every task, does not grow beyond that many.

Components become floor(256 x) and scores are exact integers.  Rows with a null id,
a null vector, or a null or non-finite component take no part; nor do candidates of
the query's own id.  Only vectors of equal length meet.  Repeated query rows count
once; repeated candidate rows each count.  Ties go to the smaller id.  An empty
vector scores 0.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varloom.llm.common import saved, stored

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 8192, 256
SAMPLE_ROWS, SAMPLED_PER_REGION, MOST_SHARDS = 20_000, 16, 16_384

#: Rows that a task sends out at a time.
_SENT_ROWS = 16_384


def whole_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): the rows that take part, components as integers."""
    x = F.col(embedding)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * 256).cast("bigint"))
    return table.filter(F.col(vec_id).isNotNull() & x.isNotNull() & fine).select(F.col(vec_id).alias("vec_id"), whole.alias("v"))


def _most(a: np.ndarray, b: np.ndarray) -> int:
    """A bound of all sums in a product of rows of ``a`` with rows of ``b``."""
    return int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] if a.size and b.size else 0


def _doubles_hold(a: np.ndarray, b: np.ndarray) -> bool:
    return _most(a, b) < 1 << 53


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer matrix product; by way of doubles where these hold every sum.

    Doubles as input stand for integers that were found to be so small.
    """
    if a.dtype.kind == "i" and b.dtype.kind == "i":
        most = _most(a, b.T)
        if most >= 1 << 62:
            return (a.astype(object) @ b.astype(object)).astype(np.int64)
        if most >= 1 << 53:
            return a @ b
    return (a.astype(np.float64, copy=False) @ b.astype(np.float64, copy=False)).astype(np.int64)


class Tree:
    """KD-tree of integer vectors; nodes in arrays, children after their parent."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(vectors))
        low, high, self.span, self.children = [], [], [], []
        stack = [(0, len(vectors), -1)]
        while stack:
            a, b, parent = stack.pop()
            rows = vectors[self.order[a:b]]
            lo, hi = rows.min(axis=0), rows.max(axis=0)
            node = len(low)
            low.append(lo)
            high.append(hi)
            self.span.append((a, b))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if b - a > leaf and (hi > lo).any():
                side = int(np.argmax(hi - lo))
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, side], half)]
                stack += [(a, a + half, node), (a + half, b, node)]
        self.low, self.high = np.array(low), np.array(high)
        self.vectors = vectors[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each node's box allows (queries x nodes)."""
        return product(np.maximum(queries, 0), self.high.T) + product(np.minimum(queries, 0), self.low.T)


def search(
    tree: Tree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best of each query that reach its floor, ties to smaller ids.

    ``ids`` are in the order of ``tree.vectors``.
    """
    out_row, out_id, out_score = [], [], []
    vectors = tree.vectors
    if _doubles_hold(vectors, queries):  # every node's product is then exact too
        vectors, queries = vectors.astype(np.float64), queries.astype(np.float64)
    for row, bounds in enumerate(tree.bounds(queries).tolist()):
        query, own, least = queries[row], query_ids[row], int(floors[row])
        heap = [(-bounds[0], 0)]
        best_score, best_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while heap and -heap[0][0] >= least:
            node = heapq.heappop(heap)[1]
            if tree.children[node]:
                for child in tree.children[node]:
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            a, b = tree.span[node]
            scores = product(vectors[a:b], query[:, None])[:, 0]
            good = (scores >= least) & (ids[a:b] != own)
            if good.any():
                best_score = np.concatenate([best_score, scores[good]])
                best_id = np.concatenate([best_id, ids[a:b][good]])
                if len(best_score) >= k:
                    first = np.lexsort((best_id, -best_score))[:k]
                    best_score, best_id = best_score[first], best_id[first]
                    least = max(least, int(best_score[-1]))
        out_row.append(np.full(len(best_id), row))
        out_id.append(best_id)
        out_score.append(best_score)
    return np.concatenate(out_row), np.concatenate(out_id), np.concatenate(out_score)


def _matrix(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), length)


# regions of space


def splits(sample: np.ndarray, regions: int) -> list[tuple[int, int, int, int]]:
    """Median splits of the sample: (side, border, left, right), or (-1, number of the region, 0, 0).

    Vectors below the border on that side go left.  Equal vectors are not split, so there
    may be fewer regions.
    """
    out: list = [None]
    stack, found = [(0, sample, regions)], 0
    while stack:
        node, rows, wanted = stack.pop()
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        if wanted < 2 or not (hi > lo).any():
            out[node] = (-1, found, 0, 0)
            found += 1
            continue
        side = int(np.argmax(hi - lo))
        values = np.sort(rows[:, side])
        border = int(values[len(values) // 2])
        if border == values[0]:
            border = int(values[np.searchsorted(values, border, side="right")])
        left = rows[:, side] < border
        out[node] = (side, border, len(out), len(out) + 1)
        stack += [(len(out), rows[left], wanted // 2), (len(out) + 1, rows[~left], wanted - wanted // 2)]
        out += [None, None]
    return out


def region_of(nodes: list[tuple[int, int, int, int]], vectors: np.ndarray) -> np.ndarray:
    out = np.zeros(len(vectors), np.int32)
    stack = [(0, np.arange(len(vectors)))]
    while stack:
        node, at = stack.pop()
        side, border, left, right = nodes[node]
        if side < 0:
            out[at] = border
        elif len(at):
            below = vectors[at, side] < border
            stack += [(left, at[below]), (right, at[~below])]
    return out


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = batch.column("length").to_numpy()
    for length in np.unique(lengths):
        yield int(length), batch.filter(pa.array(lengths == length))


def placed(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """``rows`` (vec_id, v, length, asks) with the region of each vector and a random number."""
    taken = sample.toArrow()
    lengths = taken["length"].to_numpy()
    regions = {}
    for length in np.unique(lengths):
        matrix = _matrix(taken["v"].filter(pa.array(lengths == length)), int(length))
        regions[int(length)] = splits(matrix, len(matrix) // SAMPLED_PER_REGION)
    shared = rows.sparkSession.sparkContext.broadcast(regions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            for length, part in _by_length(batch):
                nodes = shared.value.get(length, [(-1, 0, 0, 0)])
                region = region_of(nodes, _matrix(part.column("v"), length))
                part = part.append_column("region", pa.array(region, pa.int32()))
                yield part.append_column("lot", pa.array(rng.integers(0, 1 << 31, part.num_rows), pa.int64()))

    return rows.mapInArrow(run, "vec_id bigint, v array<bigint>, length int, asks boolean, region int, lot bigint")


# trees

SHARD = ["length", "region", "piece"]
_NODES = (
    "length int, region int, piece int, node int, children array<int>, low array<bigint>, high array<bigint>, "
    "ids array<bigint>, vectors array<bigint>"
)


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    length = key[0].as_py()
    tree = Tree(_matrix(rows["v"], length))
    ids = rows["vec_id"].to_numpy()[tree.order]
    n = len(tree.span)
    held = [(a, b) if not children else (a, a) for (a, b), children in zip(tree.span, tree.children, strict=True)]
    columns = [
        *[pa.array([x.as_py()] * n, pa.int32()) for x in key], pa.array(range(n), pa.int32()),
        pa.array(tree.children, pa.list_(pa.int32())),
        pa.array(list(tree.low), pa.list_(pa.int64())), pa.array(list(tree.high), pa.list_(pa.int64())),
        pa.array([ids[a:b] for a, b in held], pa.list_(pa.int64())),
        pa.array([tree.vectors[a:b].reshape(-1) for a, b in held], pa.list_(pa.int64())),
    ]
    return pa.table(columns, names=[c.split(" ")[0] for c in _NODES.split(", ")])


def trees(rows: DataFrame, shard_rows: int) -> DataFrame:
    """The KD-trees of all shards, a row per node; only leaves hold ids and vectors."""
    sizes = rows.groupBy("length", "region").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).alias("pieces"))
    dealt = rows.join(sizes, ["length", "region"]).withColumn("piece", F.pmod("lot", "pieces").cast("int"))
    return stored(dealt.select(*SHARD, "vec_id", "v").groupBy(*SHARD).applyInArrow(_build, _NODES), "kd-trees")


def _loaded(nodes: pa.Table, length: int) -> tuple[Tree, np.ndarray]:
    """The tree of stored nodes, and its ids."""
    nodes = nodes.sort_by("node")
    tree = Tree.__new__(Tree)
    tree.low, tree.high = _matrix(nodes["low"], length), _matrix(nodes["high"], length)
    tree.children = nodes["children"].to_pylist()
    sizes = nodes["ids"].combine_chunks().value_lengths().to_numpy()
    ends = np.cumsum(sizes)
    tree.span = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
    ids = nodes["ids"].combine_chunks().flatten().to_numpy()
    flat = nodes["vectors"].combine_chunks().flatten().to_numpy()
    tree.vectors = flat.reshape(len(ids), length)
    return tree, ids


# search

_ASKED = "length int, region int, piece int, vec_id bigint, v array<bigint>, floor bigint"
LEAST = -(1 << 63)


def reached(queries: DataFrame, boxes: pa.Table) -> DataFrame:
    """The shards where each of ``queries`` (length, vec_id, v, kth) goes.

    Without a k-th score that is the shard whose box allows most, the first in order;
    with one, all but that shard whose boxes allow as much.
    """
    tables = {}
    lengths = boxes["length"].to_numpy()
    for length in np.unique(lengths):
        part = boxes.filter(pa.array(lengths == length)).sort_by([("region", "ascending"), ("piece", "ascending")])
        sides = [_matrix(part[c], int(length)) for c in ("low", "high")]
        tables[int(length)] = (*sides, part["region"].to_numpy(), part["piece"].to_numpy())
    shared = queries.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, whole in _by_length(batch):
                low, high, region, piece = shared.value[length]
                step = max(1, _SENT_ROWS // len(region))
                for start in range(0, whole.num_rows, step):
                    part = whole.slice(start, step)
                    vectors = _matrix(part.column("v"), length)
                    allowed = product(np.maximum(vectors, 0), high.T) + product(np.minimum(vectors, 0), low.T)
                    best = allowed.argmax(axis=1)
                    kth = part.column("kth")
                    floors = kth.fill_null(LEAST).to_numpy()
                    if part.column("first")[0].as_py():
                        query, shard = np.arange(part.num_rows), best
                    else:
                        open_ = allowed >= floors[:, None]
                        open_[np.arange(part.num_rows), best] = False
                        query, shard = np.nonzero(open_)
                    at = pa.array(query)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(query), length), pa.int32()), pa.array(region[shard], pa.int32()),
                        pa.array(piece[shard], pa.int32()), part.column("vec_id").take(at), part.column("v").take(at),
                        pa.array(floors[query], pa.int64()),
                    ], names=[c.split(" ")[0] for c in _ASKED.split(", ")])

    return queries.mapInArrow(run, _ASKED)


def _task(k: int):
    names = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(key: tuple, nodes: pa.Table, queries: pa.Table) -> pa.Table:
        if not nodes.num_rows or not queries.num_rows:
            return names.empty_table()
        length = key[0].as_py()
        tree, ids = _loaded(nodes, length)
        query_ids = queries["vec_id"].to_numpy()
        row, found, scores = search(tree, ids, _matrix(queries["v"], length), query_ids, queries["floor"].to_numpy(), k)
        return pa.table([pa.array(query_ids[row]), pa.array(found), pa.array(scores)], schema=names)

    return run


def met(nodes: DataFrame, asked: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(query_id, vec_id, score): what the queries find in the shards that they ask, up to k in each."""
    blocks = asked.groupBy(*SHARD).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("blocks"))
    # both sides of a cogroup come from the same rows, hence new names
    apart = asked.join(blocks, SHARD).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int"))
    apart = apart.select(*[F.col(c).alias(c) for c in [*SHARD, "block", "vec_id", "v", "floor"]])
    every = F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)
    copies = nodes.join(blocks, SHARD).withColumn("block", F.explode(every))
    copies = copies.select(*SHARD, "block", "node", "children", "low", "high", "ids", "vectors")
    keys = [*SHARD, "block"]
    shape = "query_id bigint, vec_id bigint, score bigint"
    return copies.groupBy(*keys).cogroup(apart.groupBy(*keys)).applyInArrow(_task(k), shape)


def top_k(
    vectors: DataFrame, is_query: Column, k: int, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` (vec_id, v) for those that are queries."""
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), "v", F.size("v").alias("length"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    n = rows.count()
    shard_rows = max(shard_rows, -(-n // MOST_SHARDS))
    wanted = min(SAMPLE_ROWS, SAMPLED_PER_REGION * -(-n // shard_rows))
    rows = saved(placed(rows, rows.select("length", "v").orderBy(F.rand(7)).limit(wanted)))
    queries = rows.filter("asks").select("length", "vec_id", "v").distinct()
    nodes = trees(rows, shard_rows)
    boxes = nodes.filter("node = 0").select(*SHARD, "low", "high").toArrow()
    unknown = F.lit(None).cast("bigint").alias("kth")
    first = stored(reached(queries.select("*", unknown, F.lit(True).alias("first")), boxes), "kd-queries")
    home = saved(met(nodes, first, k, block_rows))
    if boxes.num_rows > 1:
        # a query that found k there brings its k-th score along
        kths = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
        told = queries.join(kths, F.col("vec_id") == F.col("query_id"), "left").select("length", "vec_id", "v", "kth")
        others = stored(reached(told.withColumn("first", F.lit(False)), boxes), "kd-queries")
        home = home.unionByName(met(nodes, others, k, block_rows))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return home.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
