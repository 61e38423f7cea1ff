"""Repair of the turn structure of conversations at least cost, by Four-Russians block tables.

A conversation's rows stand in the order of turn (null first), role, hash of the text.
A row that is blank, or repeats an earlier row's role and text, has to go; a row whose
text does not end in ``.``, ``!`` or ``?`` is truncated.  Edits keep a row (cost 0), give
it the role user or assistant (3), delete it (4) or insert an empty user or assistant
row (3); a truncated row that stays costs 3 more.  The cheapest edits are wanted that
leave an optional system turn and then user and assistant in turn, ending with the
assistant, or nothing at all; among equally cheap ones those whose letters (D, I, K, R)
come first in ASCII.

Method: what a row means to the repair is one of ten symbols, and the state of a repair
is the cheapest cost of having reached each of four points of the pattern.  Differences
between these costs are bounded, so there are few normalised cost vectors, and for each
of them and each block of ``BLOCK`` symbols a table holds the vector after the block and
what it adds to the cost.  Conversations are run through block by block, by lookup, all
conversations of a batch at once.  The trace expands the blocks from the last to the
first, marks every point that lies on some cheapest repair, and then reads the least
letters off the marks from the front, so no tie is decided before all are known.

Shuffles: once the rows without their texts (symbol, turn and a hash of the text), once
the texts, each to the task of its conversation.  Tasks read sorted rows as a stream: of
a conversation they hold a byte for each row, never its texts, so a conversation of any
length is safe; its digest is one hash over all of its text and has to be one stream.

Null ids form one conversation.  A null role or text counts as one space, and so does a
null id or turn where it is hashed.  A role with another initial than s, u or a (an empty
one too) can only be changed or deleted.  Equal rows are repeats.  Extra columns are
ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

#: Rows a table looks up at once.
BLOCK = 4
KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Points of the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: What a changed or inserted row leads to from each point.
NEXT = (USER, USER, ASSISTANT, USER)
#: Symbols: initial (s, u, a, other) + 4 if truncated; a row that has to go; no row, which fills up the last block.
GONE, NONE, SYMBOLS = 8, 9, 10
FAR = 1 << 20
SPACES = " \t\n\v\f\r"


def _kept(initial: int, point: int) -> int | None:
    """The point after a kept row, if its initial may stand there."""
    if initial == 0:
        return SYSTEM if point == EMPTY else None
    if initial == 1:
        return USER if point != USER else None
    return ASSISTANT if initial == 2 and point == USER else None


def _edits(symbol: int, point: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next point) of what may happen to a row, in the order of the letters."""
    if symbol == NONE:
        return [("", 0, point)]
    found = [("D", DELETE, point)]
    if symbol != GONE:
        extra = TRUNCATED if symbol >= 4 else 0
        after = _kept(symbol % 4, point)
        if after is not None:
            found.append(("K", KEEP + extra, after))
        found.append(("R", RENAME + extra, NEXT[point]))
    return found


def _with_inserts(costs: list[int]) -> list[int]:
    costs = list(costs)
    for _ in range(2):  # more than two in a row never pay
        for point in range(4):
            costs[NEXT[point]] = min(costs[NEXT[point]], costs[point] + INSERT, FAR)
    return costs


def _normalised(costs: list[int]) -> tuple[tuple[int, ...], int]:
    """Costs above the least one, and that; points that can no longer be part of a cheapest repair are FAR.

    After an assistant turn whatever follows EMPTY can follow too, for at most a deleted
    system row more, and whatever follows SYSTEM can follow as it is; a user turn needs
    one more insert for that.
    """
    costs = list(costs)
    for point, more in ((EMPTY, DELETE), (SYSTEM, 0)):
        if costs[point] > min(costs[ASSISTANT] + more, costs[USER] + INSERT + more):
            costs[point] = FAR
    least = min(costs)
    return tuple(FAR if c >= FAR else c - least for c in costs), least


@dataclass(frozen=True)
class Tables:
    """All transitions.  Vectors are numbered; the first is that of the start."""

    vectors: np.ndarray  # (vectors, 4)
    block_next: np.ndarray  # (vectors, SYMBOLS ** BLOCK): vector after a block
    block_cost: np.ndarray  # what the block adds
    step_next: np.ndarray  # (vectors, SYMBOLS)
    marks: np.ndarray  # (vectors, SYMBOLS, 16): points on a cheapest repair before a row, by those after it
    letters: np.ndarray  # (vectors, SYMBOLS, 16, 4): inserts before the row * 4 + the row's edit (0 none, 1 D, 2 K, 3 R)
    point_next: np.ndarray  # (vectors, SYMBOLS, 16, 4): point after it
    end_marks: np.ndarray  # (vectors,)
    end_cost: np.ndarray
    end_inserts: np.ndarray  # (vectors, 4)


def _marks_with_inserts(vector: tuple[int, ...], marked: int) -> int:
    for _ in range(2):
        for p in range(4):
            if marked >> NEXT[p] & 1 and vector[p] + INSERT == vector[NEXT[p]] and vector[p] < FAR:
                marked |= 1 << p
    return marked


@lru_cache(maxsize=1)
def tables() -> Tables:
    start, _ = _normalised(_with_inserts([0, FAR, FAR, FAR]))
    known, rows = {start: 0}, [start]
    step = []  # per vector and symbol: next vector, cost
    at = 0
    while at < len(rows):
        found = []
        for symbol in range(SYMBOLS):
            after = [FAR] * 4
            for p in range(4):
                for _, cost, q in _edits(symbol, p):
                    after[q] = min(after[q], rows[at][p] + cost)  # FAR stays FAR
            after, least = _normalised(_with_inserts(after))
            if after not in known:
                known[after] = len(rows)
                rows.append(after)
            found.append((known[after], least))
        step.append(found)
        at += 1
    n = len(rows)
    step = np.array(step, dtype=np.int16)
    step_next, step_cost = step[:, :, 0], step[:, :, 1]
    block_next, block_cost = np.arange(n, dtype=np.int16)[:, None], np.zeros((n, 1), dtype=np.int16)
    for _ in range(BLOCK):
        block_cost = (block_cost[:, :, None] + step_cost[block_next]).reshape(n, -1)
        block_next = step_next[block_next].reshape(n, -1)
    marks = np.zeros((n, SYMBOLS, 16), dtype=np.uint8)
    letters, point_next = np.zeros((n, SYMBOLS, 16, 4), dtype=np.uint8), np.zeros((n, SYMBOLS, 16, 4), dtype=np.uint8)
    for v, symbol, later in product(range(n), range(SYMBOLS), range(16)):
        now, after, least = rows[v], rows[step_next[v, symbol]], int(step_cost[v, symbol])
        tight = {}
        for p in range(4):
            if now[p] < FAR:
                for letter, cost, q in _edits(symbol, p):
                    if later >> q & 1 and now[p] + cost == after[q] + least:
                        tight.setdefault(p, (letter, q))
        marked = _marks_with_inserts(now, sum(1 << p for p in tight))
        marks[v, symbol, later] = marked
        for p in range(4):
            at_point, inserts = p, 0
            while marked >> p & 1:
                q = NEXT[at_point]
                insert = marked >> q & 1 and now[at_point] + INSERT == now[q]
                own = tight.get(at_point)
                if own and (own[0] in ("", "D") or not insert):
                    letters[v, symbol, later, p] = inserts * 4 + ("", "D", "K", "R").index(own[0])
                    point_next[v, symbol, later, p] = own[1]
                    break
                at_point, inserts = q, inserts + 1
    end_cost = np.array([min(r[EMPTY], r[ASSISTANT]) for r in rows])
    end_marks, end_inserts = np.zeros(n, dtype=np.uint8), np.zeros((n, 4), dtype=np.uint8)
    for v, r in enumerate(rows):
        last = sum(1 << p for p in (EMPTY, ASSISTANT) if r[p] == end_cost[v])
        end_marks[v] = _marks_with_inserts(r, last)
        for p in range(4):
            at_point = p
            while end_marks[v] >> p & 1 and not last >> at_point & 1:
                at_point, end_inserts[v, p] = NEXT[at_point], end_inserts[v, p] + 1
    return Tables(np.array(rows), block_next, block_cost, step_next, marks, letters, point_next, end_marks, end_cost, end_inserts)


_TEXT = np.array(["", "D", "K", "R", "I", "ID", "IK", "IR", "II", "IID", "IIK", "IIR"])


def cheapest_edits(symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Cost and letters of each conversation; ``symbols`` has those of all, ``counts`` how many each has."""
    t = tables()
    n = len(counts)
    blocks = -(-counts // BLOCK)
    order = np.argsort(-blocks, kind="stable")  # so that those with a k-th block are the first ones
    blocks, width = blocks[order], int(blocks.max(initial=0))
    first = (np.cumsum(counts) - counts)[order]
    size = counts[order]
    alive = np.searchsorted(-blocks, -np.arange(width), side="left")  # with more than k blocks
    base = np.concatenate([[0], np.cumsum(alive)])  # rows of the k-th block in what follows
    padded = np.full((int(base[-1]), BLOCK), NONE, dtype=np.uint8)
    for k in range(width):
        m = alive[k]
        for j in range(BLOCK):
            there = np.flatnonzero(size[:m] > k * BLOCK + j)
            padded[base[k] + there, j] = symbols[first[there] + k * BLOCK + j]
    codes = padded.astype(np.int64) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))
    now, cost = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    border = np.zeros(len(codes), dtype=np.int16)  # the vector before each block
    for k in range(width):
        m, own = alive[k], codes[base[k] : base[k + 1]]
        border[base[k] : base[k + 1]] = now[:m]
        cost[:m] += t.block_cost[now[:m], own]
        now[:m] = t.block_next[now[:m], own]
    cost += t.end_cost[now]
    marked = t.end_marks[now]
    later = np.zeros((len(codes), BLOCK), dtype=np.uint8)  # marks after each row
    vector = np.zeros((len(codes), BLOCK), dtype=np.int16)
    for k in range(width - 1, -1, -1):
        m, part = alive[k], slice(base[k], base[k + 1])
        vector[part, 0] = border[part]
        for j in range(1, BLOCK):
            vector[part, j] = t.step_next[vector[part, j - 1], padded[part, j - 1]]
        for j in range(BLOCK - 1, -1, -1):
            later[part, j] = marked[:m]
            marked[:m] = t.marks[vector[part, j], padded[part, j], marked[:m]]
    point = np.zeros(n, dtype=np.uint8)
    done = np.zeros((len(codes), BLOCK), dtype=np.uint8)
    for k in range(width):
        m, part = alive[k], slice(base[k], base[k + 1])
        for j in range(BLOCK):
            cell = (vector[part, j], padded[part, j], later[part, j], point[:m])
            done[part, j] = t.letters[cell]
            point[:m] = t.point_next[cell]
    tail = t.end_inserts[now, point]
    # back to the order of the conversations
    place = np.arange(n)
    owner = np.concatenate([place[:m] for m in alive]) if width else place[:0]
    flat = done[np.argsort(owner, kind="stable")].reshape(-1)
    ends = np.cumsum(blocks) * BLOCK
    pieces = _TEXT[flat]
    costs, audits = np.zeros(n, dtype=np.int64), [""] * n
    for i, (start, stop) in enumerate(zip((ends - blocks * BLOCK).tolist(), ends.tolist(), strict=True)):
        costs[order[i]] = cost[i]
        audits[order[i]] = "".join(pieces[start:stop].tolist()) + "I" * int(tail[i])
    return costs, audits


def damaged(rows: DataFrame) -> DataFrame:
    """The registered query's input: rows dropped, emptied, cut, repeated or renamed by a hash of id and turn.

    Columns conv_id, turn, role, text without nulls in the last two, and ``there``:
    false for a dropped row, which still names its conversation.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    found = rows.select(
        "conv_id", "turn", (kind != 0).alias("there"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"),
    )
    return found.drop("__copy")


def _text_hash() -> Column:
    return F.unhex(F.sha2(F.col("text"), 256))


def _signs(rows: DataFrame) -> DataFrame:
    """Each row without its text: what the repair has to know, in the order of its conversation."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    of = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    signs = rows.select(
        "conv_id", "turn", "there", "role", _text_hash().alias("hash"), of.cast("tinyint").alias("initial"),
        (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"),
    ).repartition("conv_id")
    # the partitioning by conversation serves the window as well
    seen = Window.partitionBy("conv_id", "role", "hash", "there").orderBy(F.col("turn").asc_nulls_first())
    signs = signs.withColumn("repeat", F.row_number().over(seen) > 1)
    return signs.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "hash")


def _runs(column: pa.Array) -> np.ndarray:
    """Where a new value begins, null being a value."""
    codes = pc.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    fresh = np.ones(len(codes), dtype=bool)
    fresh[1:] = codes[1:] != codes[:-1]
    return np.flatnonzero(fresh)


class _Open:
    """What is known so far of a conversation whose rows are still coming."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.symbols: list[np.ndarray] = []
        self.blank = self.repeat = self.cut = self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def add(self, there, initial, blank, cut, repeat, turns, known) -> None:
        initial, blank, cut, repeat, turns, known = (x[there] for x in (initial, blank, cut, repeat, turns, known))
        if not len(initial):
            return
        repeat = repeat & ~blank
        cut = cut & ~blank & ~repeat
        self.blank, self.repeat, self.cut = self.blank + int(blank.sum()), self.repeat + int(repeat.sum()), self.cut + int(cut.sum())
        self.symbols.append(np.where(blank | repeat, GONE, initial + 4 * cut).astype(np.uint8))
        chain = initial if self.initial is None else np.concatenate([[self.initial], initial])
        pair = chain[:-1] * 4 + chain[1:]
        self.illegal += int((~np.isin(pair, (1, 6, 9))).sum())  # su, ua, au
        self.initial = initial[-1]
        turns = turns[known]
        if len(turns):
            self.turns += 1 + int((turns[1:] != turns[:-1]).sum()) - (self.last is not None and self.last == turns[0])
            self.first, self.last = turns[0] if self.first is None else self.first, turns[-1]

    def facts(self) -> tuple:
        gaps = 0 if self.first is None else int(self.last) - int(self.first) + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.repeat, self.cut, self.illegal


FACTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
#: Rows whose conversations are solved together.
TOGETHER = 1 << 16


def _facts(conv_kind: pa.DataType):
    def close(found: list[_Open]) -> pa.RecordBatch:
        symbols = [np.concatenate(o.symbols) if o.symbols else np.zeros(0, dtype=np.uint8) for o in found]
        costs, audits = cheapest_edits(np.concatenate(symbols), np.array([len(s) for s in symbols]))
        facts = list(zip(*(o.facts() for o in found), strict=True))
        ids = pa.array(facts[0], conv_kind)
        numbers = [pa.array(f, pa.int64()) for f in facts[1:]]
        return pa.RecordBatch.from_arrays(
            [ids, *numbers, pa.array(costs), pa.array(audits, pa.string())],
            names=["conv_id", *(f.split()[0] for f in FACTS.split(", "))],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closed: list[_Open] = []
        open_, waiting = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("there", "initial", "blank", "cut", "repeat")
            ]
            turns = batch.column("turn")
            columns += [pc.fill_null(turns, 0).to_numpy(zero_copy_only=False), pc.is_valid(turns).to_numpy(zero_copy_only=False)]
            starts = _runs(batch.column("conv_id"))
            ids = batch.column("conv_id").take(pa.array(starts)).to_pylist()
            for conv_id, a, b in zip(ids, starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                if open_ is None or open_.conv_id != conv_id:
                    if open_ is not None:
                        closed.append(open_)
                    open_ = _Open(conv_id)
                open_.add(*(c[a:b] for c in columns))
                waiting += b - a
            if waiting >= TOGETHER and closed:
                yield close(closed)
                closed, waiting = [], 0
        if open_ is not None:
            yield close([*closed, open_])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, of each conversation first its facts, then its texts, to facts with the hash of the repaired text."""
    facts, digest, at, point, lines = None, None, 0, EMPTY, 0

    def say(role: str, text: str) -> None:
        nonlocal lines
        digest.update(("\n" if lines else "").encode() + role.encode() + b":" + text.encode())
        lines += 1

    def inserts() -> None:
        nonlocal at, point
        while facts["audit"][at : at + 1] == "I":
            point, at = NEXT[point], at + 1
            say("user" if point == USER else "assistant", "")

    for batch in batches:
        texts = batch.drop_columns([c for c in batch.schema.names if c not in ("role", "text", "is_row")]).to_pylist()
        heads = iter(batch.filter(pc.invert(batch.column("is_row"))).drop_columns(["role", "text", "is_row", "turn", "hash"]).to_pylist())
        ready = []
        for row in texts:
            if not row["is_row"]:
                if facts:
                    inserts()
                    ready.append(facts | {"repaired_sha256": digest.hexdigest()})
                facts, digest, at, point, lines = next(heads), hashlib.sha256(), 0, EMPTY, 0
                continue
            inserts()
            letter, at = facts["audit"][at], at + 1
            if letter == "K":
                after = _kept({"s": 0, "u": 1, "a": 2}.get(row["role"][:1], 3), point)
                say(row["role"], row["text"])
                point = after
            elif letter == "R":
                point = NEXT[point]
                say("user" if point == USER else "assistant", row["text"])
        if ready:
            yield _head_batch(ready, batch)
    if facts:
        inserts()
        yield _head_batch([facts | {"repaired_sha256": digest.hexdigest()}], batch)


def _head_batch(ready: list[dict], like: pa.RecordBatch) -> pa.RecordBatch:
    names = [n for n in like.schema.names if n not in ("role", "text", "is_row", "turn", "hash")]
    schema = pa.schema([like.schema.field(n) for n in names] + [pa.field("repaired_sha256", pa.string())])
    return pa.RecordBatch.from_pylist(ready, schema=schema)


def repaired(rows: DataFrame) -> DataFrame:
    """Facts, cost, audit and digest of each conversation of ``rows`` (conv_id, turn, role, text, there).

    One row per conv_id, also where no row is there: zeros, an empty audit, the hash of nothing.
    """
    rows = rows.select("conv_id", "turn", "role", "text", "there")
    signs = _signs(rows)
    kind = dict(rows.dtypes)
    head = f"conv_id {kind['conv_id']}, {FACTS}"
    conv_kind = to_arrow_type(rows.schema["conv_id"].dataType)
    facts = signs.select("conv_id", "turn", "there", "initial", "blank", "cut", "repeat").mapInArrow(_facts(conv_kind), head)
    texts = rows.filter("there").select("conv_id", "turn", "role", "text", _text_hash().alias("hash"), F.lit(True).alias("is_row"))
    both = facts.withColumn("is_row", F.lit(False)).unionByName(texts, allowMissingColumns=True).repartition("conv_id")
    both = both.sortWithinPartitions("conv_id", "is_row", F.col("turn").asc_nulls_first(), "role", "hash")
    return both.mapInArrow(_digests, head + ", repaired_sha256 string")
