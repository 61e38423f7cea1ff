"""Turn repair, Merkle manifest and toxicity against plain versions written anew."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import merkle, toxicity, turns
from varloom.llm.queries import QUERIES

# 11 turn repair


def cheapest(rows, gone, cut):
    """(cost, letters, repaired lines) by best-first search over all edits, in the order of cost and letters."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters, lines
        point = (i, roles[-1:] if roles else "-")
        if point in seen:
            continue
        seen.add(point)

        def push(more, letter, step, role, text, *, cost=cost, letters=letters, i=i, roles=roles, lines=lines):
            if re.fullmatch("(s?(ua)*u?)?", roles + role[:1]):
                heapq.heappush(heap, (cost + more, letters + letter, i + step, roles + role[:1], (*lines, f"{role}:{text}")))

        for role in ("user", "assistant"):
            push(3, "I", 0, role, "")
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, roles, lines))
            if not gone[i]:
                role, text = rows[i]
                if role[:1] in ("s", "u", "a"):
                    push(3 * cut[i], "K", 1, role, text)
                for new in ("user", "assistant"):
                    push(3 + 3 * cut[i], "R", 1, new, text)


def repaired_by_hand(table):
    """Rows (conv_id, turn, role, text) to what the query returns for each conversation."""
    left = defaultdict(list)
    for conv_id, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        own = left[conv_id]
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        if kind:
            own += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv_id, own in left.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        seen, gone, cut, counts = set(), [], [], [0, 0, 0]
        for _, role, text in own:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not letters else 1 if (role, text) in seen else 2 if letters[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            gone.append(fault in (0, 1))
            cut.append(fault == 2)
        rows = [(r, t) for _, r, t in own]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, letters, lines = cheapest(rows, gone, cut)
        out[conv_id] = (gaps, *counts, illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found_turns(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def test_turn_repair_equals_search(spark, sf):
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found_turns(QUERIES["op11_turn_repair"](spark, sf)) == repaired_by_hand(table)


def test_turn_repair_of_random_and_odd_conversations(spark):
    rng = np.random.default_rng(5)
    roles = ["system", "user", "assistant", "tool", "", None, "User"]
    texts = ["Yes.", "no", "Why?", "", None, " \t\n", "a. ", " ", "Yes.", "x" * 3000 + "!"]
    table = [
        (None if c == 0 else int(c), None if rng.random() < 0.1 else int(rng.integers(-3, 30)), roles[rng.choice(7, p=[0.1, 0.3, 0.3, 0.1, 0.05, 0.1, 0.05])], texts[rng.integers(10)])
        for c in range(60) for _ in range(int(rng.integers(1, 26)))
    ]
    table += table[:40] + [(500, 2, "user", "same.")] * 30 + [(501, None, None, None)] * 3
    df = spark.createDataFrame(table, "conv_id bigint, turn bigint, role string, text string").withColumn("audit", F.lit("mine"))
    assert found_turns(turns.repaired(turns.damaged(df.repartition(3)))) == repaired_by_hand(table)
    assert turns.repaired(turns.damaged(df.limit(0))).count() == 0


def test_long_conversation_spans_batches(spark):
    table = [(7, t, ("user", "assistant", "system")[t * t % 3], f"{t % 50}{'.' if t % 7 else ''}") for t in range(900)]
    df = spark.createDataFrame(table, "conv_id bigint, turn bigint, role string, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = found_turns(turns.repaired(turns.damaged(df)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == repaired_by_hand(table)


def test_block_tables_are_small_and_equal_single_steps():
    t = turns.tables()
    assert len(t.vectors) < 200 and t.block_next.shape[1] == turns.SYMBOLS**turns.BLOCK
    rng = np.random.default_rng(0)
    for _ in range(200):
        v, block = int(rng.integers(len(t.vectors))), rng.integers(turns.SYMBOLS, size=turns.BLOCK)
        code, at = int(block @ (turns.SYMBOLS ** np.arange(turns.BLOCK - 1, -1, -1))), v
        for s in block:
            at = int(t.step_next[at, s])
        assert at == t.block_next[v, code]


# 12 Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_by_hand(row, text):
    said = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in said])


def tree_by_hand(hashes):
    """Top, and the siblings of each leaf level by level with its place in the run."""
    places, paths = list(range(len(hashes))), [[] for _ in hashes]
    while len(hashes) > 1:
        runs = [hashes[i : i + 16] for i in range(0, len(hashes), 16)]
        for path, i in zip(paths, places, strict=True):
            run = runs[i // 16]
            path.append((run[: i % 16], run[i % 16 + 1 :]))
        hashes, places = [h(*r) for r in runs], [i // 16 for i in places]
    return hashes[0], paths


def manifest_by_hand(rows):
    by = defaultdict(list)
    for r in rows:
        low = None if r["text"] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
        crc = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode())
        own = leaf_by_hand(r, r["text"])
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, own, leaf_by_hand(r, low) if crc % 5 == 0 else own))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_by_hand([x[2] for x in sorted(by[s])]) for s in names}
    root, above = tree_by_hand([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for (known, doc_id, own, changed), path in zip(sorted(by[s]), trees[s][1], strict=True):
            node = changed
            for before, after in path + up:
                node = h(*before, node, *after)
            proof = h(*[x for before, after in path + up for x in (*before, *after)])
            out.append((doc_id if known else None, own, trees[s][0], root, proof, node, node == root))
    return sorted(out, key=str)


def manifest_of(df, **options):
    changed = F.when(merkle.tampered(F.col("doc_id")), merkle.leaf(text=merkle.lowered(F.col("text")))).otherwise(merkle.leaf())
    return sorted((tuple(r) for r in merkle.manifest(df, changed, **options).collect()), key=str)


def test_manifest_equals_plain_tree(spark):
    rng = np.random.default_rng(3)
    rows = [
        (None if i % 97 == 0 else int(i), f"s{int(rng.integers(40)):02d}" if i % 5 else None, None if i % 11 == 0 else "en", int(i % 3), ["Abé", "", None, "xyz", "X" * 9000][i % 5], "own")
        for i in range(1500)
    ] + [(10**15 + 1, "s00", "en", 1, "Same", "own")] * 60 + [(5, "lone", "de", None, "Q", "own")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string").repartition(5)
    got = manifest_of(df)
    assert got == manifest_by_hand(df.collect())
    assert {r[6] for r in got} == {True, False}
    assert merkle.manifest(df.limit(0), merkle.leaf()).count() == 0
    one = df.filter("source = 'lone'")
    assert manifest_of(one) == manifest_by_hand(one.collect())


@pytest.mark.parametrize("depth", [1, 2])
def test_manifest_with_small_superblocks(spark, depth):
    rows = [(int(i), "big" if i % 3 else "small", "en", 1, f"T{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert manifest_of(df, depth=depth) == manifest_by_hand(df.collect())


# 13 toxicity


@pytest.mark.parametrize(("text", "folded"), [
    ("", "  "), ("1D10T!", " idiot "), ("ѕtupіd you", " stupid you "), ("ＳＣＵＭ", " scum "), ("tr@sh, 7rash", " trash trash "), ("a_b--c", " a b c "),
])
def test_folding(text, folded):
    assert toxicity.fold(text) == folded


def test_matches_equal_plain_search():
    rng = np.random.default_rng(1)
    words = ["ab", "abc", "abcd", "abcde", "bcd", "xx", "yy", "abz"]
    lexicon = toxicity.Lexicon({" ab ": 1.0, " abc": 3.0, " abcde ": 5.0, " xx ": 2.0}, (" yy xx ", " abcd yy "))
    automaton = lexicon.automaton()
    for _ in range(200):
        text = toxicity.fold(" ".join(words[i] for i in rng.integers(len(words), size=rng.integers(0, 12))))
        want = {}
        for place in [m.start() for m in re.finditer(" ", text)][:-1]:
            hit = [w for term, w in lexicon.weights.items() if text.startswith(term, place)]
            if hit:
                want[place] = max(hit)
        for phrase in lexicon.exceptions:
            for at in range(len(text)):
                if text.startswith(phrase, at):
                    want = {p: w for p, w in want.items() if not at <= p < at + len(phrase) - 1}
        assert toxicity.matched(automaton, text) == want


def _taught(spark, n=600):
    rng = np.random.default_rng(2)
    plain = [f"w{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(n):
        words = [plain[k] for k in rng.integers(80, size=int(rng.integers(5, 60)))]
        toxic = i % 6 == 0
        if toxic:
            words[int(rng.integers(len(words)))] = ["idiot", "1diot", "scummy", "scumlike"][i // 6 % 4]
        elif i % 6 == 1:
            words += ["moron", "mountains"]
        elif i % 60 == 2:
            words.append("moronic")
        rows.append((i, " ".join(words), "mine"))
        labels.append((i, 1, int(toxic)))
    labels += [(0, 1, None), (None, 1, 1), (6, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_learns_words_and_beginnings(spark):
    docs, labels = _taught(spark)
    model = toxicity.train(docs, labels)
    assert " idiot " in model.weights and " scum" in model.weights and " moron " not in model.weights
    odd = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "", "b"), (2, "you 1d10t", "c"), (3, "scumbag w1", "d"), (4, "w1 moron mountains", "e"), (5, "w2 " * 50_000 + "idiot", "f")], docs.schema)
    got = {(r["doc_id"], r["text"]): r["score"] for r in toxicity.scored(odd, model).collect()}
    toxic = {k for (k, _), v in got.items() if v >= toxicity.THRESHOLD}
    assert {2, 3} <= toxic and not {None, 1, 4} & toxic
    assert toxicity.scored(odd, model).columns == ["doc_id", "text", "score"] and toxicity.scored(odd, model).count() == 7
    assert toxicity.scored(odd.limit(0), model).count() == 0


def test_exception_phrases(spark):
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        rows.append((i, f"w{i % 17} trash w{i % 13}" if toxic else f"w{i % 17} trash can" if i % 9 == 1 else f"w{i % 17} w{i % 13}"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    automaton = model.automaton()
    if " trash " in model.weights:
        assert " trash can " in model.exceptions
    assert not toxicity.matched(automaton, toxicity.fold("the trash can"))


def test_nothing_learned_without_both_labels(spark):
    docs, labels = _taught(spark, 30)
    assert toxicity.train(docs, labels.filter("toxic = 1")) is None
    assert toxicity.train(docs, labels.limit(0)) is None
    assert {r["score"] for r in toxicity.scored(docs, None).collect()} == {0.0}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    found = QUERIES["op13_toxic_lexicon"](spark, sf).filter("held_out")
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet").filter("toxic IS NOT NULL"), "doc_id").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == k] for k in (1, 0))
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)
