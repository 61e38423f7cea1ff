"""Corpus operators against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from datetime import datetime

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType

import corpus_pipeline
from varloom.llm import bpe, imatch, jaccard, katz, mixing, pii, quality, simhash, topk, urls, warc
from varloom.llm.common import BATCH_SETTING, slices, small_batches, texts_of, words_of
from varloom.llm.components import connected_components

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")

ODD = [
    (1, "Hello world foo bar\nsecond line", "en", "a", 31),
    (1, "Hello world foo bar\nsecond line", "en", "a", 31),  # repeated row
    (2, None, None, None, None),
    (3, "", "en", None, 0),
    (4, "  \n\t ", "en", "b", 5),
    (5, "x" * 100_000, "en", "a", 100_000),
    (6, "word again " * 10_000, "de", "b", 110_000),
    (None, "a text whose id is null", "en", "a", 23),
    (7, "hello WORLD foo bar second line", "fr", "c", 31),
    (8, "été 𝕏 😀  card 4539578763621486, mail a.b@c.example.org", "fr", "c", 50),
    (9, "two words", "en", "c", 9),
]
CLASHING = ("score", "ids", "decoded", "fp", "component_id", "size", "copies", "n_replaced", "host", "verdict", "rank", "chunk")


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.select("*", *[F.lit("old").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out


def test_words_of_sliced_texts():
    texts = [" ".join(random.Random(i).choices(["Aa", "b", "CCCC", "É"], k=i % 9)) for i in range(60)] + [None, ""]
    batch = pa.record_batch({"text": pa.array(texts)})
    at = 0
    for piece in slices(iter([batch]), "text", 50):
        got, counts = words_of(texts_of(piece.column("text")))
        want = [words(t) for t in texts[at : at + piece.num_rows]]
        assert got.to_pylist() == [w for row in want for w in row] and counts.tolist() == [len(row) for row in want]
        at += piece.num_rows
    assert at == len(texts)


# 1 language model


def katz_by_hand(texts, train, order):
    """log10 scores, and the function P(w | h) of the recursion, from counts in dictionaries."""
    end, start = "</s>", "<s>"
    tokens = [[start] * (order - 1) + words(t) + [end] for t in texts]
    counts = {k: Counter() for k in range(1, order + 1)}
    for row, used in zip(tokens, train, strict=True):
        if used:
            for i in range(order - 1, len(row)):
                for k in counts:
                    counts[k][tuple(row[i - k + 1 : i + 1])] += 1
    limit = katz.GOOD_TURING
    d = {}
    for k, found in counts.items():
        n = Counter(found.values())
        tail = (limit + 1) * n[limit + 1] / n[1] if n[1] else 1.0
        d[k] = {}
        for r in set(found.values()):
            if r > limit:
                d[k][r] = 1 - katz.SPARE
                continue
            x = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if tail < 1 else 0
            d[k][r] = min(x, 1 - katz.SPARE) if 0 < x < 1 else (r - 0.5) / r
    total = sum(counts[1].values())
    after = defaultdict(Counter)
    for k, found in counts.items():
        for gram, c in found.items():
            after[gram[:-1]][gram[-1]] += c

    def p(history, w):
        if not history:
            c = counts[1][(w,)]
            if c:
                return d[1][c] * c / total
            return 1 - sum(d[1][x] * x for x in counts[1].values()) / total
        seen = after.get(history)
        if not seen:
            return p(history[1:], w)
        n, k = sum(seen.values()), len(history) + 1
        if w in seen:
            return d[k][seen[w]] * seen[w] / n
        left = 1 - sum(d[k][c] * c for c in seen.values()) / n
        return left / (1 - sum(p(history[1:], x) for x in seen)) * p(history[1:], w)

    out = [
        sum(math.log10(p(tuple(row[i - order + 1 : i]), row[i])) for i in range(order - 1, len(row))) for row in tokens
    ]
    return out, p, counts, after


@pytest.mark.parametrize("order", [2, 3])
def test_katz_equals_recursion_by_hand(spark, order):
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.expovariate(0.2))}" for _ in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(60)] + [None, "", "unknown words only"]
    train = [i % 7 != 2 for i in range(len(texts))]
    df = spark.createDataFrame(
        list(zip(range(len(texts)), texts, train, strict=True)), "doc_id bigint, text string, train boolean"
    ).repartition(3)
    got = {r["doc_id"]: r for r in katz.scores(df, F.col("train"), order, chunk_bytes=900).collect()}
    want, p, counts, after = katz_by_hand(texts, train, order)
    total, kinds = sum(counts[1].values()), len(counts[1])
    for i, text in enumerate(texts):
        row = [*words(text), "</s>"]
        assert got[i]["n_tokens"] == len(row) and got[i]["train_tokens"] == total
        assert got[i]["n_known"] == sum(counts[1][(w,)] > 0 for w in row)
        assert got[i]["score"] == pytest.approx(want[i], abs=1e-6)
        base = sum(math.log10((counts[1][(w,)] + 1) / (total + kinds + 1)) for w in row)
        assert got[i]["base_score"] == pytest.approx(base, abs=1e-9)
    outcomes = [g[0] for g in counts[1]] + ["never seen"]
    for history in list(after)[:40]:
        assert sum(p(history, w) for w in outcomes) == pytest.approx(1, abs=1e-9)


def test_katz_odd_rows(odd, none):
    found = katz.scores(odd, F.coalesce(F.col("doc_id") != 9, F.lit(True))).collect()
    assert len(found) == len(ODD)
    assert all(r["score"] <= 0 for r in found)
    assert {r["n_tokens"] for r in found if r["doc_id"] in (2, 3, 4)} == {1}
    assert katz.scores(none, F.lit(True)).count() == 0
    assert [r["score"] for r in katz.scores(odd.filter("doc_id = 9"), F.lit(False)).collect()] == [0.0]


# 2 quality


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(5)
    counts = np.array([1, 4, 6, 2])
    scores, moves, start = rng.normal(size=13) * 2, rng.normal(size=(2, 2)), rng.normal(size=2)
    got = quality.marginals(scores, counts, moves, start)[3][:, 1]
    at = 0
    for n in counts:
        mass, good = 0.0, np.zeros(n)
        for states in itertools.product((0, 1), repeat=int(n)):
            e = start[states[0]] + sum(scores[at + t] * s for t, s in enumerate(states))
            e += sum(moves[a, b] for a, b in itertools.pairwise(states))
            mass += math.exp(e)
            good += math.exp(e) * np.array(states)
        assert np.allclose(got[at : at + n], good / mass)
        at += n


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality.train(docs, labels, usable=~out)
    rows = quality.scored(docs.filter(out).select("doc_id", "text"), model).join(labels, "doc_id").collect()
    right = sum((r["score"] >= quality.THRESHOLD) == (r["quality"] == 1) for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.95
    again = quality.train(docs.repartition(5), labels.repartition(3), usable=~out)
    assert np.allclose(again.weights, model.weights)


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 0, 1), (6, None, None), (None, 1, 0), (8, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(odd, labels)
    found = quality.scored(odd, model)
    assert found.columns.count("score") == 1
    assert all(0 <= r["score"] <= 1 for r in found.collect())
    assert quality.good_documents(odd, model, 0.0).count() == len(ODD)
    assert quality.scored(none, model).count() == 0
    assert quality.train(odd, labels.limit(0)) is None
    assert {r["score"] for r in quality.scored(odd, None).collect()} == {0.5}


# 3 near duplicates


def fingerprint_by_hand(text):
    w = words(text)
    runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    out = 0
    for bit in range(64):
        if runs and sum(xxhash.xxh64_intdigest(r, 42) >> bit & 1 for r in runs) * 2 > len(runs):
            out |= 1 << bit
    return out


def classes_by_hand(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(fps))]


def test_fingerprints_by_hand():
    texts = [t for _, t, *_ in ODD if t is None or len(t) < 1000] + ["one two three four five " * 7]
    got = simhash.text_fingerprints(pa.array([t or "" for t in texts], pa.large_string()))
    assert [int(x) for x in got] == [fingerprint_by_hand(t) for t in texts]


@pytest.mark.parametrize("crowded", [64, 2])
def test_links_reach_all_near_fingerprints(spark, crowded):
    rng = random.Random(crowded)
    fps = []
    for _ in range(25):
        base = rng.getrandbits(64) & ~0xFFFFF
        for _ in range(rng.choice((1, 3, 40))):
            x = base
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    found = {r["node"]: r["component"] for r in connected_components(simhash.links(df, crowded=crowded)).collect()}
    assert set(found) <= set(signed)
    ours = Counter(frozenset(g) for g in _grouped(signed, [found.get(x, x) for x in signed]))
    assert ours == Counter(frozenset(g) for g in _grouped(signed, classes_by_hand(fps)))


def _grouped(items, names):
    out = defaultdict(list)
    for x, n in zip(items, names, strict=True):
        out[n].append(x)
    return out.values()


def test_thresholds_sum_and_cost():
    rng = np.random.default_rng(1)
    costs = rng.random((50, 3, 4))
    got = simhash.allocate(costs, 0)
    assert (got.sum(axis=1) == 0).all()
    for row, chosen in zip(costs, got, strict=True):
        best = min(
            sum(row[p, t + 1] for p, t in enumerate(ts)) for ts in itertools.product((-1, 0, 1, 2), repeat=3) if sum(ts) == 0
        )
        assert sum(row[p, t + 1] for p, t in enumerate(chosen)) == pytest.approx(best)


def test_near_duplicates_odd_rows(odd, none):
    found = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    assert len(found) == len(ODD)
    by_id = defaultdict(set)
    for k, c in found:
        by_id[k].add(c)
    assert by_id[1] == by_id[7] == {1}  # equal words
    assert by_id[2] == by_id[3] == by_id[4] == {2}  # no words
    assert by_id[None] == {None}
    assert simhash.near_duplicates(none).count() == 0


def test_one_of_each_odd_rows(odd, none):
    odd = odd.withColumn("fp", F.lit("mine")).withColumn("__fp", F.lit(0)).withColumn("head", F.lit(1))
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 5, 6, 8, 9]
    assert jaccard.one_of_each(none).count() == 0


def test_one_row_of_each_component(spark):
    """Rows without an id or with a shared id are copies only where their texts are."""
    rng = random.Random(4)
    x, y, *others = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(12)]
    rows = [(3, y), (5, y), (5, x), (5, x), *[(None, t) for t in others], (None, others[0]), (None, x)]
    docs = spark.createDataFrame([(t, k, "web") for k, t in rows], "text string, doc_id bigint, source string")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got == Counter([(3, y), (5, x), *[(None, t) for t in others]])


def brute_force_groups(texts):
    """The first text of each text's component, and the similar pairs, by sets of five-word tuples."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    pairs = [
        (i, j) for i, j in itertools.combinations(range(len(texts)), 2)
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    ]
    first, before = list(range(len(texts))), None
    while first != before:
        before = list(first)
        for i, j in pairs:
            first[i] = first[j] = min(first[i], first[j])
    return first, pairs


def nearly_all_copies_went(kept, first):
    """No document of its own is gone, and of those with an earlier near copy at least 97 % are."""
    assert set(first) <= set(kept)
    assert len(kept) - len(set(first)) <= 0.03 * (len(first) - len(set(first)))


def test_similar_texts_meet(spark):
    """Against brute-force Jaccard similarity on near copies of every distance."""
    rng = random.Random(4)
    line = [f"common{i}" for i in range(30)]
    texts = []
    for size in (4, 5, 6, 14, 60, 300):
        for _ in range(8):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)] + line * rng.randrange(2)
            for _ in range(rng.choice((1, 2, 12))):
                words = list(base)
                for _ in range(rng.randrange(1 + len(words) // 35)):
                    words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
                texts.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
    texts += [" ".join(line), None, "", " \n"]
    first, pairs = brute_force_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = corpus_pipeline.without_near_duplicates(spark, docs, "")
    nearly_all_copies_went([r["doc_id"] for r in kept.collect()], first)
    fps = [fingerprint_by_hand(t) for t in texts]
    assert any((fps[i] ^ fps[j]).bit_count() > 2 for i, j in pairs)


def largest_batch(spark, stage):
    """MB of the largest batch that rows of 10 kB come in, after ``stage`` was called on a few documents."""
    docs = spark.createDataFrame([(1, "one two three", "en", "a", 13)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    wide = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("x"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    spark.conf.unset(BATCH_SETTING)
    try:
        stage(docs)
        return max(r["n"] for r in wide.mapInArrow(run, "n bigint").collect()) / 1e6
    finally:
        spark.conf.unset(BATCH_SETTING)


@pytest.mark.parametrize("name", ["near duplicates", "token ids"])
def test_stages_hold_small_batches(spark, name):
    """What a stage returns is computed where it is written, so the bound holds for the session."""
    assert largest_batch(spark, lambda docs: dict(corpus_pipeline.STAGES)[name](spark, docs, "")) < 5


def test_smaller_bound_of_the_session_stays(spark):
    spark.conf.set(BATCH_SETTING, "1m")
    try:
        small_batches(spark)
        assert spark.conf.get(BATCH_SETTING) == "1m"
    finally:
        spark.conf.unset(BATCH_SETTING)


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_arrays_of_a_piece_of_text_are_small():
    """Many texts are looked at some at a time: NumPy and Python hold tens of MB."""
    rng = random.Random(3)
    texts = pa.array([" ".join(f"w{rng.randrange(3000)}" for _ in range(400)) + "\n" for _ in range(2000)])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    model = quality.fit(np.ones((4, 39)), np.full(4, 1), np.array([0, 1, 0, 1]), np.full(4, 9), rounds=2)

    def shingles():
        for piece in slices(iter([batch]), "text", jaccard.PIECE):
            found = texts_of(piece.column("text"))
            jaccard.band_keys(*jaccard.shingle_sets(found))
            simhash.text_fingerprints(found, jaccard.SHINGLE)

    def scores():
        for piece in slices(iter([batch]), "text", quality.PIECE):
            quality.text_scores(model, texts_of(piece.column("text")))

    assert peak_mb(shingles) < 30
    assert peak_mb(scores) < 35


def test_what_met_in_no_round_is_compared(spark):
    """However few rounds of centres there are, every pair of a bucket is compared or joined by a chain of links."""
    rng = random.Random(9)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(8):
            words = list(base)
            for k in rng.sample(range(120), rng.choice((0, 1, 2, 3))):
                words[k] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    few, many = (sorted(r["doc_id"] for r in jaccard.one_of_each(docs, n).collect()) for n in (0, 6))
    assert few == many
    nearly_all_copies_went(few, brute_force_groups(texts)[0])


@pytest.mark.parametrize("edits", [3, 6])
def test_group_of_copies_about_the_limit(spark, edits):
    """Copies of one text, each with its own changes: any two over, or all under, a similarity of 0.8."""
    rng = random.Random(edits)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for n in range(120):
        words = list(base)
        for k in rng.sample(range(300), edits):
            words[k] = f"x{n}-{k}"
        texts.append(" ".join(words))
    first, _ = brute_force_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = [r["doc_id"] for r in jaccard.one_of_each(docs).collect()]
    if edits == 3:
        assert set(first) == {0}
    nearly_all_copies_went(kept, first)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# 4 tokens


def test_bpe_equals_rank_encoder(spark, odd, none, sf):
    tokens = bpe.read_ranks(VOCABULARY)
    other = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={}
    )
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    found = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN)
    back = bpe.decode(found, VOCABULARY).collect()
    assert len(back) == docs.count()
    for r in back:
        assert r["ids"] == other.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    clash = bpe.decode(bpe.encode(odd, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY)
    assert sorted(clash.columns) == sorted(odd.columns)
    assert bpe.encode(none, VOCABULARY, public_tokenizers.PATTERN).count() == 0
    digests = bpe.encoding_digests(odd, VOCABULARY, public_tokenizers.PATTERN).collect()
    for r, (_, text, *_rest) in zip(digests, ODD, strict=True):
        ids = other.encode_ordinary(text or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_memory_overflow(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    tokens = bpe.read_ranks(VOCABULARY)
    codec = bpe.Codec(tokens, bpe.serialise_model(tokens), public_tokenizers.PATTERN)
    for text in ("one two three four five six seven eight", "nine ten one two"):
        assert codec.decode(codec.encode(text)) == text.encode()


# 5 personal data


def luhn_sum(s):
    digits = [int(c) for c in s][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10


def test_pseudonyms_keep_formats(spark):
    cards = [f"4{i:014d}" for i in range(300)]
    cards = [c + next(d for d in "0123456789" if luhn_sum(c + d) == 0) for c in cards]
    texts = [
        *cards, "4539578763621485", "1234-5678-9012-3456", "5500 0000 0000 0004", "192.168.10.254", "999.1.1.1", "v1.2.3.4.5",
        "jane.doe@mail.example.com", "+1 (017) 555-7713", "(212) 555-0199", "2024-02-29", "2023-02-30", "31.12.1999",
        "078-05-1120", "GB82WEST12345698765432", "GB82WEST12345698765431", "0a" * 20, "plain words 42 only", "",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymised(df, "k", changed="n").collect()}
    new = [got[i]["text"] for i in range(len(texts))]
    assert got[-1]["text"] is None and got[-1]["n"] == 0
    for old, t in zip(cards, new, strict=False):
        assert len(t) == 16 and luhn_sum(t) == 0 and t != old
    assert len(set(new[:300])) == 300  # different values never meet
    rest = dict(zip(texts[300:], new[300:], strict=True))
    for same in ("4539578763621485", "1234-5678-9012-3456", "999.1.1.1", "v1.2.3.4.5", "2023-02-30", "GB82WEST12345698765431", "plain words 42 only", ""):
        assert rest[same] == same
    assert luhn_sum(rest["5500 0000 0000 0004"].replace(" ", "")) == 0 and rest["5500 0000 0000 0004"][4] == " "
    assert all(int(x) <= 255 for x in rest["192.168.10.254"].split("."))
    assert rest["jane.doe@mail.example.com"].endswith("@mail.example.com") and rest["jane.doe@mail.example.com"][4] == "."
    assert rest["+1 (017) 555-7713"][:4] == "+1 (" and rest["+1 (017) 555-7713"] != "+1 (017) 555-7713"
    assert np.datetime64(rest["2024-02-29"]) and rest["2024-02-29"] != "2024-02-29"
    day, month, year = rest["31.12.1999"].split(".")
    assert np.datetime64(f"{year}-{month}-{day}")
    iban = rest["GB82WEST12345698765432"]
    number = "".join(str(int(c, 36)) for c in iban[4:] + iban[:4])
    assert int(number) % 97 == 1 and iban[4:8].isalpha() and iban != "GB82WEST12345698765432"
    assert set(rest["0a" * 20]) <= set("0123456789abcdef") and rest["0a" * 20] != "0a" * 20


def feistel_by_hand(value, key, tweak, alphabets):
    half = len(value) // 2
    left, right = value[:half], value[half:]
    for nth in range(1, pii.ROUNDS + 1):
        pad = hashlib.sha512("\x1f".join([key, tweak, str(nth), right]).encode()).digest()
        moved = ""
        for i, c in enumerate(left):
            own = next((a for a in alphabets if c in a), None)
            moved += own[(own.index(c) + pad[i % 64]) % len(own)] if own else c
        left, right = right, moved
    return left + right


def mod97_by_hand(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def filled_by_hand(template, new):
    letters = iter(new)
    return "".join(c if c in " -" else next(letters) for c in template)


def card_by_hand(value, key):
    digits = re.sub("[ -]", "", value)
    if luhn_sum(digits):
        return value
    body = feistel_by_hand(digits[:-1], key, "card", ("0123456789",))
    return filled_by_hand(value, body + next(d for d in "0123456789" if luhn_sum(body + d) == 0))


def iban_by_hand(value, key):
    plain = re.sub("[ -]", "", value)
    if mod97_by_hand(plain[4:] + plain[:4]) != 1:
        return value
    body = feistel_by_hand(plain[4:], key, "iban" + plain[:2], ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return filled_by_hand(value, f"{plain[:2]}{98 - mod97_by_hand(body + plain[:2] + '00'):02d}{body}")


def test_grouped_numbers_equal_plain_versions(spark):
    """Cards and IBANs of every usual grouping, against an implementation with plain integers and hashes."""
    cards = ["378282246310005", "3782 822463 10005", "3782-822463-10005", "3056 930902 5904", "5500 0000 0000 0004", "5500-0000-0000-0004", "4539578763621486", "6304 0000 0000 0000 000", "5500 0000-0000 0004", "4539578763621485"]
    ibans = ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "GB82-WEST-1234-5698-7654-32", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "NO93 8601 1117 947", "GB83 WEST 1234 5698 7654 32"]
    df = spark.createDataFrame([(i, f"a {v}, b") for i, v in enumerate(cards + ibans)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"][2:-3] for r in pii.pseudonymised(df, "k").collect()}
    for i, v in enumerate(cards):
        if v != "5500 0000-0000 0004":  # no usual grouping
            assert got[i] == card_by_hand(v, "k"), v
    for i, v in enumerate(ibans, len(cards)):
        assert got[i] == iban_by_hand(v, "k"), v
    assert re.sub("[ -]", "", got[1]) == re.sub("[ -]", "", got[2]) == got[0] != cards[0]
    assert got[len(cards)] == got[len(cards) + 1].replace(" ", "") and got[len(cards) + 6] == ibans[6]


@pytest.mark.parametrize(("text", "layout"), [
    ("2024-01-31", "%Y-%m-%d"), ("2024/01/31", "%Y/%m/%d"), ("31.01.2024", "%d.%m.%Y"), ("31/01/2024", "%d/%m/%Y"), ("01/31/2024", "%m/%d/%Y"),
])
def test_dates_keep_their_layout(spark, text, layout):
    df = spark.createDataFrame([(1, f"on {text}.")], "doc_id bigint, text string")
    new = pii.pseudonymised(df, "k").first()["text"][3:-1]
    assert new != text
    day = datetime.strptime(new, layout)
    same = pii.pseudonymised(spark.createDataFrame([(1, "2024-01-31")], "doc_id bigint, text string"), "k").first()["text"]
    assert day.strftime("%Y-%m-%d") == same


def test_domestic_phones(spark):
    texts = ["212 555 0199", "212-555-0199", "(212) 555-0199", "212.555.0199", "no 12 345 6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    new = [r["text"] for r in pii.pseudonymised(df, "k").orderBy("doc_id").collect()]
    for old, t in zip(texts[:4], new, strict=False):
        assert t != old and re.sub("[0-9]", "0", t) == re.sub("[0-9]", "0", old)
    assert new[4] == texts[4]


def test_dates_are_permuted(spark):
    days = spark.range(0, 3000).select(F.date_add(F.lit("1995-01-01"), F.col("id").cast("int")).cast("string").alias("d"))
    found = [r[0] for r in days.select(pii.date_pseudonym(F.col("d"), "k")).collect()]
    assert len(set(found)) == 3000


def test_equal_values_stay_linked(spark, odd, none):
    text = "x ann.bell@c.example.org y"
    df = spark.createDataFrame([(1, text), (2, "ann.bell@c.example.org 4539578763621486 4539578763621486\n" + text)], "doc_id bigint, text string")
    one, two = (r["text"] for r in pii.pseudonymised(df, "k").orderBy("doc_id").collect())
    mail = one.split()[1]
    assert mail != "ann.bell@c.example.org" and two.count(mail) == 2
    assert two.split()[1] == two.split()[2]
    other = pii.pseudonymised(df, "another key").orderBy("doc_id").first()["text"]
    assert other != one
    found = pii.pseudonymised(odd, "k", changed="n_replaced")
    assert sorted(found.columns) == sorted(odd.columns) and found.count() == len(ODD)
    assert found.filter("doc_id = 8").first()["n_replaced"] == 2
    assert pii.pseudonymised(none, "k").count() == 0


# 6 fingerprints


def imatch_by_hand(lexicon, text, subsets=imatch.SUBSETS):
    """(level, two lists of hashes) of a text, term by term with plain integers."""
    full, odd_number = 2**64 - 1, 0x9E3779B97F4A7C15

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    own = sorted(set(words(text)) & set(lexicon))
    if not own:
        return None
    level, out = math.ceil(math.log2(len(own))), []
    for k in (level, level + 1):
        hashes = []
        for j in range(subsets):
            kept = []
            for t in own:
                drawn = mixed((xxhash.xxh64_intdigest(t) + odd_number * (j + 1)) & full)
                if drawn % 2**k == 0:
                    kept.append(xxhash.xxh64_intdigest(t))
            total = sum(mixed((h + i * odd_number) & full) for i, h in enumerate(kept)) & full
            hashes.append((mixed(total) >> 64 - 4 * imatch.WIDTH | 1) if kept else 0)
        out.append(hashes)
    return level, out


def likeness_by_hand(a, b):
    if a is None or b is None:
        return None
    pairs = [(x, y) for k, xs in enumerate(a[1]) for m, ys in enumerate(b[1]) if a[0] + k == b[0] + m for x, y in zip(xs, ys, strict=True)]
    some = [x == y for x, y in pairs if x or y]
    return sum(some) / len(some) if some else float(a == b)


def test_imatch_by_hand(spark, odd, none):
    rng = random.Random(1)
    vocabulary = [f"term{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 120)))) for i in range(0, 400, 2)] + [(401, rows_text := "term1 term2"), (403, rows_text)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    n = len(rows)
    df_by_hand = Counter(w for _, t in rows for w in set(words(t)))
    assert {r["term"]: r["df"] for r in imatch.document_frequencies(df).collect()} == df_by_hand
    terms = imatch.lexicon(df, least_common=0.15, most_common=0.3)
    least = math.ceil(0.15 * n)
    assert terms.to_pylist() == sorted(t for t, c in df_by_hand.items() if least <= c <= int(0.3 * n))
    got = sorted(imatch.edited_likeness(df, terms).collect(), key=lambda r: r["doc_id"])
    matcher = imatch.Matcher(terms)
    assert len(got) == n
    for i, r in enumerate(got):
        text, following = rows[i][1], rows[(i + 1) % n][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        a, b, c = matcher.fingerprints(pa.array([text, edited, following], pa.large_string()))
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a[2], b[2])
        assert r["near_edited"] == imatch.likeness(a, b) and r["near_next"] == imatch.likeness(a, c)
        plain = [imatch_by_hand(terms.to_pylist(), t) for t in (text, edited, following)]
        if plain[0]:
            level, hashes = plain[0]
            assert r["fingerprint"] == f"{level:02x}" + "".join(f"{x:0{imatch.WIDTH}x}" for h in hashes for x in h)
        for name, other in (("near_edited", plain[1]), ("near_next", plain[2])):
            want = likeness_by_hand(plain[0], other)
            assert r[name] == pytest.approx(float(r["fingerprint"] == r["edited_fingerprint"] and name == "near_edited") if want is None and name == "near_edited" else r[name] if want is None else want)
    assert got[-1]["fingerprint"] == got[-2]["fingerprint"]
    found = imatch.edited_likeness(odd, imatch.lexicon(odd)).collect()
    assert len(found) == len(ODD)
    assert imatch.edited_likeness(none, imatch.lexicon(none)).count() == 0
    alone = imatch.edited_likeness(odd.filter("doc_id = 9"), imatch.lexicon(odd)).first()
    assert alone["near_next"] == 1.0


# 7 URLs


def test_url_rules_by_hand(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "", "block"), ("b.org", "/x", "block"), ("b.org", "/x", "allow")]
    pages = [
        "http://example.net/en/1", "https://WWW.Example.NET/en/1?x=/de/", "http://example.net", "http://example.net/fr", "ftp://notexample.net/en/",
        "http://a.example.net#t", "http://b.org/xy", "http://b.org/", "no scheme", "", None, "://net/", "http:///en/", "http://net/?://b.org/x",
        "HTTP://u@b.org:80/x", "http://b.org/xy", "line\nbreak://c.b.org/x\ny",
    ]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(pages)], "page_id bigint, url string, verdict string")
    got = {r["page_id"]: r for r in urls.judged(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(pages)
    for i, u in enumerate(pages):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert got[i]["rule"] == (best[0] + best[1] if best else None)
        assert got[i]["verdict"] == (best[2] if best else "allow")
    nothing = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in urls.judged(df, nothing).collect()} == {"allow"}
    assert urls.judged(df.limit(0), nothing).count() == 0


# 8 mixing


def targets_by_hand(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "é", "c", None, "d"]), int(rng.paretovariate(0.9) * 10) - 10) for i in range(3000)] + [(5, "a", 7)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    got = mixing.copies(df.repartition(7), bucket_rows=50).collect()
    again = mixing.copies(df.repartition(3), bucket_rows=50).collect()
    key = lambda r: (r["doc_id"], r["source"] or "", r["size"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sorted((r["doc_id"], r["source"] or "", r["size"]) for r in got) == sorted((a, b or "", c) for a, b, c in rows)
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = targets_by_hand(sizes)
    taken, longest = Counter(), Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= longest[s]


def test_pairs_keep_words_and_chances():
    sizes, wanted = np.array([50, 30, 20, 10, 5]), np.array([0.3, 0.3, 0.7, 0.5, 0.2])
    total = np.zeros(5)
    for seed in range(4000):
        out = mixing.pair_up(sizes, wanted, np.random.default_rng(seed))
        assert sizes @ out == pytest.approx(sizes @ wanted)
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1
        total += out
    assert np.allclose(total / 4000, wanted, atol=0.03)


def pivotal_by_hand(rows, rng, last):
    """Rounded fractions of (size, wanted) in their order: mass moves between a held row and the next until one is whole."""
    draws = [rng.random() for _ in rows]
    out, held = [w for _, w in rows], None
    for i, (size, w) in enumerate(rows):
        if held is None:
            held = i
            continue
        a, p, q = rows[held][0], out[held], w
        fill, drain = min((1 - p) * a, q * size), min(p * a, (1 - q) * size)
        if draws[i] * (fill + drain) < drain:
            out[held], out[i] = (1.0, q - fill / size) if fill == (1 - p) * a else (p + fill / a, 0.0)
        else:
            out[held], out[i] = (0.0, q + drain / size) if drain == p * a else (p - drain / a, 1.0)
        held = i if 0 < out[i] < 1 else held if 0 < out[held] < 1 else None
    if last:
        before, chances = list(out), [rng.random() for _ in rows]
        out = [float(c < w) if 0 < w < 1 else w for w, c in zip(out, chances, strict=True)]
        excess = sum(size * (x - w) for (size, _), x, w in zip(rows, out, before, strict=True))
        for i, (size, _) in enumerate(rows):
            if size <= excess and out[i] == 1:
                out[i], excess = 0.0, excess - size
            elif size <= -excess and out[i] == 0:
                out[i], excess = 1.0, excess + size
    return out


def test_mix_equals_plain_tree(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), int(rng.paretovariate(0.9) * 10)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    got = {r["doc_id"]: r["copies"] for r in mixing.copies(df, bucket_rows=7, seed=3).collect()}
    hashed = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64("doc_id", "size").alias("h")).collect()}
    sizes, count = Counter(), Counter()
    for _, s, n in rows:
        sizes[s] += n
        count[s] += 1
    targets, want, waiting = targets_by_hand(sizes), {}, []
    for i, s, n in rows:
        rate = targets[s] / sizes[s]
        want[i] = math.floor(rate)
        fraction = rate * 1 - math.floor(rate * 1)
        if 0 < fraction < 1:
            waiting.append((i, s, n, fraction, hashed[i] % max(1, -(-count[s] // 7))))
    buckets, level = -(-max(count.values()) // 7), 0
    while waiting:
        groups, left = defaultdict(list), []
        for row in waiting:
            groups[row[1], row[4]].append(row)
        for (s, bucket), own in groups.items():
            own.sort(key=lambda r: (-r[2], r[0], r[3]))
            seed = int.from_bytes(hashlib.blake2b(f"3/{level}/{bucket}/{s!r}".encode(), digest_size=8).digest(), "little")
            done = pivotal_by_hand([(r[2], r[3]) for r in own], np.random.default_rng(seed), buckets == 1)
            for (i, _, n, _, _), w in zip(own, done, strict=True):
                if 0 < w < 1:
                    left.append((i, s, n, w, bucket // mixing.FAN_IN))
                else:
                    want[i] += round(w)
        waiting, level, buckets = left, level + 1, -(-buckets // mixing.FAN_IN)
    assert got == want and level > 1


def test_mix_of_repeated_rows(spark):
    """A third of all rows are one row, another third have no id and one size: no bucket holds them as rows, and copies add up."""
    rows = [(5, "same words", "a")] * 400 + [(None, f"word {i:03d}", "a") for i in range(400)] + [(i, "w " * (i % 9), "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    kinds = {(r["doc_id"], r["source"], r["size"]): r for r in mixing.counted_copies(docs.select("doc_id", "source", mixing.word_count().alias("size"))).collect()}
    assert kinds[5, "a", 2]["rows"] == kinds[None, "a", 2]["rows"] == 400
    got = Counter(map(tuple, mixing.mixed(docs).collect()))
    again = Counter(map(tuple, mixing.mixed(docs.repartition(3)).collect()))
    assert got == again
    per_kind = Counter()
    for (i, text, source), n in got.items():
        per_kind[i, source, len(text.split())] += n
    assert per_kind == Counter({k: r["copies"] for k, r in kinds.items() if r["copies"]})
    own = [got[None, f"word {i:03d}", "a"] for i in range(400)]
    assert max(own) - min(own) <= 1 and max(own) <= 2
    each = Counter(r["copies"] for r in mixing.copies(docs.select("doc_id", "source", mixing.word_count().alias("size"))).filter("doc_id = 5 AND source = 'a'").collect() if r)
    assert sum(each.values()) in (400, 401) and max(each) - min(each) <= 1


def test_mix_odd_rows(odd, none):
    found = mixing.mixed(odd)
    assert found.columns == odd.columns
    per_id = Counter(r["doc_id"] for r in found.collect())
    assert max(n for k, n in per_id.items() if k != 1) <= 2 and per_id[1] <= 4
    assert mixing.mixed(none).count() == 0


# 9 WARC


def test_page_parts():
    body = (
        "<!DOCTYPE html><html><head><title> A &amp;\n B </title><style>p{x:'</p>'}</style><script>var a='<p>no</p>'</script></head>"
        "<body><!-- no <p>no --><nav><a href='/x?a=1&amp;b=2'>one</a> <a href=y>two</a><a href=\"/x?a=1&amp;b=2\">again</a></nav>"
        "<p>first <b>bold</b>text<br>line 1 &lt; 2</p><img src=\"http://i.example/z.png\" alt='a > b'>tail"
    )
    text, title, links = warc.page_parts(body, "http://h.example/d/e")
    assert title == "A & B"
    assert text == "one twoagain\nfirst boldtext\nline 1 < 2\ntail"
    assert links == ["http://h.example/x?a=1&b=2", "http://h.example/d/y", "http://i.example/z.png"]
    assert warc.page_parts("", None) == ("", "", [])
    for broken in ("<" * 20_000, "<!--" * 20_000, "<a href=\"" * 20_000, "<script>" * 20_000, "<a b='" * 20_000):
        warc.page_parts(broken, None)


def test_warc_round_trip(spark, tmp_path):
    pages = [
        (1, "http://a.example/", "<p>one</p>", "x"), (1, "http://a.example/", "<p>one</p>", "x"), (2, None, None, "x"), (3, "http://[bad/", "<a href='//[x'>é\r\n\r\nWARC/1.1\r\n</a>", "x"),
        (None, "", "", "x"),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, block string")
    source = warc.responses(df, "2024-01-01T00:00:00Z")
    made = warc.derivatives(source)
    rows = made.collect()
    assert len(rows) == 2 * len(pages)
    of = {r["record_id"]: r for r in source.collect()}
    for r in rows:
        origin = of[r["refers_to"]]
        assert (r["target_uri"], r["source_headers"], r["source_digest"]) == (origin["target_uri"], origin["http_headers"], origin["payload_digest"])
        assert r["content_length"] == len(r["block"].encode()) and r["block_digest"] == warc.sha1_digest(r["block"].encode())
    assert len({r["record_id"] for r in rows}) == 2 * 4
    warc.write_records(made, str(tmp_path / "out"))
    names = [c.split(" ")[0] for c in warc.RECORD.split(", ")]
    back = warc.read_records(spark, str(tmp_path / "out")).collect()
    plain = lambda r: tuple(r[n] for n in names)
    assert sorted(map(plain, back), key=str) == sorted(map(plain, rows), key=str)
    assert warc.derivatives(warc.responses(df.limit(0), "x")).count() == 0


# 10 search


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-6, 7, size=(400, 8)) / 256
    vectors[50:80] = vectors[50]  # ties
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType()))]))
    whole = np.floor(256 * vectors.astype(np.float32).astype(float)).astype(int)
    found = topk.top_k(topk.whole_vectors(df), F.col("vec_id") % 5 == 0, 4, shard_rows=60, block_rows=7)
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert len(got) == 80
    for q, best in got.items():
        scores = whole @ whole[q]
        order = sorted((i for i in range(400) if i != q), key=lambda i: (-scores[i], i))[:4]
        assert best == [(i, scores[i]) for i in order]


def test_tree_bounds_hold():
    rng = np.random.default_rng(0)
    vectors, queries = rng.integers(-100, 100, size=(300, 5)), rng.integers(-100, 100, size=(7, 5))
    tree = topk.Tree(vectors, 16)
    bounds, scores = tree.bounds(queries), queries @ vectors[tree.order].T
    for node, (a, b) in enumerate(tree.span):
        assert (scores[:, a:b].max(axis=1) <= bounds[:, node]).all()
    assert sorted(tree.order) == list(range(300))


def test_splits_route_every_row():
    rng = np.random.default_rng(1)
    sample = rng.integers(-50, 50, size=(200, 4))
    sample[:90] = sample[0]  # equal vectors stay together
    nodes = topk.splits(sample, 12)
    regions = topk.region_of(nodes, sample)
    assert len(set(regions[:90])) == 1 and 4 <= len(set(regions)) <= 12
    assert sorted(set(regions)) == list(range(sum(side < 0 for side, *_ in nodes)))
    assert set(topk.region_of(nodes, rng.integers(-900, 900, size=(50, 4)))) <= set(regions)
    assert topk.splits(np.zeros((5, 0), int), 3) == topk.splits(np.zeros((5, 2), int), 3) == [(-1, 0, 0, 0)]


def test_trees_are_rows_and_hot_vectors_split(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in (rng.integers(-9, 9, 3) if i % 3 else np.zeros(3))], 3, False, 0, int(rng.integers(1 << 31))) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>, length int, asks boolean, region int, lot bigint")
    nodes = topk.trees(df, 100).collect()
    held = defaultdict(list)
    for r in nodes:
        held[r["piece"]] += r["ids"]
        assert len(r["vectors"]) == 3 * len(r["ids"]) and bool(r["ids"]) != bool(r["children"])
    assert len(held) == 9 and max(map(len, held.values())) < 160
    assert sorted(i for ids in held.values() for i in ids) == list(range(900))


def test_queries_go_only_where_boxes_allow(spark):
    # two far clusters: what the near one gives is out of reach for the other
    rows = [(i, [(1 if i % 2 else -1) * 3.0 + i % 7 / 64, i % 5 / 64]) for i in range(600)]
    df = topk.whole_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    boxes = pa.table({
        "length": pa.array([2, 2], pa.int32()), "region": pa.array([0, 1], pa.int32()), "piece": pa.array([0, 0], pa.int32()),
        "low": pa.array([[-768, 0], [768, 0]], pa.list_(pa.int64())), "high": pa.array([[-740, 20], [800, 20]], pa.list_(pa.int64())),
    })
    asked = df.filter("vec_id < 40").select(F.lit(2).alias("length"), "vec_id", "v")
    first = topk.reached(asked.select("*", F.lit(None).cast("bigint").alias("kth"), F.lit(True).alias("first")), boxes).collect()
    assert len(first) == 40 and all(r["region"] == r["vec_id"] % 2 for r in first)
    told = asked.withColumn("first", F.lit(False))
    assert topk.reached(told.withColumn("kth", F.lit(0).cast("bigint")), boxes).count() == 0
    rest = topk.reached(told.withColumn("kth", F.lit(None).cast("bigint")), boxes).collect()
    assert len(rest) == 40 and all(r["region"] != r["vec_id"] % 2 for r in rest)


def test_top_k_odd_rows(spark):
    kind = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("score", StringType())])
    rows = [
        (0, [1.0, 2.0], "x"), (0, [1.0, 2.0], "x"), (1, [1.0, None], "x"), (2, None, "x"), (3, [float("nan"), 1.0], "x"), (4, [float("inf"), 1.0], "x"),
        (5, [0.5, 0.5], "x"), (5, [0.5, 0.5], "x"), (6, [1.0], "x"), (None, [9.0, 9.0], "x"), (50, [], "x"), (51, [], "x"), (100, [2.0, -2.0], "x"),
    ]
    df = spark.createDataFrame(rows, kind)
    found = topk.top_k(topk.whole_vectors(df), F.col("vec_id") % 50 == 0, 5)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())
    assert got == [
        (0, 1, 5, 98304), (0, 2, 5, 98304), (0, 3, 100, -131072), (50, 1, 51, 0), (100, 1, 5, 0), (100, 2, 5, 0), (100, 3, 0, -131072), (100, 4, 0, -131072),
    ]
    assert topk.top_k(topk.whole_vectors(df.limit(0)), F.col("vec_id") % 50 == 0, 5).count() == 0
