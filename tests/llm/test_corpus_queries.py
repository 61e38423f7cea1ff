"""Registered corpus queries beside their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from check import TABLES, compare
from pyspark.sql import functions as F

import corpus_pipeline
from varloom.llm import bpe, mixing, quality
from varloom.llm.common import stored
from varloom.llm.queries import ORACLES, QUERIES, VOCABULARY

from test_corpus_operators import brute_force_groups, nearly_all_copies_went  # noqa: I001


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        problem, _ = compare(df, con, ORACLES[name])
        assert problem is None, problem
    else:
        rows = df.count()
        named, times, key = {"op9_warc_derivatives": ("pages", 2, "page_id"), "op11_turn_repair": ("conversations", 1, "conv_id")}.get(name, ("documents", 1, "doc_id"))
        assert rows == times * spark.read.parquet(f"{sf}/{named}.parquet").select(key).distinct().count()


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input and result of every stage."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = stored(stage(spark, docs, sf), "test-stage")
        out[name] = docs, result
        docs = result
    return out


def test_stage_columns(spark, sf, stages):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name][1].columns == columns


def test_quality_stage(spark, sf, stages):
    before, after = stages["quality classifier"]
    model = quality.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = before.collect()
    scores = quality.text_scores(model, pa.array([r["text"] or "" for r in rows], pa.large_string()))
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after.collect()}
    good = [k for k, v in labels.items() if v == 1]
    assert sum(k in kept for k in good) >= 0.95 * len(good)


def test_near_duplicate_stage(stages):
    before, after = stages["near duplicates"]
    rows = sorted(before.collect(), key=lambda r: r["doc_id"])
    first, _ = brute_force_groups([r["text"] for r in rows])
    place = {r["doc_id"]: i for i, r in enumerate(rows)}
    nearly_all_copies_went([place[r["doc_id"]] for r in after.collect()], first)


def test_personal_data_stage(stages):
    before, after = stages["personal data"]
    old, new = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (before, after))
    assert old.keys() == new.keys()
    changed = [k for k in old if old[k] != new[k]]
    assert changed and len(changed) < len(old)
    for k in changed:
        assert [len(x) for x in old[k].split("\n")] == pytest.approx([len(x) for x in new[k].split("\n")], abs=20)


def test_mix_stage(stages):
    before, after = stages["source mix"]
    sized = before.select("doc_id", "source", mixing.word_count().alias("size"))
    want = {r["doc_id"]: r["copies"] for r in mixing.copies(sized).collect() if r["copies"]}
    got = {r["doc_id"]: r["n"] for r in after.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_token_stage(stages):
    before, after = stages["token ids"]
    tokens = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count()
    for r in rows:
        assert b"".join(tokens[i] for i in r["ids"]).decode() == texts[r["doc_id"]]
