"""Stored helpers against their plain forms: stream state, graph walks, dictionaries, sketches, SQLite files."""

from __future__ import annotations

import random
import shutil
import sqlite3
from itertools import product
from uuid import uuid4

import pytest
from conftest import rows
from pyspark.sql import functions as F

from varloom.operators import dictionary, graph, sketches
from varloom.operators import filters as flt
from varloom.operators.filters import BadRequest
from varloom.operators.ordering import shared_folder
from varloom.roles import Roles
from varloom.sources import export
from varloom.sources.sqlite import load_sqlite
from varloom.streaming import ingest

# streaming


def test_a_batch_reads_no_earlier_rows(spark):
    """Twenty batches; before the last one all data that were stored are taken away, and its repeats still go."""
    schema = "variant_id string, table_name string, gene string, start string, end string"
    base = f"{shared_folder(spark)}/t-{uuid4().hex}"
    folder, target, marks = f"{base}/in", f"{base}/out", f"{base}/marks"

    def stream():
        return ingest.variant_stream(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)

    def arrive(data):
        export.write_delimited(spark.createDataFrame(data, schema).coalesce(1), folder, mode="append")

    for k in range(19):
        arrive([(f"v{k}", "a", f"G{k}", "1", "2"), (f"v{k}", "a", f"F{k}", "1", "2"), (f"v{k - 1}", "a", "late", "1", "2"), (None, "a", f"N{k}", "1", "2")])
    ingest.ingest_available(stream(), target, marks)
    got = sorted((r["variant_id"] or "", r["gene"]) for r in ingest.ingested(spark, target, stream().schema).collect())
    seen = {v for v, _ in got}
    assert len(got) == len(seen) == 21 and {f"v{k}" for k in range(-1, 19)} | {""} == seen
    shutil.move(target, f"{base}/away")
    arrive([("v3", "a", "again", "1", "2"), ("v3", "b", "other", "1", "2"), ("v19", "a", "new", "1", "2"), (None, "a", "again", "1", "2")])
    ingest.ingest_available(stream(), target, marks)
    assert rows(ingest.ingested(spark, target, stream().schema), "variant_id", "table_name", "gene") == [("v19", "a", "new"), ("v3", "b", "other")]


# graph


def _walk_by_hand(pairs, start, hops):
    """First shortest path to each gene within so many edges."""
    links = {}
    for a, b in pairs:
        if a is not None and b is not None:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    found, frontier = {start: [start]}, [[start]]
    for _ in range(hops):
        step = sorted(p + [n] for p in frontier for n in links.get(p[-1], ()))
        frontier = []
        for p in step:
            if p[-1] not in found:
                found[p[-1]] = p
                frontier.append(p)
    return found


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_walks_equal_breadth_first_search(spark, hops):
    rng = random.Random(hops)
    pairs = [(f"g{rng.randrange(60)}", f"g{rng.randrange(60)}") for _ in range(75)]
    pairs += [("hub", f"g{k}") for k in range(12)] + [(None, "g1"), ("g1", None), ("g5", "g5")] + pairs[:10]
    edges = spark.createDataFrame([(a, b, "x", 0.5) for a, b in pairs], "gene_a string, gene_b string, interaction_type string, confidence_score double")
    sources, targets = ["g1", "hub", "g7", "nowhere"], ["g2", "g1", "g33", "g50", "hub", "g59"]
    walks = {s: _walk_by_hand(pairs, s, hops) for s in sources}
    want = sorted((s, t, walks[s][t]) for s, t in product(sources, targets) if s != t and t in walks[s])
    found = graph.shortest_paths(edges, sources, targets, hops)
    got = sorted((r["source_gene"], r["target_gene"], r["path"]) for r in found.collect())
    assert got == want
    assert all(r["path_length"] == len(r["path"]) - 1 and r["intermediate_genes"] == r["path"][1:-1] for r in found.collect())
    near = {(r["gene"], r["distance"]) for r in graph.neighbours(edges, ["g1", "hub"], hops).collect()}
    least = {}
    for s in ("g1", "hub"):
        for g, p in walks[s].items():
            least[g] = min(least.get(g, 9), len(p) - 1)
    assert near == {(g, d) for g, d in least.items() if d}


def test_plan_of_a_walk_is_linear_in_hops(spark):
    edges = spark.range(200).selectExpr("cast(id AS string) AS gene_a", "cast(id * 7 % 200 AS string) AS gene_b")
    size = [len(graph.shortest_paths(edges, ["1"], ["50"], k)._jdf.queryExecution().optimizedPlan().toString()) for k in (1, 2, 3)]
    assert size[2] - size[1] < 2 * max(size[1] - size[0], 2000)


# contains search


@pytest.fixture(scope="module")
def searched(spark):
    rng = random.Random(6)
    words = ["Missense_Mutation", "Silent", "frame", "FRAME_Shift", "abcabc", "aBc", "x", "", "50%", "a\\b", "İstanbul", "STRASSE", None]
    data = [(str(i), rng.choice(words), rng.choice(words), rng.randrange(3000), rng.random() < 0.5, "not searched Silent") for i in range(800)]
    df = spark.createDataFrame(data, "id string, a string, b string, n int, flag boolean, other string")
    path = export.fresh_path(df, "dictionary")
    dictionary.write_dictionary(df, ["a", "b", "n", "flag"], path)
    return df, path


@pytest.mark.parametrize("term", ["silent", "ENSE_mut", "ab", "abc", "12", "129", "rame%ift", "a_c", "0%", "tru", "\\", "stanb", "nothing at all", "  ", "%", "İst"])
@pytest.mark.parametrize("listed", [1000, 1])
def test_dictionary_search_equals_free_text(searched, monkeypatch, term, listed):
    df, path = searched
    monkeypatch.setattr(dictionary, "LISTED", listed)
    columns = ["a", "b", "n", "flag"]
    got, want = dictionary.free_text(df, path, term, columns), flt.free_text(df, term, columns)
    assert got.columns == df.columns and rows(got, "id") == rows(want, "id")


def test_dictionary_terms(searched):
    df, path = searched
    for mode, terms in product(("any", "all"), (["silent", "frame"], ["abc", "12", ""], [" "])):
        got, want = (f(df, *more, mode) for f, more in ((dictionary.free_text_terms, (path, terms, ["a", "n"])), (flt.free_text_terms, (terms, ["a", "n"]))))
        assert rows(got, "id") == rows(want, "id")
    with pytest.raises(BadRequest):
        dictionary.free_text_terms(df, path, ["x"], ["a"], "some")


def test_few_matches_reach_the_scan(searched, spark):
    df, path = searched
    where = export.fresh_path(df, "table")
    df.write.parquet(where)
    plan = dictionary.free_text(spark.read.parquet(where), path, "missense", ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Missense_Mutation" in plan.split("PushedFilters")[1]


# sketches


def test_merged_sketches_equal_the_sketch_of_the_union(spark):
    df = spark.range(40_000).selectExpr(
        "concat('c', id % 3) AS table_name", "CASE WHEN id % 10 > 0 THEN concat('s', id % 9000) END AS sample", "id % 2 AS g", "id % 700 AS n"
    )
    parts = sketches.distinct_sketches(df, ["sample", "n"])
    assert parts.count() == 3 and sketches.distinct_sketches(df, ["n"], ["g"]).count() == 6
    one = df.withColumn("table_name", F.lit("all"))
    got = sketches.approximate_totals(parts, ["sample", "n"])
    # a sketch that was never merged is read by a sharper estimator; twice the same has the same registers without it
    whole = sketches.distinct_sketches(one, ["sample", "n"])
    twice = sketches.approximate_totals(whole.unionByName(whole), ["sample", "n"])
    assert rows(got, "sample", "n") == rows(twice, "sample", "n") and got.first()["rows"] == 40_000
    for r in sketches.approximate_totals(parts, ["sample"], ["c0", "c2"]).collect():
        exact = df.filter("table_name <> 'c1'").agg(F.countDistinct("sample").alias("n"), F.count(F.lit(1)).alias("rows")).first()
        assert abs(r["sample"] - exact["n"]) <= 0.03 * exact["n"] and r["rows"] == exact["rows"]
    assert sketches.approximate_totals(parts, ["sample"], ["none"]).first()["rows"] is None
    with pytest.raises(BadRequest):
        sketches.distinct_sketches(df, ["sample"], log_registers=3)
    assert sketches.distinct_sketches(df.withColumnRenamed("table_name", "t"), ["n"], roles=Roles(cohort="t")).count() == 3


# SQLite


def test_sqlite_table_is_read_by_ranges(spark, tmp_path):
    path = str(tmp_path / "small.db")
    data = [(i, f"G{i % 7}", i / 3, None if i % 5 else b"x", f"2020-01-{i % 28 + 1:02d}") for i in range(1, 2001) if i % 11]
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "mut""s" (id INTEGER PRIMARY KEY, gene VARCHAR(20), "the score" REAL, raw BLOB, day DATE)')
        db.executemany('INSERT INTO "mut""s" VALUES (?, ?, ?, ?, ?)', data)
        db.execute("CREATE TABLE odd (n INTEGER, t TEXT)")
        db.executemany("INSERT INTO odd VALUES (?, ?)", [("text", 5), (None, None), (3, "x"), (2.5, b"b")])
        db.execute("CREATE TABLE none (n INTEGER)")
    db.close()
    df = load_sqlite(spark, path, 'mut"s', partitions=4)
    assert df.dtypes == [("id", "bigint"), ("gene", "string"), ("the score", "double"), ("raw", "binary"), ("day", "string")]
    assert df.rdd.getNumPartitions() == 4
    assert sorted((r[0], r[1], r[2], bytes(r[3]) if r[3] is not None else None, r[4]) for r in df.collect()) == data
    per_task = df.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == 4 and max(r["count"] for r in per_task) < 500
    odd = [tuple(r) for r in load_sqlite(spark, path, "odd", partitions=9).collect()]
    assert sorted(odd, key=str) == sorted([(None, "5"), (None, None), (3, "x"), (2, "b")], key=str)
    assert load_sqlite(spark, path, "none").count() == 0
    with pytest.raises(Exception, match="not found"):
        load_sqlite(spark, path, "missing").count()
