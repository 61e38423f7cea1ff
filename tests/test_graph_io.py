from __future__ import annotations

import random
from collections import deque
from uuid import uuid4

import pytest
from conftest import rows
from pyspark.sql import functions as F

from varloom.functions import text
from varloom.operators import graph, sets, suggest
from varloom.operators.filters import BadRequest
from varloom.operators.ordering import shared_folder
from varloom.plans import reports, steps
from varloom.roles import UnknownTable
from varloom.sources import catalog, delimited, export, nested
from varloom.streaming import ingest


@pytest.fixture(scope="module")
def links():
    """A hub with a third of the edges, and random ones."""
    random.seed(9)
    out = [("hub", f"n{i}") for i in range(30)]
    out += [(f"n{random.randint(0, 39)}", f"m{random.randint(0, 39)}") for _ in range(50)]
    return out + [("n1", "n1"), ("hub", "n3")]


@pytest.fixture(scope="module")
def edges(spark, links):
    return spark.createDataFrame([(a, b, "x", 0.5) for a, b in links], "gene_a string, gene_b string, interaction_type string, confidence_score double")


def adjacency(links):
    adj: dict[str, set] = {}
    for a, b in links:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    return adj


def distances(links, starts, hops):
    adj, seen, queue = adjacency(links), {s: 0 for s in starts}, deque(starts)
    while queue:
        g = queue.popleft()
        if seen[g] < hops:
            for n in adj.get(g, ()):
                if n not in seen:
                    seen[n] = seen[g] + 1
                    queue.append(n)
    return {g: d for g, d in seen.items() if d}


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_neighbours(edges, links, hops):
    got = {r["gene"]: r["distance"] for r in graph.neighbours(edges, ["hub", "m5"], hops).collect()}
    assert got == distances(links, ["hub", "m5"], hops)


def test_shortest_paths_take_the_first_by_name_q18(edges, links):
    adj = adjacency(links)
    targets = [f"m{i}" for i in range(0, 40, 3)]
    got = {(r["source_gene"], r["target_gene"]): r["path"] for r in graph.shortest_paths(edges, ["hub", "m5"], targets, 3).collect()}
    want = {}
    for s in ("hub", "m5"):
        level = {s: [s]}
        seen = {s}
        for _ in range(3):
            nxt: dict[str, list] = {}
            for g, path in level.items():
                for n in adj.get(g, ()):
                    if n not in seen and (n not in nxt or path + [n] < nxt[n]):
                        nxt[n] = path + [n]
            seen |= set(nxt)
            want.update({(s, n): p for n, p in nxt.items() if n in targets})
            level = nxt
    assert got == want


def test_network_request_checks_q30(edges):
    with pytest.raises(BadRequest):
        reports.gene_network(edges, "shortest_path", ["hub"])
    with pytest.raises(BadRequest):
        reports.gene_network(edges, "neighbors", ["hub"], hops=4)
    with pytest.raises(BadRequest):
        reports.gene_network(edges, "subnetwork", ["hub"])


def test_partner_row_belongs_to_gene_a(spark):
    e = spark.createDataFrame([("A", "B", "x", 0.9)], "gene_a string, gene_b string, interaction_type string, confidence_score double")
    assert rows(graph.direct_partners(e, ["A", "B"]), "query_gene", "partner_gene") == [("A", "B")]


def test_set_operations(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "g string")
    b = spark.createDataFrame([("y",), ("z",)], "g string")
    assert rows(sets.combine([a, b], "UNION")) == [("x",), ("y",), ("z",)]
    assert rows(sets.combine([a, b], "INTERSECT")) == [("y",)]
    assert rows(sets.combine([a, b], "DIFFERENCE")) == [("x",)]
    with pytest.raises(BadRequest):
        sets.combine([a, b], "XOR")


def test_plan_rejects_steps_out_of_order(spark):
    df = spark.range(3)
    with pytest.raises(BadRequest):
        steps.run_plan(df, [{"step_id": "b", "tool": "aggregate", "restrict": {"a": "id"}, "params": {"column": "id"}}])


def test_delimited_round_trip_and_bad_positions(spark):
    df = spark.createDataFrame([("1", "10", "a"), ("2", "x", None), ("3", "100000000000", "")], "variant_id string, start string, gene string")
    path = f"{shared_folder(spark)}/t-{uuid4().hex}"
    export.write_delimited(df, path)
    back = delimited.typed_positions(delimited.read_delimited(spark, path, df.schema))
    assert rows(back, "variant_id", "start", "start_text") == [("1", 10, "10"), ("2", None, "x"), ("3", 100000000000, "100000000000")]


def test_unknown_table(spark):
    with pytest.raises(UnknownTable):
        catalog.table_by_name(spark, "no_such_table")


def test_cohort_filter_prunes_folders(spark):
    df = spark.range(100).selectExpr("id AS variant_id", "concat('c', id % 3) AS table_name", "'chr1' AS chrom", "id AS start")
    path = f"{shared_folder(spark)}/v-{uuid4().hex}"
    catalog.write_variant_table(df, path, files=3)
    one = spark.read.parquet(path).filter(F.col("table_name") == "c1")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(table_name" in plan and one.count() == 33


def test_literals_only_change_outside_quotes(spark):
    df = spark.createDataFrame([("""{'a': None, 'b': True, 'c': 'None or True', 'd': "it's False"}""",)], "structure string")
    r = df.select(nested.parse_literal("structure", "a string, b boolean, c string, d string").alias("s")).first()["s"]
    assert (r["a"], r["b"], r["c"], r["d"]) == (None, True, "None or True", "it's False")


def test_region_text(spark):
    data = [("chr1:915,188-1,015,188",), ("chrX:5",), ("7:10-20",), ("nonsense",)]
    df = spark.createDataFrame(data, "t string")
    out = df.select(text.region_chrom("t"), text.region_start("t"), text.region_end("t"))
    assert [tuple(r) for r in out.collect()] == [
        ("chr1", 915188, 1015188), ("chrX", 5, 5), ("chr7", 10, 20), (None, None, None)
    ]
    flags = [r[0] for r in spark.createDataFrame([("chr1:5",), ("CHRX:5-9",), ("chr123:5",), ("chr1:5-",)], "t string").select(text.is_region("t")).collect()]
    assert flags == [True, True, False, False]


def test_short_terms_are_refused(spark):
    with pytest.raises(BadRequest):
        suggest.genes(spark.createDataFrame([("A",)], "gene string"), "a")


def test_ingest_skips_what_is_stored_and_retries_cleanly(spark):
    schema = "variant_id string, table_name string, gene string, start string, end string"
    base = f"{shared_folder(spark)}/s-{uuid4().hex}"
    folder, target, marks = f"{base}/in", f"{base}/out", f"{base}/marks"

    def arrive(data):
        export.write_delimited(spark.createDataFrame(data, schema), folder, mode="append")

    def run():
        stream = ingest.variant_stream(spark, folder, spark.createDataFrame([], schema).schema)
        ingest.ingest_available(stream, target, marks, key=("table_name", "variant_id"))
        return rows(ingest.ingested(spark, target, stream.schema), "variant_id", "table_name", "start")

    arrive([("1", "a", "G", "5", "6"), ("1", "a", "G", "5", "6"), ("2", "b", "G", "x", "6")])
    assert run() == [("1", "a", 5), ("2", "b", None)]
    assert run() == [("1", "a", 5), ("2", "b", None)]
    arrive([("2", "b", "G", "7", "8"), ("3", "b", "G", "9", "9"), ("1", "c", "G", "5", "5")])
    assert run() == [("1", "a", 5), ("1", "c", 5), ("2", "b", None), ("3", "b", 9)]


def test_transcript_files(spark, tmp_path):
    lines = [
        '{"transcriptId": "T1", "hugoSymbols": ["A", "B"], "proteinLength": 7, "exons": [{"exonId": "E1", "exonStart": 5, "exonEnd": 9, "rank": 1, "strand": -1, "version": 2}]}',
        '{"transcriptId": "T2", "hugoSymbols": [], "pfamDomains": [{"pfamDomainId": "PF1", "pfamDomainStart": 1, "pfamDomainEnd": 3}, {"pfamDomainId": ""}]}',
    ]
    (tmp_path / "records.json").write_text("\n".join(lines))
    records = nested.read_transcripts(spark, str(tmp_path))
    assert rows(nested.transcript_table(records), "transcript_id", "gene_symbol", "protein_length") in (
        [("T1", "A", 7), ("T2", None, None)],
    )
    assert rows(nested.exon_table(records), "transcript_id", "exon_id", "start", "end") == [("T1", "E1", 5, 9)]
    assert rows(nested.domain_table(records), "transcript_id", "pfam_id") == [("T2", "PF1")]


def test_pairwise_report_has_observed_pairs(spark):
    data = [("v1", "A", "s1"), ("v2", "B", "s1"), ("v3", "A", "s2"), ("v4", "C", "s3"), ("v5", "B", "s2"), ("v6", "A", "s2")]
    df = spark.createDataFrame(data, "variant_id string, gene string, tumor_sample_barcode string")
    found = reports.pairwise_cooccurrence(df).collect()
    assert [(r["gene1"], r["gene2"]) for r in found] == [("A", "B")]
    assert found[0]["p_value"] == pytest.approx(1 / 3)


def test_delimited_files_may_be_packed(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1), ("", "b\tc", 2), (None, "x", 3)], "p string, q string, n int")
    for packed in ("none", "gzip"):
        export.write_delimited(df, str(tmp_path / packed), compression=packed)
    files = [f.name for f in (tmp_path / "gzip").iterdir() if f.name.startswith("part-")]
    assert files and all(f.endswith(".csv.gz") for f in files)
    plain, back = (delimited.read_delimited(spark, str(tmp_path / k), df.schema).collect() for k in ("none", "gzip"))
    assert sorted(plain, key=str) == sorted(back, key=str) and len(back) == 3


def test_state_keeps_two_batches(spark):
    """Old versions of the keys' state do not stay on disk, and what is kept is packed."""
    assert ingest.STATE_STORE["spark.sql.streaming.minBatchesToRetain"] == "2"
    assert ingest.STATE_STORE["spark.sql.streaming.stateStore.rocksdb.compression"] == "zstd"


def test_twenty_batches_of_several_packed_files(spark, tmp_path, monkeypatch):
    """A packed file is read by one task, so each of the twenty batches has several of them; no row is lost or added."""
    from varloom.registry import io

    n, sf, asked = 3000, tmp_path / "sf", {}
    line = spark.range(n).selectExpr(
        "id div 4 as l_orderkey", "cast(id % 4 + 1 as int) as l_linenumber", "id as l_partkey", "id % 7 as l_suppkey",
        "cast(id % 9 as double) as l_quantity", "'A' as l_returnflag", "'F' as l_linestatus",
    )
    line.write.parquet(str(sf / "lineitem.parquet"))
    spark.range(n // 4).selectExpr("id as o_orderkey", "id % 10 as o_custkey").write.parquet(str(sf / "orders.parquet"))
    spark.range(10).selectExpr("id as c_custkey", "'X' as c_mktsegment").write.parquet(str(sf / "customer.parquet"))
    stream = ingest.variant_stream
    monkeypatch.setattr(io.export, "fresh_path", lambda df, name: str(tmp_path / name))
    monkeypatch.setattr(ingest, "variant_stream", lambda *a, **named: asked.update(named) or stream(*a, **named))
    monkeypatch.setattr(ingest, "ingest_available", lambda *a, **named: None)
    monkeypatch.setattr(ingest, "ingested", lambda spark, target, schema: spark.createDataFrame([], schema))
    io.s1_batches(spark, str(sf))
    files = [f for f in (tmp_path / "arrivals").iterdir() if f.name.endswith(".csv.gz")]
    assert asked["files_per_batch"] >= 4 and len(files) == 20 * asked["files_per_batch"]
    back = delimited.read_delimited(spark, str(tmp_path / "arrivals"), io._FILE_SCHEMA).groupBy("variant_id").count()
    assert back.count() == n and back.filter("count <> 2").count() == 0


def test_state_looks_a_key_up_once():
    assert ingest.STATE_STORE["spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"] == "false"


def test_shuffle_files_of_a_batch_go(spark, tmp_path, monkeypatch):
    name, seen, first_seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], ingest.first_seen
    before = spark.conf.get(name, None)
    monkeypatch.setattr(ingest, "first_seen", lambda *a: seen.append(spark.conf.get(name, None)) or first_seen(*a))
    df = spark.createDataFrame([("1", "a", "G"), ("1", "a", "F")], "variant_id string, table_name string, gene string")
    export.write_delimited(df, str(tmp_path / "in"))
    ingest.ingest_available(ingest.variant_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), str(tmp_path / "marks"))
    assert seen == ["true"] and spark.conf.get(name, None) == before
    assert rows(ingest.ingested(spark, str(tmp_path / "out"), df.schema), *df.columns) == [("1", "a", "F")]
