from __future__ import annotations

import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from varloom.operators import aggregate as agg
from varloom.operators import filters as flt
from varloom.operators import ordering, regions, search
from varloom.operators.filters import BadRequest
from varloom.roles import Roles, UnknownColumns

ROWS = [
    ("v1", "TP53", "chr17", 7577538, 7577538, "Missense_Mutation", 1.0),
    ("v2", "tp53", "17", 7577000, 7577200, "Silent", None),
    ("v3", None, "chrX", 100, 105, None, float("inf")),
    ("v4", "BR\\CA_1", "CHR17", 99995888, 99995890, "Nonsense_Mutation", float("-inf")),
    ("v5", "KRAS", "chr12", 100004880, 100004880, "Missense_Mutation", float("nan")),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(
        ROWS, "variant_id string, gene string, chrom string, start bigint, end bigint, variant_class string, score double"
    )


def ids(frame):
    return [r[0] for r in rows(frame, "variant_id")]


@pytest.mark.parametrize(
    ("op", "value", "expected"),
    [
        ("eq", "TP53", ["v1"]),
        ("eq", None, ["v3"]),
        ("neq", None, ["v1", "v2", "v4", "v5"]),
        ("neq", "TP53", ["v2", "v4", "v5"]),
        ("in", "TP53", ["v1"]),
        ("in", ["TP53", "KRAS"], ["v1", "v5"]),
        ("not_in", ["TP53"], ["v2", "v4", "v5"]),
        ("like", "tp5", ["v1", "v2"]),
        ("like", "\\c", ["v4"]),
        ("like", "T%3", ["v1", "v2"]),
    ],
)
def test_operators(df, op, value, expected):
    assert ids(flt.apply(df, {"column": "gene", "operator": op, "value": value})) == expected


def test_tree_and_empty_tree(df):
    tree = {
        "logic": "OR",
        "conditions": [
            {"conditions": [{"column": "gene", "value": "TP53"}, {"column": "start", "operator": "gt", "value": 5}]},
            {"column": "start", "operator": "lte", "value": 100},
        ],
    }
    assert ids(flt.apply(df, tree)) == ["v1", "v3"]
    assert flt.apply(df, {"conditions": []}).count() == 5
    assert flt.apply(df, None).count() == 5


def test_unknown_names(df):
    with pytest.raises(UnknownColumns):
        flt.apply(df, {"column": "nope", "value": 1})
    assert flt.apply(df, {"column": "nope", "value": 1}, strict=False).count() == 5
    with pytest.raises(BadRequest):
        flt.apply(df, {"column": "gene", "operator": "regex", "value": "x"})
    assert ids(flt.apply(df, {"column": "gene", "operator": "regex", "value": "KRAS"}, strict=False)) == ["v5"]


def test_unknown_request_keys_are_rejected_q27(df):
    with pytest.raises(BadRequest):
        regions.in_regions(df, [{"chromosome": "17", "position": 5}])
    with pytest.raises(BadRequest):
        flt.apply(df, {"conditions": [], "operator": "AND"})


def test_positions_sort_as_numbers_q1(df):
    assert [r[0] for r in ordering.sort(df, "start", ["variant_id"]).collect()] == ["v3", "v2", "v1", "v4", "v5"]


def test_regions(df):
    hit = [{"chromosome": "chr17", "start": 7577100, "end": 7577538}]
    assert ids(regions.in_regions(df, hit)) == ["v1", "v2"]
    assert ids(regions.in_regions(df, [{"chromosome": "17", "start": 7577538}])) == ["v1"]
    assert ids(regions.in_regions(df, hit, Roles(end=None))) == ["v1"]
    with pytest.raises(BadRequest):
        regions.in_regions(df, [{"chromosome": "17", "start": 10, "end": 9}])


def test_region_table_equals_list(spark):
    import random

    random.seed(3)
    data = []
    for i in range(400):
        s = random.choice([65535, 65536, 131071, random.randint(1, 400000)])
        data.append((f"v{i:03d}", random.choice(["chr1", "2"]), s, s + random.choice([0, 1, 3, 70000])))
    df = spark.createDataFrame(data, "variant_id string, chrom string, start bigint, end bigint")
    wanted = [
        {"chromosome": random.choice(["1", "chr2"]), "start": s, "end": s + random.choice([0, 10, 90000])}
        for s in (random.randint(1, 400000) for _ in range(15))
    ]
    table = spark.createDataFrame([(r["chromosome"], r["start"], r["end"]) for r in wanted], "chromosome string, start bigint, end bigint")
    assert rows(regions.in_region_table(df, table)) == rows(regions.in_regions(df, wanted))


def test_pathway_semi_join_does_not_multiply_q9(spark, df):
    assoc = spark.createDataFrame([("TP53", "a"), ("TP53", "b"), ("KRAS", "b"), ("TP53", "a")], "gene string, pathway_id string")
    names = spark.createDataFrame([("a", "Repair"), ("b", "Growth")], "id string, pathway_name string")
    assert ids(regions.in_pathways(df, assoc, ids=["a", "b"])) == ["v1", "v5"]
    assert ids(regions.in_pathways(df, assoc, names, names=["Repair"], ids=["b"])) == ["v1"]
    assert ids(regions.in_pathways(df, assoc, names, names=["row"], match="contains")) == ["v1", "v5"]


def test_numbers_are_normalised(df):
    got = {r["variant_id"]: r["score"] for r in flt.normalise_numbers(df).collect()}
    assert got["v3"] == 999.0 and got["v4"] == -999.0
    assert got["v2"] != got["v2"] and got["v5"] != got["v5"]


def test_free_text_and_blank_terms(df):
    assert ids(flt.free_text(df, "757")) == ["v1", "v2"]
    assert flt.free_text(df, "  ").count() == 5
    with pytest.raises(UnknownColumns):
        flt.free_text(df, "x", ["nope"])


def test_paging(spark):
    df = spark.range(1000).selectExpr("id AS variant_id", "id % 3 AS g")
    second = search.search(df, sort_by="g", page=2, page_size=5).collect()
    assert [int(r["variant_id"]) for r in second] == [15, 18, 21, 24, 27]
    assert search.search(df, page=1000, page_size=60).count() == 0
    with pytest.raises(BadRequest):
        ordering.page(df, 0, 10, None, ["variant_id"])
    with pytest.raises(UnknownColumns):
        ordering.page(df, 1, 10, "nope", ["variant_id"])


def test_pages_are_in_order(spark):
    df = spark.range(500).selectExpr("(id * 7919) % 500 AS variant_id", "CASE WHEN id % 5 > 0 THEN id % 2 END AS g", "id AS other")
    got = [r["variant_id"] for r in ordering.page(df, 5, 20, "g", ["variant_id"], descending=True).collect()]
    want = sorted(df.collect(), key=lambda r: (r["g"] is None, -(r["g"] or 0), r["variant_id"]))[80:100]
    assert got == [r["variant_id"] for r in want]


@pytest.mark.parametrize("descending", [False, True])
def test_deep_pages_equal_the_sort(spark, descending):
    """Pages beyond the top-k are counted out by range: hot and null sort values, several columns, ends of the table."""
    kinds = "id string, g int, d double, t timestamp, b boolean"
    df = spark.range(6000).selectExpr(
        "cast((id * 7919) % 6000 AS string) AS id", "CASE WHEN id % 3 > 0 THEN 7 WHEN id % 5 > 0 THEN cast(id % 11 AS int) END AS g",
        "CASE WHEN id % 4 = 0 THEN double('NaN') ELSE id / 7 - 300 END AS d",
        "timestamp_seconds(id % 97) AS t", "CASE WHEN id % 7 > 1 THEN id % 2 = 0 END AS b",
    )
    assert kinds == ", ".join(f"{n} {k}" for n, k in df.dtypes)
    for by, key in (("g", ["id"]), ("d", ["t", "id"]), ("b", ["id"]), ("id", ["id"]), (None, ["t", "b", "id"])):
        names = list(dict.fromkeys([*([by] if by else []), *key]))
        order = [F.col(n).desc() if n == by and descending else F.col(n).asc() for n in names]
        want = [r["id"] for r in df.orderBy(*order).collect()]
        for number in (1, 7, 31, 120):
            found = ordering.page(df, number, 50, by, key, descending, early=100)
            assert [r["id"] for r in found.collect()] == want[(number - 1) * 50 : number * 50]
    assert ordering.page(df, 121, 50, "g", ["id"], early=100).count() == 0
    assert ordering.page(df.limit(0), 9, 50, "g", ["id"], early=100).count() == 0


def test_early_page_is_a_top_k(spark):
    df = spark.range(500).selectExpr("id AS variant_id", "id % 3 AS g")
    plan = ordering.page(df, 3, 60, "g", ["variant_id"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "ExistingRDD" not in plan


def test_region_table_keeps_repeated_and_null_ids(spark):
    from varloom.operators import regions

    rows_ = [("a", "1", 4090, 4100), (None, "1", 4095, 4096), (None, "1", 4095, 4096), ("a", "1", 4000, 8200), ("b", "1", 4097, 4097), ("b", "1", 4097, 4097)]
    rows_ += [("c", "1", None, 5), ("c", "1", 5, None), ("d", None, 4097, 4097), ("e", "2", 4097, 4097), ("f", "1", 9000, 4000), ("g", "1", 1, 2**40)]
    df = spark.createDataFrame(rows_, "variant_id string, chrom string, start bigint, end bigint")
    one = spark.createDataFrame([("chr1", 4096, 4097)], "chromosome string, start bigint, end bigint")
    got = regions.in_region_table(df, one)
    assert Counter(map(tuple, got.collect())) == Counter([*rows_[:6], rows_[11]])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan.split("LeftSemi")[0] and "Aggregate" not in plan.split("LeftSemi")[0]
    assert regions.in_region_table(df, one.limit(0)).count() == 0


def test_large_top_per_group_is_cut_in_subgroups(spark):
    df = spark.range(9000).selectExpr("id", "id % 2 AS g", "(id * 31) % 9000 AS v")
    out = ordering.top_per_group(df, ["g"], 1500, [F.col("v").asc()])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") >= 2 and "_salt" in plan
    got = sorted((r["g"], r["v"]) for r in out.collect())
    by = {g: sorted(r["v"] for r in df.collect() if r["g"] == g)[:1500] for g in (0, 1)}
    assert got == sorted((g, v) for g, vs in by.items() for v in vs)


def test_region_table_of_all_widths(spark):
    from varloom.operators import regions

    rng = random.Random(8)
    rows = [(f"v{i}", rng.choice(["chr1", "1", "chrX"]), s := rng.randrange(1, 6_000_000), s + rng.choice([0, 0, 3, 9000, 1_500_000])) for i in range(1500)]
    table = [("1", 2_000_000, 4_999_999), ("chr1", 3_000_000, 3_000_000), ("CHRX", 1_048_576, 2_097_151), ("x", 50, None), ("chrX", 5_000_000, 5_004_000)]
    df = spark.createDataFrame(rows, "variant_id string, chrom string, start bigint, end bigint")
    found = regions.in_region_table(df, spark.createDataFrame(table, "chromosome string, start bigint, end bigint"))
    plain = lambda c: c.upper().removeprefix("CHR")
    want = [v for v, c, s, e in rows if any(plain(c) == plain(d) and s <= (y or x) and e >= x for d, x, y in table)]
    got = [r["variant_id"] for r in found.collect()]
    assert sorted(got) == sorted(want) and 0 < len(want) < len(rows)
    assert found.columns == df.columns


def test_regions_reach_the_scan(spark, tmp_path):
    from varloom.operators import regions
    from varloom.sources import catalog

    df = spark.range(6000).selectExpr(
        "id AS variant_id", "'c' AS table_name", "concat('chr', id % 6 + 1) AS chrom", "id * 10 AS start", "id * 10 AS end"
    )
    path = str(tmp_path / "variants")
    catalog.write_variant_table(df, path, files=12)
    wanted = [{"chromosome": "chr2", "start": 100, "end": 900}, {"chromosome": "2", "start": 5000, "end": 6000}, {"chromosome": "CHR3", "start": 20}]
    found = regions.in_regions(spark.read.parquet(path), wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):].split("]\n")[0]
    assert "In(chrom" in pushed and "start" in pushed
    brute = [r["variant_id"] for r in df.collect() if any(
        r["chrom"][3:] == w["chromosome"].upper().removeprefix("CHR") and (
            r["start"] == w["start"] if "end" not in w else r["start"] <= w["end"] and r["end"] >= w["start"]) for w in wanted)]
    assert sorted(r["variant_id"] for r in found.collect()) == sorted(brute)
    assert regions.spellings("chrX") and set(regions.spellings("chrMT")) >= {"MT", "mt", "chrMt", "CHRmT"}
    assert regions.spellings("Un_KI270302v1") is None


def test_row_index_with_one_hot_value(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 7 ELSE id END AS v")
    order = [df["v"].asc(), df["id"].asc()]
    got = [(r["v"], r["id"]) for r in ordering.with_row_index(df, order).orderBy("row_index").collect()]
    assert got == sorted((r["v"], r["id"]) for r in df.collect())


def test_aggregate_checks(df):
    with pytest.raises(BadRequest):
        agg.aggregate(df, "gene", None, having={"operator": "gt", "value": 1})
    with pytest.raises(BadRequest):
        agg.aggregate(df, "gene", ["chrom"], "percentage", percentage_by=["gene"])
    with pytest.raises(BadRequest):
        agg.aggregate(df, "gene", ["chrom"], limit=0)
    with pytest.raises(BadRequest):
        agg.aggregate(df, "gene", ["chrom"], order_by="start")
    with pytest.raises(BadRequest):
        agg.aggregate(df, "gene", ["chrom"], having={"conditions": []})


def test_having_uses_the_unrounded_percentage_q12(spark):
    df = spark.createDataFrame([("a",)] * 1 + [("b",)] * 2, "g string")
    out = agg.aggregate(df, "g", ["g"], "percentage", having={"operator": "gt", "value": 33.33})
    assert rows(out, "g", "aggregated_value") == [("a", 33.33), ("b", 66.67)]


def test_percentage_denominators_differ(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", None), ("a", "y", 1), ("b", "y", 1)], "g string, h string, v int")
    whole = agg.aggregate(df, "v", ["g", "h"], "percentage")
    assert rows(whole, "g", "h", "aggregated_value", "group_total") == [
        ("a", "x", 25.0, 4), ("a", "y", 25.0, 4), ("b", "y", 25.0, 4)
    ]
    part = agg.aggregate(df, "v", ["g", "h"], "percentage", percentage_by=["g"])
    assert rows(part, "g", "h", "aggregated_value", "group_total") == [
        ("a", "x", 50.0, 2), ("a", "y", 50.0, 2), ("b", "y", 100.0, 1)
    ]
    one = agg.aggregate(df, "v", None, "percentage", filters={"column": "h", "value": "y"})
    assert rows(one) == [(66.67,)]


def test_null_group_keys_keep_their_total(spark):
    df = spark.createDataFrame([(None, "x"), (None, "y"), ("a", "x")], "g string, h string")
    out = agg.aggregate(df, "h", ["g", "h"], "percentage", percentage_by=["g"])
    got = {(r["g"], r["h"]): (r["aggregated_value"], r["group_total"]) for r in out.collect()}
    assert got == {(None, "x"): (50.0, 2), (None, "y"): (50.0, 2), ("a", "x"): (100.0, 1)}


def test_combination_concat_keeps_separators_of_nulls(spark):
    df = spark.createDataFrame([("a", None, "c")], "a string, b string, c string")
    out = agg.combination_aggregate(
        df, "a", ["a", "b", "c"], computed=[{"name": "label", "columns": ["a", "b", "c"], "separator": "|"}]
    )
    assert out.first()["label"] == "a||c"
    with pytest.raises(BadRequest):
        agg.combination_aggregate(df, "a", ["a"], computed=[{"name": "no name", "columns": ["a"]}])
