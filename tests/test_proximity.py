"""Proximity against brute force, with one position that holds a third of all rows."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from varloom.operators import intervals
from varloom.operators import proximity as prox
from varloom.operators.filters import BadRequest
from varloom.operators.proximity import Reach
from varloom.roles import Roles


def test_blocks_tile_the_range(spark):
    random.seed(1)
    spans = [(a, a + w) for a in (0, 1, 7, 64, 1000) for w in (-1, 0, 1, 2, 31, 32, 33, 100)]
    df = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(spans)], "i int, low bigint, high bigint")
    got: dict[int, list[int]] = {}
    for r in intervals.cut_into_blocks(df, intervals.levels_for(101)).collect():
        start = r["block"] << r["level"]
        got.setdefault(r["i"], []).extend(range(start, start + (1 << r["level"])))
    for i, (lo, hi) in enumerate(spans):
        assert sorted(got.get(i, [])) == list(range(lo, hi + 1))


@pytest.fixture(scope="module")
def table(spark):
    random.seed(11)
    data = []
    for i in range(300):
        hot = i % 3 == 0
        chrom = "chr1" if hot else random.choice(["chr1", "chr2"])
        pos = 500 if hot else random.randint(430, 640)
        data.append((f"v{i:03d}", random.choice("AB"), chrom, str(pos), random.choice("xyz"), "SNP", None, None))
    data.append(("bad", "A", "chr1", "not a number", "x", "SNP", None, None))
    return spark.createDataFrame(
        data,
        "variant_id string, gene string, chrom string, start string, variant_class string, variant_type string, "
        "protein_change string, genome_change string",
    )


REACHES = [
    Reach(7),
    Reach(7, exclude_reference=False),
    Reach(2, unit="codon", direction="upstream"),
    Reach(40, "beyond"),
    Reach(1, "beyond", direction="downstream"),
    Reach(1, "exact", exclude_reference=False),
    Reach(9, "exact", direction="downstream"),
    Reach(5, "range", 8),
    Reach(6, same_gene=True),
    Reach(6, same_chromosome=False, exclude_reference=False),
]


def brute_pairs(data, reach):
    """(reference, query, distance) by the definition."""
    unit = {"bp": 1, "codon": 3}[reach.unit]
    d = reach.distance * unit
    for r in data:
        if r["variant_class"] != "x":
            continue
        for q in data:
            if reach.same_chromosome and q["chrom"] != r["chrom"]:
                continue
            if reach.same_gene and q["gene"] != r["gene"]:
                continue
            if reach.exclude_reference and q["start"] == r["start"]:
                continue
            step = q["start"] - r["start"]
            if reach.direction == "upstream" and step >= 0 or reach.direction == "downstream" and step <= 0:
                continue
            dist = abs(step)
            ok = {
                "within": dist <= d,
                "beyond": dist >= d,
                "exact": abs(dist - d) <= 1,
                "range": d <= dist <= (reach.max_distance or 0) * unit,
            }[reach.mode]
            if ok:
                yield r, q, dist


def plain(table):
    out = []
    for r in table.collect():
        if r["start"].isdigit():
            out.append({**r.asDict(), "start": int(r["start"])})
    return out


@pytest.mark.parametrize("reach", REACHES, ids=str)
def test_closest(table, reach):
    refs = table.filter("variant_class = 'x'")
    got = rows(prox.closest_hits(refs, table, reach), "chrom", "start", "distance_bp")
    best: dict[tuple, int] = {}
    for _, q, dist in brute_pairs(plain(table), reach):
        key = (q["chrom"], q["start"])
        best[key] = min(dist, best.get(key, dist))
    assert got == sorted((*k, v) for k, v in best.items())


@pytest.mark.parametrize("reach", [r for r in REACHES if not r.same_gene], ids=str)
def test_stats(table, reach):
    refs = table.filter("variant_class = 'x'")
    stats = prox.neighbour_stats(refs, table, reach)
    got = {
        (r["reference_chromosome"], r["reference_position"]): (
            r["nearby_count"], round(r["avg_distance"], 6), r["min_distance"], r["max_distance"]
        )
        for r in stats.collect()
    }
    seen: dict[tuple, dict] = {}
    for r, q, dist in brute_pairs(plain(table), reach):
        seen.setdefault((r["chrom"], r["start"]), {})[q["variant_id"]] = dist
    want = {k: (len(v), round(sum(v.values()) / len(v), 6), min(v.values()), max(v.values())) for k, v in seen.items()}
    assert got == want


@pytest.mark.parametrize("reach", [r for r in REACHES if not r.same_gene], ids=str)
@pytest.mark.parametrize(("by", "desc"), [(None, False), (None, True), ("gene", True)])
def test_nearest_k(table, reach, by, desc):
    refs = table.filter("variant_class = 'x'")
    hits = prox.nearby_per_reference(refs, table, reach, 4, by=by, descending=desc)
    got = rows(hits, "reference_chromosome", "reference_position", "variant_id")
    seen: dict[tuple, dict] = {}
    for r, q, dist in brute_pairs(plain(table), reach):
        seen.setdefault((r["chrom"], r["start"]), {})[q["variant_id"]] = (dist, q)
    want = []
    for key, found in seen.items():
        def order(item):
            lead = item[1][0] if by is None else -ord(item[1][1]["gene"])
            return (-lead if by is None and desc else lead, item[0])

        want += [(*key, vid) for vid, _ in sorted(found.items(), key=order)[:4]]
    assert got == sorted(want)


def test_having_zero_switches_off(spark):
    stats = spark.createDataFrame([(3, 10.0), (9, 2.0)], "nearby_count bigint, avg_distance double")
    assert prox.having(stats, min_nearby=0, max_avg=None).count() == 2
    assert prox.having(stats, min_nearby=5).count() == 1
    assert prox.having(stats, max_avg=5.0).count() == 1


def test_arguments_are_checked_together_q30():
    with pytest.raises(BadRequest):
        Reach(5, "range")
    with pytest.raises(BadRequest):
        Reach(0)
    with pytest.raises(BadRequest):
        Reach(5, "near")


def test_prefilter_keeps_every_hit(table):
    """The coarse check may only drop rows that cannot match."""
    near = prox._in_reach(
        table.select(F.col("chrom").alias("k_chrom"), F.col("start").try_cast("bigint").alias("pos")).dropna(),
        table.filter("variant_class = 'x'").select(F.col("chrom").alias("k_chrom"), F.col("start").try_cast("bigint").alias("pos")).dropna(),
        Reach(7),
    )
    kept = {(r["k_chrom"], r["pos"]) for r in near.collect()}
    for _, q, _ in brute_pairs(plain(table), Reach(7)):
        assert (q["chrom"], q["start"]) in kept


def test_many_nearest_choose_positions_first(spark):
    """More neighbours than travel with their blocks: equal distances, a hot position, null genes, both orders; no row is copied to every level."""
    rng = random.Random(7)
    spots = [rng.randrange(1, 400) for _ in range(700)] + [200] * 120
    data = [(f"v{i:04d}", "chr1" if i % 3 else "chr2", p, None if i % 7 == 0 else f"g{i % 3}") for i, p in enumerate(spots)]
    df = spark.createDataFrame(data, "variant_id string, chrom string, start_pos bigint, gene string")
    refs = df.filter("variant_id < 'v0020'")
    named = Roles(start="start_pos")
    places = {(c, p) for i, c, p, _ in data if i < "v0020"}
    for k, descending, zero in ((50, False, False), (90, False, True), (60, True, False)):
        reach = Reach(80, exclude_reference=not zero)
        got = prox.nearby_per_reference(refs, df, reach, k, descending=descending, roles=named)
        want = []
        for c, p in places:
            near = [(abs(q - p), i) for i, d, q, _ in data if d == c and (0 if zero else 1) <= abs(q - p) <= 80]
            near.sort(key=lambda x: (-x[0] if descending else x[0], x[1]))
            want += [(c, p, i, d) for d, i in near[:k]]
        assert rows(got, "reference_chromosome", "reference_position", "variant_id", "distance_bp") == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    spread = [line for line in plan.splitlines() if "posexplode" in line]
    assert spread and all("id#" not in line for line in spread)
