from __future__ import annotations

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from varloom.functions import genomics, stats
from varloom.operators import compare, cooccurrence, pathway, position, signature
from varloom.operators import matrix as mx
from varloom.roles import Roles


def exact_p(a, b, c, d):
    r, k, n = a + b, a + c, a + b + c + d
    total = math.comb(n, k)
    weight = {i: math.comb(r, i) * math.comb(n - r, k - i) for i in range(max(0, k - (n - r)), min(r, k) + 1)}
    limit = weight[a] + weight[a] // 10**7
    two = sum(w for w in weight.values() if w <= limit)
    return two / total, sum(w for i, w in weight.items() if i >= a) / total


def test_fisher_matches_integer_arithmetic(spark):
    random.seed(5)
    tables = [(0, 0, 0, 0), (0, 5, 5, 0), (5, 0, 0, 5), (3, 1, 1, 3), (1, 9, 11, 3), (200, 300, 250, 900), (0, 400, 500, 2000)]
    tables += [tuple(random.randint(0, 40) for _ in range(4)) for _ in range(60)]
    df = spark.createDataFrame(tables, "a bigint, b bigint, c bigint, d bigint").distinct()
    cells = [F.col(x) for x in "abcd"]
    out = df.select("*", stats.fisher_two_sided(*cells).alias("two"), stats.fisher_greater(*cells).alias("up"))
    for r in out.collect():
        two, up = exact_p(r["a"], r["b"], r["c"], r["d"])
        assert r["two"] == pytest.approx(two, rel=1e-9, abs=1e-300)
        assert r["up"] == pytest.approx(up, rel=1e-9, abs=1e-12)


def test_fisher_on_large_tables_and_negative_cells(spark):
    df = spark.createDataFrame([(20000, 180000, 30000, 770000), (19, 999981, 31, 8999969), (-1, 3, 4, 5)], "a bigint, b bigint, c bigint, d bigint")
    cells = [F.col(x) for x in "abcd"]
    got = [r["p"] for r in df.select(stats.fisher_two_sided(*cells).alias("p")).collect()]
    assert got[0] == 0.0 or got[0] < 1e-300
    assert got[1] == pytest.approx(exact_tail(19, 1000000, 50, 10000000), rel=1e-6)
    assert got[2] == 1.0


def test_fisher_far_from_the_mean(spark):
    """The equally rare terms of the other tail have to be found too."""
    tables = [(100, 9900, 99900, 890100), (250, 9750, 99750, 890250), (1480, 8520, 98520, 891480), (0, 500, 60, 1500)]
    df = spark.createDataFrame(tables, "a bigint, b bigint, c bigint, d bigint")
    cells = [F.col(x) for x in "abcd"]
    for r in df.select("*", stats.fisher_two_sided(*cells).alias("p")).collect():
        want = exact_tail(r["a"], r["a"] + r["b"], r["a"] + r["c"], r["a"] + r["b"] + r["c"] + r["d"])
        assert r["p"] == pytest.approx(want, rel=1e-6)


def exact_tail(a, r, k, n):
    """Two-sided p by log-gamma, for a table too large for exact integers."""
    def lp(i):
        f = math.lgamma
        return f(r + 1) - f(i + 1) - f(r - i + 1) + f(n - r + 1) - f(k - i + 1) - f(n - r - k + i + 1) - (
            f(n + 1) - f(k + 1) - f(n - k + 1)
        )

    return sum(math.exp(lp(i)) for i in range(0, min(r, k) + 1) if lp(i) <= lp(a) + 1e-7)


def test_chi_square_p(spark):
    xs = [0.0, 1e-6, 0.3, 1.0, 3.84, 7.9, 8.1, 25.0, 400.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r["p"] for r in df.select(stats.chi_square_p_1df(F.col("x")).alias("p")).collect()]
    for x, p in zip(xs, got):
        assert p == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-8)


def test_log_factorial(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 7, 50, 10**6, 10**9)], "n bigint")
    for r in df.select("n", stats.log_factorial(F.col("n")).alias("v")).collect():
        assert r["v"] == pytest.approx(math.lgamma(r["n"] + 1), rel=1e-12, abs=1e-12)


def test_odds_ratio_limits(spark):
    df = spark.createDataFrame([(1, 0, 2, 3), (0, 0, 2, 3), (2, 3, 4, 6)], "a bigint, b bigint, c bigint, d bigint")
    got = [r[0] for r in df.select(stats.odds_ratio(*[F.col(x) for x in "abcd"])).collect()]
    assert got[0] == float("inf") and math.isnan(got[1]) and got[2] == 1.0


@pytest.fixture(scope="module")
def cells(spark):
    """One gene hit in every sample and one sample with every gene."""
    random.seed(2)
    data = {("HOT", f"s{i}") for i in range(60)} | {(f"g{i}", "s0") for i in range(25)}
    data |= {(f"g{random.randint(0, 24)}", f"s{random.randint(0, 59)}") for _ in range(200)}
    return sorted(data)


def test_comutation_counts(spark, cells):
    df = spark.createDataFrame(cells, "gene string, sample string")
    by_sample: dict[str, list[str]] = {}
    for g, s in cells:
        by_sample.setdefault(s, []).append(g)
    want = Counter(p for gs in by_sample.values() for p in combinations(sorted(gs), 2))
    got = {(r["gene1"], r["gene2"]): r["both"] for r in cooccurrence.comutation_counts(df).collect()}
    assert got == dict(want)


def test_comutation_of_frequent_and_rare_genes(spark):
    """Frequent genes go by bitmaps of several words, rare ones by sample; a hot sample has every gene."""
    rng = random.Random(3)
    rows_ = {(f"f{g}", f"s{s}") for g in range(6) for s in range(700) if rng.random() < 0.4}
    rows_ |= {(f"r{g}", f"s{rng.randrange(700)}") for g in range(40) for _ in range(4)}
    rows_ |= {(f"{k}{g}", "s0") for k, n in (("f", 6), ("r", 40)) for g in range(n)}
    by_sample: dict[str, list[str]] = {}
    for g, s in rows_:
        by_sample.setdefault(s, []).append(g)
    want = Counter(p for gs in by_sample.values() for p in combinations(sorted(gs), 2))
    df = spark.createDataFrame(sorted(rows_), "gene string, sample string")
    found = cooccurrence.comutation_counts(df)
    assert {(r["gene1"], r["gene2"]): r["both"] for r in found.collect()} == dict(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    words = cooccurrence.sample_words(df, F.lit(700)).collect()
    assert max(bin(r["bits"] & (2**64 - 1)).count("1") for r in words) > 1 and len({(r["bucket"], r["word"]) for r in words}) > 10
    assert cooccurrence.comutation_counts(df.limit(0)).count() == 0


def test_rare_pairs_go_as_lists(spark):
    """Names with the marks of the list, null genes and samples, and a shuffle without a row a pair."""
    names = ["a,b", "a%2Cb", "", "%", ",", "ü", None, "z"]
    rows_ = [(g, f"s{s}") for s in range(3) for g in names[: 8 - s]] + [("z", None)] + [(f"n{i}", f"t{i}") for i in range(700)]
    df = spark.createDataFrame(rows_, "gene string, sample string")
    known = [[g for g in names[: 8 - s] if g is not None] for s in range(3)]
    want = Counter(p for gs in known for p in combinations(sorted(gs), 2))
    found = cooccurrence.comutation_counts(df)
    assert {(r["gene1"], r["gene2"]): r["both"] for r in found.collect()} == dict(want)
    split = spark.createDataFrame([(["b", "c"], ["a"])], "rare array<string>, often array<string>")
    counted = cooccurrence._rare_counts(split)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "ENSURE_REQUIREMENTS" not in plan
    assert sorted(map(tuple, counted.collect())) == [("a", "b", 1), ("a", "c", 1), ("b", "c", 1)]


def test_numbered_names_travel_packed(spark):
    """Names that a stem and a number make take their numbers' bits; all others, and pairs with these, are counted as well."""
    rng = random.Random(11)
    names = [f"G{rng.randrange(10 ** rng.randrange(1, 16))}" for _ in range(60)] + ["G0", "G00", "G07", "G7", "G-7", "G 7", "G+7", "G"]
    names += ["G1125899906842624", "G99999999999999999999", "g7", "7", "H12", "H13", "TP53", "G12,", "ü9"]
    names = sorted(set(names))
    by_sample = {f"s{s}": rng.sample(names, rng.choice([1, 2, 3, 20, 60])) for s in range(40)}
    by_sample |= {f"t{s}": [f"G{s}", "G7", "TP53"] for s in range(300)}  # two frequent genes
    by_sample |= {f"u{s}": [f"u{s}"] for s in range(400)}
    want = Counter(p for gs in by_sample.values() for p in combinations(sorted(set(gs)), 2))
    df = spark.createDataFrame([(g, s) for s, gs in by_sample.items() for g in gs], "gene string, sample string")
    found = cooccurrence.comutation_counts(df).collect()
    assert len(found) == len(want) and {(r["gene1"], r["gene2"]): r["both"] for r in found} == dict(want)


def test_many_pairs_are_sent_by_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "SENT", 40)
    lists = [([f"{k}{n}" for k in ("G", "x,") for n in range(s, s + 9)], ["G100", "often"]) for s in range(30)]
    want = Counter(tuple(sorted(p)) for rare, often in lists for p in [*combinations(rare, 2), *((r, o) for r in rare for o in often)])
    split = spark.createDataFrame(lists, "rare array<string>, often array<string>").coalesce(1)
    counted = cooccurrence._rare_counts(split)
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [rare_numbers") >= 2
    found = counted.collect()
    assert len(found) == len(want) and {(r["gene1"], r["gene2"]): r["both"] for r in found} == dict(want)


def test_bytes_of_packed_pairs(spark):
    """Four bytes a pair at most for numbers below ten millions, which took nine as text."""
    rng = random.Random(5)
    lists = [([f"G{n}" for n in rng.sample(range(10**6, 10**7), 60)], []) for _ in range(20)]
    split = spark.createDataFrame(lists, "rare array<string>, often array<string>")
    assert cooccurrence._common_stem(split) == "G"
    numbers = F.transform("rare", lambda g: F.substring(g, 2, 9).cast("bigint"))
    parted = split.select(numbers.alias("rare_numbers"), F.expr("array_repeat(0L, 0)").alias("often_numbers"))
    sent = cooccurrence._numbers_sent(parted).agg(F.expr("sum(size(codes) * 8 + 8)")).first()[0]
    assert sent <= 4 * 20 * 60 * 59 / 2
    assert "split(" not in cooccurrence._rare_counts(split)._jdf.queryExecution().optimizedPlan().toString()


def test_all_pairs(spark):
    genes = spark.createDataFrame([(f"g{i:02d}",) for i in range(30)] * 2, "gene string")
    assert rows(cooccurrence.all_pairs(genes, 4)) == list(combinations([f"g{i:02d}" for i in range(30)], 2))


def test_heatmap_is_canonical_q19(spark):
    pairs = spark.createDataFrame([("B", "A", 3.0, 0.5), ("C", "B", 2.0, 4.0)], "gene1 string, gene2 string, neg_log10_pval double, odds_ratio double")
    assert rows(cooccurrence.interaction_heatmap(pairs, ["C", "A", "B"])) == [("A", "B", -3.0), ("A", "C", 0.0), ("B", "C", 2.0)]


def read_hotspots(positions, width, least):
    """The rule as it is written down."""
    pos, out, i = sorted(positions), [], 0
    while i < len(pos):
        inside = [p for p in pos[i:] if p <= pos[i] + width - 1]
        if len(inside) >= least:
            out.append((pos[i], pos[i] + width - 1, sum(inside) // len(inside), len(inside)))
            i += len(inside)
        else:
            i += 1
    return out


def test_greedy_hotspots(spark):
    random.seed(4)
    genes = {f"G{k}": [random.randint(1, 120) for _ in range(random.randint(1, 60))] for k in range(40)}
    genes["HOT"] = [50] * 500 + [random.randint(1, 300) for _ in range(200)]
    data = [(f"{g}-{i}", g, f"p.A{p}T") for g, ps in genes.items() for i, p in enumerate(ps)]
    data.append(("none", "G0", "splice"))
    df = spark.createDataFrame(data, "variant_id string, gene string, protein_change string")
    for width, least in ((5, 3), (10, 4), (1, 2)):
        out = position.greedy_hotspots(df, width, least)
        got = rows(out, "gene", "hotspot_start", "hotspot_end", "hotspot_center", "mutation_count")
        assert got == sorted((g, *h) for g, ps in genes.items() for h in read_hotspots(ps, width, least))


def test_sliding_windows(spark):
    random.seed(6)
    data = [("chr1", random.choice([99, 100, 101, random.randint(1, 700)])) for _ in range(400)]
    df = spark.createDataFrame(data, "chrom string, start bigint")
    got = rows(position.sliding_windows(df, 30, 5, chunk=50), "window_start", "mutation_count")
    want = []
    for p in sorted({p for _, p in data}):
        n = sum(p <= q < p + 30 for _, q in data)
        if n >= 5:
            want.append((p, n))
    assert got == want


def test_domains_and_fallback_label(spark):
    v = spark.createDataFrame(
        [("1", "A", "p.R5K"), ("2", "A", "p.R50K"), ("3", "B", "p.R5K"), ("4", "A", None)],
        "variant_id string, gene string, protein_change string",
    )
    d = spark.createDataFrame(
        [("A", "D2", None, 1, 9), ("A", "D1", "First", 1, 5)],
        "gene string, domain_id string, domain_name string, domain_start bigint, domain_end bigint",
    )
    assert rows(position.map_to_domains(v, d), "variant_id", "domain_name") == [
        ("1", "First"), ("2", "Intradomain/Unknown"), ("3", "Intradomain/Unknown")
    ]


def test_channels_cover_all_pyrimidine_contexts_q7():
    names = genomics.all_channels()
    assert len(names) == len(set(names)) == 96
    assert "T>C_ATG" in names and "C>T_ACG" in names


def test_channel_of_both_strands(spark):
    df = spark.createDataFrame(
        [("C", "T", "ACG"), ("G", "A", "CGT"), ("A", "G", "CAT"), ("C", "T", "AAG"), ("CC", "T", "ACG"), ("C", "C", "ACG"), ("c", "t", "acg"), ("C", "T", None)],
        "ref_allele string, tumor_seq_allele2 string, trinucleotide_context string",
    )
    got = [r[0] for r in df.select(genomics.channel("ref_allele", "tumor_seq_allele2", "trinucleotide_context")).collect()]
    assert got == ["C>T_ACG", "C>T_ACG", "T>C_ATG", None, None, None, "C>T_ACG", None]
    prof = {r["channel"]: r["mutation_count"] for r in signature.profile(df).collect()}
    assert len(prof) == 96 and prof["C>T_ACG"] == 3 and prof["T>C_ATG"] == 1 and sum(prof.values()) == 4


def test_reverse_complement(spark):
    df = spark.createDataFrame([("acgx",)], "s string")
    assert df.select(genomics.reverse_complement("s")).first()[0] == "NCGT"


def test_empty_profile_is_zero(spark):
    df = spark.createDataFrame([], "ref_allele string, tumor_seq_allele2 string, trinucleotide_context string")
    prof = signature.profile(df)
    assert prof.count() == 96 and prof.filter("frequency <> 0 OR mutation_count <> 0").count() == 0


def test_mutation_unit_reproduces_p_one_q14(spark):
    data = [("v1", "a", "s1", "G"), ("v2", "a", "s1", "G"), ("v3", "b", "s2", "G"), ("v4", "b", "s3", "H")]
    df = spark.createDataFrame(data, "variant_id string, dataset string, tumor_sample_barcode string, gene string")
    got = {r["gene"]: r["p_value"] for r in compare.gene_frequencies(df, ["a", "b"], "fisher_exact", "mutations").collect()}
    assert got["G"] == 1.0
    sample = compare.gene_frequencies(df, ["a", "b"], "fisher_exact")
    assert {r["gene"]: r["p_value"] for r in sample.collect()}["G"] == pytest.approx(1.0)


def test_overlap_falls_back_without_alleles_q15(spark):
    data = [("v1", "a", "chr1", 5, "A", None, "G"), ("v2", "b", "chr1", 5, None, None, "G"), ("v3", "b", "chr1", 5, "A", "T", "G")]
    df = spark.createDataFrame(
        data, "variant_id string, dataset string, chrom string, start bigint, ref_allele string, tumor_seq_allele2 string, gene string"
    )
    out = compare.variant_overlap(df)
    assert rows(out, "variant_key", "dataset_count", "is_shared") == [("chr1:5", 2, True), ("chr1:5:A:T", 1, False)]


def test_enrichment_clamps_the_last_cell(spark):
    assoc = spark.createDataFrame([(f"g{i}", "p") for i in range(5)], "gene string, pathway_id string")
    paths = spark.createDataFrame([("p", "Path")], "id string, pathway_name string")
    background = spark.createDataFrame([("g0",), ("g1",)], "gene string")
    r = pathway.enrichment(background, assoc, paths, ["g0", "g9"]).first()
    assert (r["genes_in_input"], r["total_genes_in_pathway"]) == (1, 5)
    assert r["p_value"] == pytest.approx(exact_p(1, 1, 4, 0)[1])


def test_waterfall_order(spark):
    data = [("s1", "A", 1), ("s1", "B", 0), ("s2", "A", 0), ("s2", "B", 4), ("s3", "A", 5), ("s3", "B", 9), ("s4", "A", 0), ("s4", "B", 0), ("s5", "A", 1)]
    cells = spark.createDataFrame([(g, s, c, "x" if c else "") for s, g, c in data], "gene string, tumor_sample_barcode string, code int, annotation string")
    # A has 2 unaltered cells, B has 2: order by name, so B is compared first
    axis = {r["tumor_sample_barcode"]: r["sample_index"] for r in mx.sample_axis(cells, ["A", "B"]).collect()}
    assert sorted(axis, key=axis.get) == ["s3", "s2", "s1", "s5", "s4"]


def test_alteration_category(spark):
    df = spark.createDataFrame([("Splice_Site",), ("Splice_Region",), (None,), ("In_Frame_Del",)], "c string")
    got = [r[0] for r in df.select(genomics.alteration_category("c")).collect()]
    assert got == ["truncating", "splice_site", "mutation", "inframe"]


def test_roles_are_columns_of_the_callers_table(spark):
    df = spark.createDataFrame([("x", "s"), ("y", "s")], "symbol string, patient string")
    roles = Roles(gene="symbol", sample="patient")
    assert rows(cooccurrence.samples_with_genes(df, ["x", "y"], roles=roles)) == [("s", 2)]


def test_wide_matrix_shuffles_cells_by_sample(spark, sf):
    """The cells of a sample meet in one task: after the rows are dealt by sample nothing is shuffled again."""
    from varloom.registry import matrices

    plan = matrices._wide(spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = plan[: plan.index("Exchange hashpartitioning(tumor_sample_barcode")]
    assert "Exchange" not in dealt
