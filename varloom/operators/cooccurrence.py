"""Gene pairs: co-mutation counts, Fisher tests, heat-map cells.

Counting samples that share two genes is a product of the sample x gene
incidence with itself.  Genes that are mutated in many samples are counted on
bitmaps: samples are numbered, a gene's samples are 64 to a word, and a pair is
the number of bits that two words share.  A pair with a rare gene is met sample
by sample, which emits no more rows than there are shared samples to count.
All of it are joins and aggregates of built-in expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varloom.functions import stats
from varloom.operators.ordering import shuffles_dropped, stored
from varloom.roles import Roles, col

#: Samples to a word, and how many a hash bucket that is numbered gets on average.
WORD, BUCKET = 64, 48
#: Pairs that a task counts at a time.
PAIRS = 1_000_000
#: Pairs that a task sends to these; what it sends is sorted in memory, and would be on disk twice if it did not fit.
SENT = 50_000_000


def gene_cells(df: DataFrame, genes: Sequence[str] | None = None, roles: Roles = Roles()) -> DataFrame:
    """Distinct (gene, sample) with a mutation."""
    rows = df if genes is None else df.filter(col(roles.gene).isin(list(genes)))
    cells = rows.select(col(roles.gene).alias("gene"), col(roles.sample).alias("sample"))
    return cells.filter(F.col("gene").isNotNull() & F.col("sample").isNotNull()).distinct()


def _block(name: str, blocks: int):
    return F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")


def _pair_blocks(own, blocks: int):
    """All block pairs that a gene of block ``own`` takes part in."""
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    return F.transform(
        others, lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"))
    )


def sample_words(cells: DataFrame, total: Column) -> DataFrame:
    """(bucket, word, gene and whatever else belongs to a gene, bits): a gene's samples as bitmaps of 64 numbered samples.

    Samples are numbered inside hash buckets, of which there are so many that one holds
    less than a word on average; what a bucket has beyond that goes to a next word.
    """
    own = [c for c in cells.columns if c != "sample"]
    lists = cells.groupBy("sample").agg(F.collect_list(F.struct(*[col(c) for c in own])).alias("genes"))
    return _words(lists, total, own)


def _words(lists: DataFrame, total: Column, own: Sequence[str]) -> DataFrame:
    """The words of (sample, genes), where genes is a list of structs of ``own``: one shuffle of a row a sample."""
    buckets = F.greatest(F.ceil(total / F.lit(BUCKET)), F.lit(1))
    placed = lists.withColumn("bucket", F.pmod(F.xxhash64("sample"), buckets))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("sample")) - 1
    numbered = placed.withColumn("place", place)
    rows = numbered.select("bucket", F.floor(F.col("place") / WORD).alias("word"), "place", F.inline("genes"))
    bit = F.expr(f"shiftleft(1L, place % {WORD})")
    return rows.groupBy("bucket", "word", *[col(c) for c in own]).agg(F.bit_or(bit).alias("bits"))


def comutation_counts(cells: DataFrame) -> DataFrame:
    """Samples mutated in both genes, for every pair that shares a sample."""
    return _shared_counts(_sample_lists(cells))


def _sample_lists(cells: DataFrame) -> DataFrame:
    """(sample, genes): the sorted genes of each sample, written once to the shared folder.

    Everything below reads them several times; they are smaller than the rows they come from.
    """
    known = cells.filter(F.col("sample").isNotNull())
    lists = known.groupBy("sample").agg(F.array_sort(F.collect_set("gene")).alias("genes"))
    return stored(lists, "sample-genes")


def _margins(lists: DataFrame) -> DataFrame:
    """(gene, m): the samples of each gene."""
    return lists.select(F.explode("genes").alias("gene")).groupBy("gene").agg(F.count(F.lit(1)).alias("m"))


def _total(lists: DataFrame) -> Column:
    return lists.agg(F.count(F.lit(1))).scalar()


def _shared_counts(lists: DataFrame) -> DataFrame:
    """(gene1, gene2, both): the samples of both genes, for every pair that shares one.

    A gene is frequent if a word holds one of its samples on average; there are at most
    ``WORD`` times as many as a sample has genes on average.  Then words have fewer pairs
    than samples have; for rare genes they would have more.  A rare gene is met sample by
    sample: its partners there go to the task of the gene as one list, which takes a
    fraction of what a row a pair would, and are counted in that task.
    """
    total = _total(lists)
    with shuffles_dropped(lists.sparkSession):  # once, as the genes' margins are a shuffle
        names = _margins(lists).filter(F.col("m") * WORD >= total).agg(F.to_json(F.collect_set("gene"))).first()[0]
    frequent = F.from_json(F.lit(names), lists.schema["genes"].dataType)
    split = lists.select(
        "sample", F.array_intersect("genes", frequent).alias("often"), F.array_except("genes", frequent).alias("rare")
    )
    listed = split.select("sample", F.transform("often", lambda g: F.struct(g.alias("gene"))).alias("genes"))
    words = _words(listed.filter(F.size("genes") > 1), total, ["gene"])

    def side(k: int) -> DataFrame:
        return words.select("bucket", "word", F.col("gene").alias(f"gene{k}"), F.col("bits").alias(f"bits{k}"))

    shared = F.bit_count(F.col("bits1").bitwiseAND(F.col("bits2")))
    dense = side(1).join(side(2), ["bucket", "word"]).filter(F.col("gene1") < F.col("gene2"))
    dense = dense.select("gene1", "gene2", shared.alias("n")).filter("n > 0")
    dense = dense.groupBy("gene1", "gene2").agg(F.sum("n").alias("both"))
    return dense.unionByName(_rare_counts(split))


def _rare_counts(split: DataFrame) -> DataFrame:
    """(gene1, gene2, both) of the pairs with a rare gene; a gene of ``rare`` meets what precedes it there and all of ``often``.

    Names that are the most common stem and a number travel as packed numbers, others as text.
    """
    stem = _common_stem(split)

    def parts(name: str) -> list[Column]:
        # a number is what follows the stem, if both give the name again
        coded = F.transform(name, lambda g: F.struct(g.alias("gene"), F.substring(g, len(stem) + 1, 15).try_cast("bigint").alias("n")))

        def whole(c: Column) -> Column:
            return F.coalesce((c["n"] >= 0) & (F.concat(F.lit(stem), c["n"].cast("string")) == c["gene"]), F.lit(False))

        texts = F.filter(coded, lambda c: ~whole(c))
        return [F.filter(coded, whole)["n"].alias(f"{name}_numbers"), texts["gene"].alias(f"{name}_texts")]

    def size(name: str) -> Column:
        return F.size(name).cast("bigint")

    parted = stored(split.select(*parts("rare"), *parts("often")), "sample-numbers")
    n, t, on, ot = (size(c) for c in ("rare_numbers", "rare_texts", "often_numbers", "often_texts"))
    found = parted.agg(F.sum(n * (n - 1) / 2 + n * on), F.sum(t * (t - 1) / 2 + t * (n + on + ot) + n * ot)).first()
    packed, plain = (int(x or 0) for x in found)
    counts = []
    if packed or not plain:
        met = _numbers_sent(_dealt(parted, packed)).repartition(packed // PAIRS + 1, "x")
        seen = _numbers_met(met).groupBy("x", "y").agg(F.count(F.lit(1)).alias("both"))
        counts.append(seen.select(*[F.concat(F.lit(stem), F.col(c).cast("string")).alias(c) for c in "xy"], "both"))
    if plain:
        met = _texts_sent(_dealt(parted, plain), stem).repartition(plain // PAIRS + 1, "x")
        each = met.select("x", F.explode(F.split("others", ",")).alias("y"))
        seen = each.groupBy("x", "y").agg(F.count(F.lit(1)).alias("both"))
        counts.append(seen.select(_named(F.col("x")).alias("x"), _named(F.col("y")).alias("y"), "both"))
    both = counts[0] if len(counts) == 1 else counts[0].unionByName(counts[1])
    return both.select(F.least("x", "y").alias("gene1"), F.greatest("x", "y").alias("gene2"), "both")


def _common_stem(split: DataFrame) -> str:
    """What most of the names that end in a number begin with; any answer gives the same counts."""
    genes = split.select(F.explode("rare").alias("gene"))
    digits = F.substring("gene", F.length(F.rtrim("gene", F.lit("0123456789"))) + 1, F.length("gene"))
    number = F.length(F.ltrim(digits, F.lit("0")))
    stems = genes.filter(number > 0).select(F.substring("gene", F.lit(1), F.length("gene") - number).alias("stem"))
    with shuffles_dropped(split.sparkSession):
        first = stems.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "stem").first()
    return first["stem"] if first else ""


def _dealt(rows: DataFrame, pairs: int) -> DataFrame:
    """The rows over so many tasks that one has about ``SENT`` pairs.  No list is frequent, as its rare genes are not."""
    if pairs <= SENT:
        return rows
    tasks = max(pairs // SENT + 1, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.filter(F.size("rare_numbers") + F.size("rare_texts") > 0).repartition(tasks, "rare_numbers", "rare_texts")


def _numbers_sent(parted: DataFrame) -> DataFrame:
    """(x, codes): a rare gene's number and those of the genes it meets in a sample, as many bits each as the sample needs.

    A sample's numbers, less the smallest, are packed once into words of 64 bits; what a
    gene meets are the first of them.  The first code holds the smallest number, the
    bits of a number and the number of places that are left over.
    """
    rows = parted.filter(F.size("rare_numbers") + F.size("often_numbers") > 1).filter(F.size("rare_numbers") > 0)
    rows = rows.select("rare_numbers", F.size("often_numbers").alias("often"), F.concat("often_numbers", "rare_numbers").alias("numbers"))
    rows = rows.withColumn("base", F.array_min("numbers")).withColumn("width", F.length(F.bin(F.array_max("numbers") - F.col("base"))))
    packed = F.expr("""transform(sequence(0, (size(numbers) * width - 1) div 64), i ->
        aggregate(sequence(cast(i * 64 div width as int), cast(least((i * 64 + 63) div width, size(numbers) - 1) as int)), 0L, (word, j) ->
            word | if(j * width >= i * 64, shiftleft(numbers[j] - base, cast(j * width - i * 64 as int)),
                shiftright(numbers[j] - base, cast(i * 64 - j * width as int)))))""")
    rows = rows.select("rare_numbers", "often", "base", "width", packed.alias("words"))
    each = rows.select("often", "base", "width", "words", F.posexplode("rare_numbers").alias("i", "x"))
    each = each.withColumn("n", F.col("often") + F.col("i")).filter("n > 0")
    each = each.withColumn("held", F.expr("cast((n * width + 63) div 64 as int)"))
    head = F.expr("shiftleft(base, 12) | shiftleft(cast(width as bigint), 6) | (held * 64 div width - n)")
    return each.select("x", F.concat(F.array(head), F.slice("words", F.lit(1), F.col("held"))).alias("codes"))


def _numbers_met(sent: DataFrame) -> DataFrame:
    """(x, y) with a row for each number that was sent."""
    head = F.expr("codes[0]")
    rows = sent.select(
        "x", "codes", F.shiftright(head, 12).alias("base"), F.expr("cast(shiftright(codes[0], 6) & 63 as int)").alias("width"),
        F.expr("cast(codes[0] & 63 as int)").alias("left"),
    )
    last = F.expr("cast((size(codes) - 1) * 64 div width - left - 1 as int)")
    each = rows.select("x", "codes", "base", "width", F.explode(F.sequence(F.lit(0), last)).alias("j"))
    each = each.withColumn("k", F.expr("shiftright(j * width, 6) + 1")).withColumn("r", F.expr("(j * width) & 63"))
    low = "shiftrightunsigned(codes[k], r)"
    over = "if(r + width > 64, shiftleft(codes[k + 1], 64 - r), 0L)"
    return each.select("x", F.expr(f"base + (({low} | {over}) & (shiftleft(1L, width) - 1))").alias("y"))


def _plain(g: Column) -> Column:
    """A name as an item of a list that commas divide."""
    return F.replace(F.replace(g, F.lit("%"), F.lit("%25")), F.lit(","), F.lit("%2C"))


def _named(g: Column) -> Column:
    return F.replace(F.replace(g, F.lit("%2C"), F.lit(",")), F.lit("%25"), F.lit("%"))


def _texts_sent(parted: DataFrame, stem: str) -> DataFrame:
    """(x, others): a rare gene and the genes it meets in a sample, where one of a pair at least has no number."""

    def names(numbers: str) -> Column:
        return F.transform(numbers, lambda n: _plain(F.concat(F.lit(stem), n.cast("string"))))

    rows = parted.select(
        F.transform("rare_texts", _plain).alias("rare"), F.transform("often_texts", _plain).alias("often"),
        names("rare_numbers").alias("numbered"), names("often_numbers").alias("often_numbered"),
    )
    each = rows.filter(F.size("rare") > 0).select("rare", "often", "numbered", "often_numbered", F.posexplode("rare").alias("i", "x"))
    rest = F.concat(F.slice("rare", F.lit(1), F.col("i")), "often", "numbered", "often_numbered")
    mixed = rows.filter(F.size("often") > 0).select(F.explode("numbered").alias("x"), F.col("often").alias("rest"))
    sent = each.select("x", rest.alias("rest")).unionByName(mixed).filter(F.size("rest") > 0)
    return sent.select("x", F.array_join("rest", ",").alias("others"))


def all_pairs(genes: DataFrame, blocks: int = 16) -> DataFrame:
    """Every pair gene1 < gene2 of a gene list, by block of genes.

    The result is quadratic in the number of distinct genes by definition, not
    in the number of variants.
    """
    names = genes.select("gene").distinct().withColumn("own", _block("gene", blocks))
    spread = names.select("gene", "own", F.inline(_pair_blocks(F.col("own"), blocks)))
    left = spread.filter(F.col("own") == F.col("i")).select("i", "j", F.col("gene").alias("left"))
    right = spread.filter(F.col("own") == F.col("j")).select("i", "j", F.col("gene").alias("right"))
    pairs = left.join(right, ["i", "j"])
    wanted = (F.col("i") != F.col("j")) | (F.col("left") < F.col("right"))
    return pairs.filter(wanted).select(
        F.least("left", "right").alias("gene1"), F.greatest("left", "right").alias("gene2")
    )


def pair_tables(cells: DataFrame, unobserved: bool = False) -> DataFrame:
    """2x2 table (a both, b first only, c second only, d neither) per pair.

    ``unobserved`` adds the pairs that never share a sample.
    """
    lists = _sample_lists(cells)
    counts, margin = _shared_counts(lists), _margins(lists)
    if unobserved:
        counts = all_pairs(margin).join(counts, ["gene1", "gene2"], "left").fillna(0, ["both"])
    first = margin.select(F.col("gene").alias("gene1"), F.col("m").alias("n1"))
    second = margin.select(F.col("gene").alias("gene2"), F.col("m").alias("n2"))
    joined = counts.join(first, "gene1").join(second, "gene2").withColumn("total", _total(lists))
    a = F.col("both")
    return joined.select(
        "gene1",
        "gene2",
        a.alias("a"),
        (F.col("n1") - a).alias("b"),
        (F.col("n2") - a).alias("c"),
        (F.col("total") - F.col("n1") - F.col("n2") + a).alias("d"),
    )


def pairwise_fisher(
    df: DataFrame,
    genes: Sequence[str] | None = None,
    unobserved: bool = False,
    roles: Roles = Roles(),
) -> DataFrame:
    """Two-sided Fisher test of co-mutation for the gene pairs that share a sample.

    ``unobserved`` adds all other pairs, whose number is the square of that of the genes.
    """
    tables = pair_tables(gene_cells(df, genes, roles), unobserved)
    cells = [F.col(x) for x in "abcd"]
    out = tables.select(
        "gene1", "gene2", stats.fisher_two_sided(*cells).alias("p_value"), stats.odds_ratio(*cells).alias("odds_ratio")
    )
    return out.withColumn("neg_log10_pval", stats.neg_log10(F.col("p_value")))


def mirrored(pairs: DataFrame) -> DataFrame:
    """A pair table and its copy with the genes swapped."""
    swap = {"gene1": "gene2", "gene2": "gene1"}
    return pairs.unionByName(pairs.select(*[col(swap.get(c, c)).alias(c) for c in pairs.columns]))


def gene_grid(df: DataFrame, genes: Sequence[str]) -> DataFrame:
    """Upper triangle over the caller's gene list in name order."""
    names = sorted(dict.fromkeys(genes))
    axis = F.array(*[F.lit(g) for g in names])
    rows = df.sparkSession.range(1).select(F.posexplode(axis).alias("y", "gene1")).repartition("gene1")
    return rows.select("gene1", F.explode(F.slice(axis, F.col("y") + 2, F.lit(len(names)))).alias("gene2"))


def interaction_heatmap(pairs: DataFrame, genes: Sequence[str]) -> DataFrame:
    """Signed score per pair of the list: largest -log10 p over both
    orientations, negative for an odds ratio below 1, 0 without a test."""
    wanted = pairs.filter(F.col("gene1").isin(list(genes)) & F.col("gene2").isin(list(genes)))
    best = wanted.select(
        F.least("gene1", "gene2").alias("gene1"),
        F.greatest("gene1", "gene2").alias("gene2"),
        "neg_log10_pval",
        "odds_ratio",
    )
    best = best.groupBy("gene1", "gene2").agg(
        # p = 0 has no finite score; 999 stands for it
        F.max(F.when(F.col("neg_log10_pval") == float("inf"), 999.0).otherwise(F.col("neg_log10_pval"))).alias("score"),
        F.min("odds_ratio").alias("odds"),
    )
    signed = F.when(F.col("odds") < 1, -F.col("score")).otherwise(F.col("score"))
    grid = gene_grid(pairs, genes)
    return grid.join(best, ["gene1", "gene2"], "left").select(
        "gene1", "gene2", F.coalesce(signed, F.lit(0.0)).alias("value")
    )


def samples_with_genes(
    df: DataFrame, genes: Sequence[str], at_least: int | None = None, roles: Roles = Roles()
) -> DataFrame:
    """Samples mutated in all, or in at least k, of the genes."""
    wanted = list(dict.fromkeys(genes))
    need = len(wanted) if at_least is None else at_least
    hit = df.filter(col(roles.gene).isin(wanted)).groupBy(col(roles.sample).alias("sample"))
    return hit.agg(F.countDistinct(col(roles.gene)).alias("gene_count")).filter(F.col("gene_count") >= need)


def samples_without_gene(df: DataFrame, gene: str, roles: Roles = Roles()) -> DataFrame:
    """Samples of the table that have no mutation in the gene."""
    everyone = df.select(col(roles.sample).alias("sample")).distinct()
    having = df.filter(col(roles.gene) == gene).select(col(roles.sample).alias("sample"))
    return everyone.join(having, "sample", "left_anti")


def exclusive_pairs(df: DataFrame, genes: Sequence[str] | None = None, roles: Roles = Roles()) -> DataFrame:
    """Gene pairs that no sample shares."""
    cells = gene_cells(df, genes, roles)
    lists = _sample_lists(cells)
    return all_pairs(_margins(lists)).join(_shared_counts(lists), ["gene1", "gene2"], "left_anti")
