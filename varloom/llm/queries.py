"""Registered corpus queries, one for each operator, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import bpe, imatch, katz, merkle, mixing, pii, quality, simhash, topk, toxicity, turns, urls, warc
from varloom.llm.common import held_out, table

QUERIES = {}
ORACLES = {}

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fetch date of the pages, which have none.
FETCHED = "2024-01-01T00:00:00Z"
#: Stands for the caller's secret.
KEY = "key of the registered query"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out("doc_id", 7, 2)
    found = katz.scores(docs, ~out)
    return found.withColumn("held_out", out)


@query
def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encoding_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@query
def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, KEY, changed="n_replaced")


@query
def op2_crf_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out("doc_id", 5, 0)
    model = quality.train(docs, table(spark, sf_dir, "labels"), usable=~out)
    found = quality.scored(docs, model).select("doc_id", out.alias("held_out"), "score")
    return found.withColumn("predicted", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0))


#: (host, path, verdict) of the registered query.
RULES = (
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
)


@query
def op7_hashed_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op7_hashed_url_rules"] = r"""
WITH parsed AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    max_by(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parsed) p
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path
"""


@query
def op8_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    found = mixing.copies(docs)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return found.select("doc_id", "size", "source_size", "target", taken, "copies")


@query
def op10_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


ORACLES["op10_kd_tree_top_k"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op6_imatch_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.edited_likeness(docs, imatch.lexicon(docs))


@query
def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.derivatives(warc.responses(pages, FETCHED))


@query
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repaired(turns.damaged(table(spark, sf_dir, "conversations")))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    changed = F.when(merkle.tampered(F.col("doc_id")), merkle.leaf(text=merkle.lowered(F.col("text")))).otherwise(merkle.leaf())
    return merkle.manifest(docs, changed)


def _manifest_sql(source_levels: int = 5, root_levels: int = 3) -> str:
    """The manifest with a fixed number of levels, for sources of pos most 16 ** source_levels rows."""
    one = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"
    fields = [one.format(f"CAST({c} AS VARCHAR)") for c in merkle.FIELDS[:-1]]
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce(list_concat([xor(a, c)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))"
    chars = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    crc = f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {chars}), lambda a, c: {bits}))"
    parts = [f"""
leaves AS (
  SELECT doc_id, source, sha256({" || ".join([*fields, one.format("text")])}) AS leaf,
    CASE WHEN ({crc}) % 5 = 0 THEN sha256({" || ".join([*fields, one.format(lowered)])}) END AS changed
  FROM documents
), sources AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) AS n FROM documents GROUP BY source
), placed AS (
  SELECT l.*, s.tree, s.n, row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaves l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source
), a0 AS (SELECT tree, pos, leaf AS hash, n FROM placed)"""]

    def climb(name: str, levels: int) -> None:
        for k in range(levels):
            parts.append(f"""{name}{k + 1} AS (
  SELECT tree, pos // 16 AS pos, CASE WHEN n > 1 THEN sha256(string_agg(hash, '' ORDER BY pos)) ELSE min(hash) END AS hash, CAST(ceil(n / 16) AS BIGINT) AS n
  FROM {name}{k} GROUP BY tree, pos // 16, n)""")

    climb("a", source_levels)
    parts.append(f"b0 AS (SELECT 0 AS tree, tree AS pos, hash, (SELECT count(*) FROM sources) AS n FROM a{source_levels})")
    climb("b", root_levels)
    steps = [("a", k, "p.tree", f"p.pos // {16**k}") for k in range(source_levels)] + [("b", k, "0", f"p.tree // {16**k}") for k in range(root_levels)]
    parts.append(f"""p0 AS (
  SELECT p.*, s.hash AS subroot, r.hash AS root, '' AS proof, coalesce(p.changed, p.leaf) AS folded
  FROM placed p JOIN a{source_levels} s ON s.tree = p.tree JOIN b{root_levels} r ON r.tree = 0)""")
    for i, (name, k, tree, pos) in enumerate(steps):
        parts.append(f"""r{i} AS (SELECT tree, pos // 16 AS run, any_value(n) AS size, list(hash ORDER BY pos) AS run_hashes FROM {name}{k} GROUP BY tree, pos // 16),
p{i + 1} AS (
  SELECT p.* EXCLUDE (proof, folded),
    CASE WHEN size > 1 THEN proof || array_to_string(run_hashes[1:{pos} % 16], '') || array_to_string(run_hashes[{pos} % 16 + 2:], '') ELSE proof END AS proof,
    CASE WHEN size > 1 THEN sha256(array_to_string(run_hashes[1:{pos} % 16], '') || folded || array_to_string(run_hashes[{pos} % 16 + 2:], '')) ELSE folded END AS folded
  FROM p{i} p JOIN r{i} r ON r.tree = {tree} AND r.run = ({pos}) // 16)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM p{len(steps)}"""


ORACLES["op12_merkle_manifest"] = _manifest_sql()


@query
def op13_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out("doc_id", 5, 0)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~out)
    found = toxicity.scored(docs, model).select("doc_id", out.alias("held_out"), "score")
    return found.withColumn("predicted", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0))
