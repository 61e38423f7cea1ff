"""URL filters by hashed expressions: host suffixes x path prefixes.

A rule names a host and a path; it fits its host and all subdomains where the
URL's path starts with the rule's.  Each distinct URL is expanded into all
suffixes of its host, joined with the prefixes of its path that have the length
of some rule's path.  An equality join on short hash prefixes finds candidate
rules, full digests confirm them, and the longest rule wins (then the longer host,
then block before allow).  A URL that no rule fits has the default verdict.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end,
A-Z in lower case; the path goes from there to ``?``, ``#`` or the end.  A null URL
and one without ``://`` have both empty.  Equal URLs are judged once, so a hot URL
meets only the last join; repeated rows and extra columns are no matter.  An empty
rule table gives every URL the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest that the join compares; four bytes.
SHORT = 8
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Array of host suffix + path prefix, for prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels) - i), ".")
    )
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.flatten(
        F.transform(suffixes, lambda s: F.transform(sizes, lambda n: F.concat(s, F.substring(path, F.lit(1), n))))
    )


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict (replacing columns of these names).

    ``rules`` has host, path and verdict (allow or block).
    """
    listed = rules.filter("host IS NOT NULL AND path IS NOT NULL").select(
        F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "verdict",
        F.length("path").alias("path_length"),
    ).withColumn("full", digest(F.col("rule"))).withColumn("short", F.substring("full", 1, SHORT))
    # lengths of paths, not paths: as many as the longest path has characters at most
    lengths = sorted(r[0] for r in listed.select("path_length").distinct().collect())
    address = F.col(f"`{url}`")
    kept = pages.select([F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")])
    parsed = kept.withColumn("host", host_of(address)).withColumn("path", path_of(address))
    if not lengths:
        return parsed.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    places = parsed.select("host", "path").distinct()
    probes = places.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("text"))
    probes = probes.select("host", "path", digest(F.col("text")).alias("full")).withColumn("short", F.substring("full", 1, SHORT))
    found = probes.join(listed.withColumnRenamed("full", "__full"), "short").filter(F.col("full") == F.col("__full"))
    order = F.struct(F.length("rule"), "host_length", F.col("verdict") == "block", "verdict", "rule")
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("__best"))
    best = best.select(F.col("host").alias("__host"), F.col("path").alias("__path"), "__best")
    out = parsed.join(best, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left")
    return out.withColumn("rule", F.col("__best.rule")).withColumn(
        "verdict", F.coalesce("__best.verdict", F.lit(default))
    ).drop("__host", "__path", "__best")
