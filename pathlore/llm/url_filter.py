"""URL filter: hashed host-suffix and path-prefix expressions joined with a rule list.

Every URL is expanded into the expressions a rule could be stored under (host suffixes by label,
path prefixes that end in a slash, no deeper than the deepest rule). Expressions meet the rules on
the first 32 bits of their SHA-256; the full digest and the full rule path are then confirmed, and
the longest rule wins. Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/ ? #``, A-Z in lower case; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """Text between host and ``? #``; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _rule_keys(rules: DataFrame) -> DataFrame:
    """Each rule with the expression it is stored under: its host and its path up to the last slash."""
    host = F.translate(F.col("host"), UPPER, LOWER)
    stem = F.regexp_extract("r_path", r"(?s)^(.*/)?", 1)
    return (
        rules.where("host is not null and path is not null and verdict is not null and host <> ''")
        .groupBy(host.alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.max("verdict").alias("r_verdict"))  # 'block' > 'allow'
        .select(
            "*",
            F.concat("r_host", "r_path").alias("r_rule"),
            F.sha2(F.concat("r_host", stem), 256).alias("r_digest"),
            F.size(F.split("r_host", r"\.")).alias("labels"),
            (F.length(stem) - F.length(F.replace(stem, F.lit("/")))).alias("slashes"),
        )
    )


def filter_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", salts: int = 32
) -> DataFrame:
    """One row (``id_col``, host, path, rule, verdict) per row of ``pages``.

    ``rules`` has host, path and verdict (``allow`` or ``block``). A rule fits its host and all
    subdomains where the URL's path starts with the rule's path. The longest rule text wins, then
    the longer host; of equal rules with both verdicts ``block`` wins. Without a rule the verdict
    is ``default`` and ``rule`` is null. Null ids and URLs are kept, a null URL or one without
    ``://`` has empty host and path; repeated rows are judged once and given back as often as they
    came; other columns of ``pages`` are not read.

    Rows are counted per (id, URL) before the shuffle, so a repeated page costs one row. The rules
    are copied to ``salts`` slices of each hash prefix, so a rule that a third of all URLs meet
    is met in ``salts`` tasks if the rule list is too long for Spark to broadcast.
    """
    keyed = _rule_keys(rules)
    deepest = keyed.agg(F.max("labels"), F.max("slashes")).first()
    labels_most, slashes_most = deepest[0] or 1, deepest[1] or 0
    urls = (
        pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
        .groupBy("_id", "_url")
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumns({"host": url_host(F.col("_url")), "path": url_path(F.col("_url"))})
    )
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(labels_most))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), ".")
    )
    parts = F.split("path", "/")
    slashes = F.least(F.size(parts) - 1, F.lit(slashes_most))
    prefixes = F.transform(
        F.sequence(F.lit(0), slashes),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))),
    )
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    expanded = (
        urls.withColumn("_expression", F.explode(expressions))
        .withColumn("digest", F.sha2("_expression", 256))
        .withColumns({"prefix": F.substring("digest", 1, 8), "salt": F.pmod(F.xxhash64("_id", "_url"), F.lit(salts)).cast("int")})
    )
    sliced = keyed.select(
        "r_host", "r_path", "r_verdict", "r_rule", "r_digest",
        F.substring("r_digest", 1, 8).alias("r_prefix"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("r_salt"),
    )
    met = expanded.join(
        sliced,
        (F.col("prefix") == F.col("r_prefix"))
        & (F.col("salt") == F.col("r_salt"))
        & (F.col("digest") == F.col("r_digest"))
        & F.startswith("path", "r_path"),
        "left",
    )
    best = F.struct(F.length("r_rule").alias("a"), F.length("r_host").alias("b"), F.col("r_rule").alias("rule"), F.col("r_verdict").alias("verdict"))
    return (
        met.groupBy("_id", "_url", "_copies", "host", "path")
        .agg(F.max(F.when(F.col("r_rule").isNotNull(), best)).alias("best"))
        .select(
            F.col("_id").alias(id_col), "host", "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
            F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy"),
        )
        .drop("_copy")
    )
