"""URL rules by hash prefixes of host-suffix and path-prefix expressions, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from guichet.llm.common import internal
from guichet.operators.settle import is_small, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Hex digits of the digest that expressions and rules are joined on.
PREFIX_DIGITS = 8
# Copies of a large rule table, so that an expression of a third of all urls is split.
SALTS = 16
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _folder(path: Column) -> Column:
    """The path up to its last slash, which is the part of a rule that urls are expanded to."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def _suffixes(host: Column, most: int) -> Column:
    """The host and its parents with at most ``most`` labels, as no rule has more."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(most))),
        lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."),
    )


def _prefixes(path: Column, most: int) -> Column:
    """The path's folders with at most ``most`` slashes, and the empty one."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(most))),
        lambda k: F.when(k == 0, F.lit("")).otherwise(
            F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))
        ),
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``.

    ``rules`` has ``verdict, host, path``; a rule fits its host and all below it when the url's
    path starts with its path. The longest rule wins, then the one with the longer host, then
    block. Without a fitting rule ``rule`` is null and the verdict is ``default``.

    Every distinct host and path is expanded once into host suffixes and folder prefixes, no
    deeper than any rule. They meet the rules on a short prefix of their digests; then the full
    digest and the start of the path are confirmed. A rule table that was counted and is small
    is broadcast, a larger one is joined by shuffle with salted expressions.

    A null url or one without ``://`` has an empty host and path and fits no rule. Repeated
    rows and null ids give a row each; other columns are ignored whatever their names; without
    rules or rows with a host or path set to null every page gets the default.
    """
    pages = internal(pages, id=id_col, url=url_col).select(
        "id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    rules = settle(
        internal(rules, verdict="verdict", rule_host="host", rule_path="path")
        .where("rule_host IS NOT NULL AND rule_path IS NOT NULL AND verdict IS NOT NULL")
        .distinct()
        .withColumn("rule_host", F.translate("rule_host", UPPER, LOWER))
        .withColumn("digest", F.sha2(F.concat_ws("\n", "rule_host", _folder(F.col("rule_path"))), 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    depth = rules.agg(
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.max(F.size(F.split("rule_path", "/")) - 1).alias("slashes"),
    ).first()

    places = pages.where("host <> '' OR path <> ''").select("host", "path").distinct()
    expressions = (
        places.withColumn("suffix", F.explode(_suffixes(F.col("host"), depth["labels"] or 1)))
        .withColumn("folder", F.explode(_prefixes(F.col("path"), depth["slashes"] or 0)))
        .select("host", "path", F.sha2(F.concat_ws("\n", "suffix", "folder"), 256).alias("expression"))
        .withColumn("prefix", F.substring("expression", 1, PREFIX_DIGITS))
    )
    if is_small(rules):
        met = expressions.join(F.broadcast(rules), "prefix")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = expressions.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(
            salted, ["prefix", "salt"]
        )
    winners = (
        met.where((F.col("expression") == F.col("digest")) & F.col("path").startswith(F.col("rule_path")))
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    F.length("rule").alias("length"),
                    F.length("rule_host").alias("host_length"),
                    (F.col("verdict") == "block").alias("blocks"),
                    "rule",
                    "verdict",
                )
            ).alias("best")
        )
        .select("host", "path", "best.rule", "best.verdict")
    )
    return pages.join(winners, ["host", "path"], "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
