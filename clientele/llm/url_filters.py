"""URL filters by hashed expressions, in DataFrame functions only.

A URL expands into every host suffix combined with every path prefix of a length that some rule has. Rules and URLs meet
in an equi-join on a short prefix of the expressions' SHA-256; the full digest confirms. The longest rule wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SHORT = 8                        # hexadecimal digits of the join key


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for URLs without ``://``."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.substring_index(F.col(url), "://", 1))
    rest = F.when(rest.isNotNull(), F.substring(F.col(url), F.length(rest) + 4, F.length(F.col(url))))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``: one row per input row.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest rule (host and path together)
    wins, then the longer host, then block. Without a fitting rule: null and ``default``. Null URLs have an empty host and
    path and fit no rule. Repeated rows are judged once and come back as often as they were there; other columns are not
    read. Rules with nulls take no part.
    """
    rules = (rules.dropna().select("verdict", "rule_host", F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_path").alias("path_length"))
             .withColumn("full", _digest(F.col("rule"))).withColumn("short", F.substring("full", 1, SHORT)))
    host, path = split_url()
    rows = pages.groupBy("page_id", "url").agg(F.count(F.lit(1)).cast("int").alias("times")).select("page_id", "url", "times", host.alias("host"), path.alias("path"))
    lengths = F.coalesce(rules.agg(F.collect_set("path_length")).scalar(), F.array().cast("array<int>"))   # no more than a path is long
    rows = rows.withColumn("labels", F.split("host", r"\.")).withColumn("lengths", lengths)
    rows = rows.withColumn("lengths", F.filter("lengths", lambda n: n <= F.length("path")))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    both = F.flatten(F.transform(suffixes, lambda s: F.transform("lengths", lambda n: F.concat(s, F.substr(F.col("path"), F.lit(1), n)))))
    wide = rows.select("page_id", "url", "times", "host", "path", F.explode_outer(both).alias("expression"))
    wide = wide.withColumn("digest", _digest(F.col("expression"))).withColumn("short", F.substring("digest", 1, SHORT)).drop("expression")
    met = wide.join(rules, "short", "left")
    rank = F.when(F.col("digest") == F.col("full"), F.struct(F.length("rule").alias("a"), F.length("rule_host").alias("b"), (F.col("verdict") == "block").alias("c"), "rule", "verdict"))
    best = met.groupBy("page_id", "url").agg(F.max(rank).alias("best"), F.first("times").alias("times"), F.first("host").alias("host"), F.first("path").alias("path"))
    return (best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))


ORACLE = r"""
WITH r(v, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
      FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN f USING (page_id)
"""
