"""URL filters: host-suffix and path-prefix expressions against a table of rules.

Each URL is expanded into the expressions a rule could name: every suffix of its host, cut at
dots, with every prefix of its path, cut at slashes. Expressions and rules meet by the first
bytes of a SHA-256 digest; the whole digest and the rule's own path confirm the match, and the
longest rule wins. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.common import query, table
from tapeline.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host, path and verdict of the registered query's rules.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
SHORT_DIGITS = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the URL is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _directory(path: Column) -> Column:
    """The path up to its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def rule_table(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (null if none fits), verdict.

    A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with
    the rule's path. Of the rules that fit, the longest (host and path together) wins, then the
    longest host, then ``block`` over ``allow``. Rules with a null field are ignored; URLs without
    a rule, null ones included, get ``default``. Equal URLs are judged once. Repeated rows stay;
    empty tables give no rows or only defaults; other columns aren't read.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).where(
        "r_host is not null and r_path is not null and r_verdict is not null").distinct()
    # no expression with more labels or directories than a rule has can meet one
    labels, depth = rules.agg(F.max(F.size(F.split("r_host", r"\."))), F.max(F.size(F.split("r_path", "/")))).first()
    keyed = rules.withColumn("r_digest", F.sha2(F.concat("r_host", _directory(F.col("r_path"))), 256)).withColumn(
        "short", F.substring("r_digest", 1, SHORT_DIGITS))

    host, path = split_url(F.col("url"))
    urls = pages.select(F.col(url).alias("url")).where(F.col(url).isNotNull()).distinct().select("url", host.alias("host"), path.alias("path"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - F.lit((labels or 1) - 1)), F.size(parts)),
                           lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))
    steps = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(steps) - 1, F.lit(depth or 1))),
                           lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.concat_ws("/", F.slice(steps, 1, i)), F.lit("/"))))
    expressions = urls.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes)).select(
        "url", "path", F.sha2(F.concat("suffix", "prefix"), 256).alias("digest"))
    met = expressions.withColumn("short", F.substring("digest", 1, SHORT_DIGITS)).join(keyed, "short").where(
        (F.col("digest") == F.col("r_digest")) & F.col("path").startswith(F.col("r_path")))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("r_verdict") == "block").alias("b"),
                    F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    # stored, so that a URL of many rows can be split in the join
    best = materialize(met.groupBy(F.col("url").alias("b_url")).agg(F.max(rank).alias("best")), "judged")

    host, path = split_url(F.col("_url"))
    return pages.select(F.col(id).alias("_id"), F.col(url).alias("_url")).join(best, F.col("_url") == F.col("b_url"), "left").select(
        F.col("_id").alias(id), host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


@query("op9_url_filters", f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, d, verdict) AS (VALUES {_VALUES}),
m AS (SELECT page_id, h || d AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || d) DESC) AS k
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, d))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id AND k = 1""")
def _op9(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))
