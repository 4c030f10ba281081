"""URL filters by host-suffix and path-prefix expressions.

A URL is expanded into expressions: the suffixes of its host at a label's start with as many labels as some
rule has, times the prefixes of its path of a length that some rule has. An expression is hashed (SHA-256); its first four
bytes meet the rules' in an equi-join, then the full digests must agree. Of the rules that fit, the longest
wins: by the whole expression's length, then the host's, then block before allow, then the text.

Each distinct URL is expanded once and its verdict joined back, so a URL with a third of all rows costs
no more than any other, and the join that brings it back is one that Spark can split. Null URLs and those
without :// have an empty host and path; no rule has an empty host. Repeated rows stay repeated. An empty
table gives no rows; without rules every URL gets the default verdict. Only page_id and url are read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rules up to this number may be broadcast: a digest, a prefix and a text each, some 200 bytes.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def rule_table(like: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """(short, digest, rule, host_chars, verdict); the same rule given twice counts once, block before allow."""
    rows = sorted({(_.text, len(_.host), _.verdict) for _ in rules if _.host}, key=lambda r: (r[0], r[1], r[2] != "block"))
    first: dict[tuple[str, int], tuple] = {}
    for r in rows:
        first.setdefault(r[:2], r)
    schema = T.StructType([T.StructField("rule", T.StringType()), T.StructField("host_chars", T.IntegerType()), T.StructField("rule_verdict", T.StringType())])
    made = like.sparkSession.createDataFrame(list(first.values()), schema)
    # the length of the host is part of what is hashed: a.b/c is another rule with host a.b than with host a
    digest = _digest(F.concat_ws(" ", F.col("host_chars"), F.col("rule")))
    return made.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, 8))


def expand(urls: DataFrame, path_lengths: list[int], label_counts: list[int]) -> DataFrame:
    """(url, full, short): the digest of every expression of each row's host and path that is as long as some rule's.

    Suffixes have as many labels, prefixes as many characters as a rule; so a host of thousands of labels costs no more."""
    labels = F.split("host", r"\.")
    of = F.filter(F.array(*map(F.lit, label_counts)), lambda n: n <= F.size(labels))
    suffixes = F.transform(of, lambda n: F.concat_ws(".", F.slice(labels, F.size(labels) - n + 1, n)))
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in path_lengths)), lambda p: p.isNotNull())
    hosts = urls.filter("host <> ''").select("url", "path", F.explode(suffixes).alias("suffix")).filter("suffix <> ''")
    each = hosts.select("url", "suffix", F.explode(prefixes).alias("prefix"))
    digest = _digest(F.concat_ws(" ", F.char_length("suffix"), F.concat("suffix", "prefix")))
    return each.select("url", digest.alias("full")).withColumn("short", F.substring("full", 1, 8))


def judge_urls(pages: DataFrame, rules: Iterable[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row a page: its id, host, path, the rule that decided or null, and the verdict."""
    rules = list(rules)
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    named = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if not any(r.host for r in rules):
        return named.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    table = rule_table(pages, rules)
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    distinct = named.select("url", "host", "path").distinct()
    hits = expand(distinct, sorted({len(r.path) for r in rules if r.host}), sorted({r.host.count(".") + 1 for r in rules if r.host})).join(table, "short").filter("full = digest")
    rank = F.struct(F.char_length("rule"), "host_chars", F.when(F.col("rule_verdict") == "block", 1).otherwise(0), "rule", "rule_verdict")
    best = hits.groupBy("url").agg(F.max(rank).alias("best")).select(F.col("url").alias("of"), "best.rule", "best.rule_verdict")
    joined = named.join(best, F.col("url") == F.col("of"), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


#: The rules of the registered query.
RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))

_HOST = "translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
r(rhost, rpath, v) AS (VALUES {', '.join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)}),
d AS (SELECT DISTINCT host, path FROM p),
m AS (
  SELECT host, path, rhost || rpath AS rule, v,
    row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, v DESC, rhost || rpath DESC) AS k
  FROM d JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) m ON p.host = m.host AND p.path = m.path
"""
