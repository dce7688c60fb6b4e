"""Operator 10: URL filters, DataFrame functions only.

Pattern rules are indexed by their rarest literal token: the tokens of a rule are counted over all
URLs, and the rule waits under the one that fewest URLs have.  A URL's tokens fetch candidate
rules by an equi-join, and only those run their regular expression.  Host rules (host and path prefix, the longest
wins) come first; what they leave open the pattern rules judge.

A pattern is text with ``*`` (anything), ``^`` (a separator or the end) and ``|`` at either end (anchor).  It is
matched against the lower-cased URL.  A literal counts as a token only where no further letter or digit can
adjoin it.  A rule without such a token waits for every URL.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits no host rule and is judged by the
pattern rules (a null one is allowed); repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


class HostRule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The host rules of the registered query.
HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
#: Pattern rules of the registered query: pages that hold no prose of their own.
PATTERNS = (
    "/login^", "/signin^", "/signup^", "/logout^", "/cart^", "/checkout^", "/wp-admin/", "/tag/*/page/", "/search^", "?s=",
    "?q=*&", "&sessionid=", "?page=", "&page=", "/feed|", "/rss^", ".xml|", ".pdf|", ".zip|", ".exe|", ".jpg|", ".png|", ".mp4|",
    "/casino^", "/porn^", "/xxx^", ".xxx/", "://ads.", "://track.", "/banner^", "&gclid=", "?gclid=", "/print/", "?share=",
)
#: Rule tables up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_RULES = 20_000
_SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"


def to_regex(pattern: str) -> str:
    """The regular expression, for Java and for RE2, of a pattern."""
    head, tail = pattern.startswith("|"), pattern.endswith("|") and len(pattern) > 1
    body = pattern[head : len(pattern) - tail].lower()
    made = "".join({"*": ".*", "^": _SEPARATOR}.get(c) or (c if c.isalnum() else "\\" + c) for c in body)
    return "^" * head + made + "$" * tail


def tokens_of(pattern: str) -> list[str]:
    """The literals of a pattern that every URL it matches has as whole tokens."""
    text = pattern.lower()
    text = text if text.startswith("|") else "*" + text
    text = text if text.endswith("|") else text + "*"
    return sorted({m[1] for m in re.finditer(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])", text)})


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    picked = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        picked = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(picked)
    return picked


def matches(urls: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """The rows of ``urls`` (row, url) that a pattern matches, as (row, pattern): the first in the order of the list."""
    spark = urls.sparkSession
    rules = spark.createDataFrame([(i, p, to_regex(p)) for i, p in enumerate(patterns)], "rule_no int, pattern string, regex string")
    small = len(patterns) <= BROADCAST_RULES
    hint = F.broadcast if small else lambda df: df
    pairs = spark.createDataFrame([(i, t) for i, p in enumerate(patterns) for t in tokens_of(p)], "rule_no int, token string")
    lowered = urls.select("row", F.lower("url").alias("url"))
    words = lowered.select("row", "url", F.explode(F.array_distinct(F.split("url", "[^a-z0-9]+"))).alias("token"))
    counts = words.join(hint(pairs.select("token").distinct()), "token").groupBy("token").count()
    rarest = Window.partitionBy("rule_no").orderBy(F.coalesce("count", F.lit(0)), "token")
    index = pairs.join(counts, "token", "left").withColumn("n", F.row_number().over(rarest)).filter("n = 1").select("rule_no", "token")
    index = written(rules.join(index, "rule_no", "left"), "url-index")
    fetched = words.join(hint(index.filter("token is not null")), "token").select("row", "url", "rule_no", "pattern", "regex")
    loose = index.filter("token is null").agg(F.collect_list(F.struct("rule_no", "pattern", "regex")).alias("rules"))
    every = lowered.join(F.broadcast(loose)).select("row", "url", F.inline("rules"))  # one row: the rules without a token
    hits = fetched.unionByName(every).filter("url rlike regex")
    return hits.groupBy("row").agg(F.min(F.struct("rule_no", "pattern")).alias("hit")).select("row", F.col("hit.pattern").alias("pattern"))


def judge_pages(pages: DataFrame, rules: Sequence[HostRule] = HOST_RULES, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """One row per page: host, path, the host rule that fits, the verdict, and the pattern that matched."""
    rows = written(pages.select("page_id", "url", F.monotonically_increasing_id().alias("row")), "urls")
    split = rows.select("row", "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    split = split.withColumn("fit", host_rule(F.col("host"), F.col("path"), rules))
    out = split.join(matches(rows.filter("url is not null"), patterns), "row", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("pattern").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "pattern")
