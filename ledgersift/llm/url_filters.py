"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern in the form used by content blockers. ``||`` in front anchors it at a host or any of its
subdomains, ``*`` stands for any run of characters, the end is open: ``||example.com/en/`` fits every url of
that host below that path. Anchored rules are held against host and path, the others against the whole url.

Every rule is filed under one token only: of the runs of letters and digits that any fitting url must hold as
a whole run, the one that the fewest urls hold (counted over all urls). A url's tokens fetch its candidate
rules through an equality join, and a regular expression runs for candidates alone. A rule without such a
token is a candidate for every url.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import lower_ascii

# Rules (pattern, verdict) that hosts' own rules do not decide: logins, shops, trackers and the like.
PATTERNS = (
    ("/wp-login", "block"), ("/login/", "block"), ("/cart/", "block"), ("/checkout/", "block"),
    ("/ads/", "block"), ("/casino/", "block"), ("/porn/", "block"), ("?replytocom=", "block"),
    ("sessionid=", "block"), ("/tag/*/page/", "block"), ("||ads.*/", "block"),
)
# The rules the registered query is asked for.
SITE_RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
    ("net/es/", "block"), ("net/fr/", "block"),
)
ANY = ""  # index key of rules without a literal token


def rule_regex(pattern: str) -> str:
    """Regular expression of a pattern (Java and RE2 read it alike)."""
    anchored, body = pattern.startswith("||"), pattern.removeprefix("||")
    inner = "[^\\n]*".join(re.sub(r"([^A-Za-z0-9/_=&%-])", r"\\\1", part) for part in body.split("*"))
    return ("^([^/]*\\.)?" if anchored else "") + inner


def rule_tokens(pattern: str) -> list[str]:
    """Runs of letters and digits that are whole runs in every fitting url, lower case."""
    anchored, body = pattern.startswith("||"), pattern.removeprefix("||")
    found = []
    for m in re.finditer("[A-Za-z0-9]+", body):
        bounded_left = (anchored and m.start() == 0) or (m.start() > 0 and body[m.start() - 1] != "*")
        bounded_right = m.end() < len(body) and body[m.end()] != "*"
        if bounded_left and bounded_right:
            found.append(m[0].lower())
    return sorted(set(found))


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(url: Column) -> Column:
    """Distinct tokens of a url, with the key that fetches rules without a token."""
    runs = F.transform(F.split(url, "[^A-Za-z0-9]+", -1), F.lower)
    return F.array_distinct(F.concat(F.array(F.lit(ANY)), runs))


def rule_index(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(token, rule, verdict, regex, anchored): each rule under its rarest token. ``urls`` is a column of distinct urls."""
    spark = urls.sparkSession
    listed = [
        (rule, verdict, rule_regex(rule), rule.startswith("||"), token)
        for rule, verdict in dict(rules).items()
        for token in rule_tokens(rule) or [ANY]
    ]
    table = spark.createDataFrame(listed, "rule string, verdict string, regex string, anchored boolean, token string")
    held = urls.select(F.explode(_tokens(F.col("url"))).alias("token"))
    counts = held.join(table.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n_urls"))
    ranked = table.join(counts, "token", "left").groupBy("rule", "verdict", "regex", "anchored").agg(
        F.min(F.struct(F.coalesce("n_urls", F.lit(0)).alias("n_urls"), F.col("token"))).alias("rarest")
    )
    return ranked.select("rarest.token", "rule", "verdict", "regex", "anchored")


def match_urls(urls: DataFrame, rules: Sequence[tuple[str, str]], first: Sequence[str] = ()) -> DataFrame:
    """Distinct urls that a rule fits: url, site and free, each a struct (rule, verdict) or null.

    ``site`` is the best of the rules listed in ``first``, ``free`` the best of the others. The longest rule
    wins, equal lengths by the greater rule text. ``urls`` is any table with a ``url`` column; null urls fit
    nothing. The rule list is a parameter; Spark broadcasts its index only below its own size threshold.
    """
    distinct = urls.select("url").where(F.col("url").isNotNull()).distinct()
    index = rule_index(distinct, rules).withColumn("first", F.col("rule").isin(list(first)))
    candidates = distinct.select("url", F.explode(_tokens(F.col("url"))).alias("token")).join(index, "token")
    subject = F.when(F.col("anchored"), F.concat(host_of(F.col("url")), path_of(F.col("url")))).otherwise(F.col("url"))
    fits = candidates.where(F.regexp_like(subject, F.col("regex")))
    entry = F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("verdict"))
    return fits.groupBy("url").agg(
        F.max(F.when(F.col("first"), entry)).alias("site"), F.max(F.when(~F.col("first"), entry)).alias("free")
    )


def filter_urls(
    pages: DataFrame,
    site_rules: Sequence[tuple[str, str]] = SITE_RULES,
    patterns: Sequence[tuple[str, str]] = PATTERNS,
    default: str = "allow",
) -> DataFrame:
    """Pages with host, path, rule, pattern and verdict.

    Site rules (host and path in one string) come first: the longest fitting one decides and is returned as
    ``rule``. Where none fits the longest fitting pattern decides (``pattern``), else ``default``. A null url,
    or one without ``://``, has empty host and path and fits no site rule. Every row of ``pages`` stays,
    repeated ones too; columns of these names already there are replaced. An empty table gives an empty result.
    """
    added = ("host", "path", "rule", "pattern", "verdict")
    rows = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in added])
    site = [(f"||{rule}", verdict) for rule, verdict in site_rules]
    rules = site + list(patterns)
    if not rules or len(dict(rules)) < len(rules):
        raise ValueError("no rules, or a rule listed twice")
    best = match_urls(rows, rules, [r for r, _ in site]).withColumnsRenamed({"site": "__site", "free": "__free"})
    found = rows.join(best, "url", "left")
    return found.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.expr("substring(__site.rule, 3)").alias("rule"),
        F.when(F.col("__site").isNull(), F.col("__free.rule")).alias("pattern"),
        F.coalesce("__site.verdict", "__free.verdict", F.lit(default)).alias("verdict"),
    )


def url_verdicts(spark, sf_dir: str) -> DataFrame:
    """Registered query: every url of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


def _sql() -> str:
    site = " ".join(
        f"WHEN regexp_matches(host || path, '{rule_regex('||' + rule)}') THEN '{rule}'"
        for rule, _ in sorted(SITE_RULES, key=lambda r: (len(r[0]), r[0]), reverse=True)
    )
    verdicts = " ".join(f"WHEN '{rule}' THEN '{verdict}'" for rule, verdict in SITE_RULES)

    def subject(rule):
        return "host || path" if rule.startswith("||") else "url"

    free = " ".join(
        f"WHEN regexp_matches({subject(rule)}, '{rule_regex(rule)}') THEN '{rule}'"
        for rule, _ in sorted(PATTERNS, key=lambda r: (len(r[0]), r[0]), reverse=True)
    )
    blocked = ", ".join(f"'{rule}'" for rule, verdict in PATTERNS if verdict == "block")
    return f"""
WITH p AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE {site} END AS rule, CASE {free} END AS free FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL THEN CASE rule {verdicts} END WHEN free IN ({blocked}) THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN free END AS pattern FROM r
"""


URL_SQL = _sql()
