"""URL filter: rules indexed by their rarest literal token; only candidates run patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the contract (rule, verdict).
HOST_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]

#: Phrases that block a URL which no host rule judges. Phrases are whole words of the
#: host or the path; a hyphen stands for itself.
BLOCKED_PHRASES = ["spam-farm", "adult-x", "ads-track", "cheap-pills", "free-bets", "casino-win"]


@dataclass(frozen=True)
class UrlRule:
    """`pattern` runs on host + path; `tokens` are words that any match must contain."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    is_host_rule: bool


def _literals(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text))


def host_rule(rule: str, verdict: str) -> UrlRule:
    """Rule ``host/path-start``: fits the host and its subdomains if the path starts so."""
    host, slash, path = rule.partition("/")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    whole = slash + path
    if re.search(r"[A-Za-z0-9]$", whole):  # the last word of the path may go on in the URL
        whole = re.sub(r"[A-Za-z0-9]+$", "", whole)
    pattern = r"^([^/]*[.])?" + _quoted(host + slash + path)
    return UrlRule(rule, verdict, pattern, tuple(dict.fromkeys(_literals(host) + _literals(whole))), True)


def phrase_rule(phrase: str, verdict: str = "block") -> UrlRule:
    """Rule that fits where `phrase` (lower case) stands as whole words in host or path."""
    pattern = "(^|[^a-z0-9])" + _quoted(phrase) + "([^a-z0-9]|$)"
    return UrlRule(phrase, verdict, pattern, tuple(dict.fromkeys(_literals(phrase))), False)


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/-_" else f"[{c}]" if c not in "^\\]" else f"\\{c}" for c in text)


def default_rules() -> list[UrlRule]:
    return [host_rule(*r) for r in HOST_RULES] + [phrase_rule(p) for p in BLOCKED_PHRASES]


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def judge_urls(pages: DataFrame, rules: Iterable[UrlRule], url: str = "url",
               default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule, pattern and verdict (columns of those names are replaced).

    Distinct URLs are cut into words. The words that rules name are counted over all URLs,
    and every rule is filed under its rarest word; a rule without words is filed under the
    empty word, which every URL has. A URL meets only the rules filed under its words, and
    only these run their pattern. The longest host rule wins, then the longest phrase; ties
    go to the greater name. `rule` holds a host rule, `pattern` a phrase rule (null if none).

    The rule table is joined, not hinted: Spark broadcasts it if its size allows, and else
    shuffles by word. Null URLs, and URLs without ``://``, have empty host and path, meet no
    rule and get `default`. Repeated rows each get their verdict; an empty table stays empty.
    """
    spark = pages.sparkSession
    rules = list(rules)
    table = spark.createDataFrame(
        [(i, r.name, r.verdict, r.pattern, list(r.tokens) or [""], int(r.is_host_rule))
         for i, r in enumerate(rules)],
        "rule_no int, name string, rule_verdict string, regex string, tokens array<string>, first int")
    urls = pages.select(F.col(url).alias("u")).where("u is not null").distinct()
    words = urls.select("u", F.concat(url_host(F.col("u")), url_path(F.col("u"))).alias("subject"))
    words = words.where("subject <> ''").select("u", "subject", F.explode(F.array_union(
        F.array(F.lit("")),
        F.regexp_extract_all(ascii_lower(F.col("subject")), F.lit("([a-z0-9]+)"), F.lit(1)))).alias("token"))
    filed = table.select("rule_no", F.explode("tokens").alias("token"))
    counts = words.join(filed.select("token").distinct(), "token").groupBy("token").agg(
        F.count("*").alias("n"))
    rarest = filed.join(counts, "token", "left").groupBy("rule_no").agg(
        F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.col("token"))).alias("token"))
    index = rarest.join(table.drop("tokens"), "rule_no")
    hits = words.join(index, "token").where("rlike(subject, regex)")
    best = hits.groupBy("u").agg(F.max(F.struct(
        F.col("first"), F.length("name").alias("size"), F.col("name"), F.col("rule_verdict"))).alias("hit"))
    made = ("host", "path", "rule", "pattern", "verdict")
    rest = [F.col(f"p.`{c}`") for c in pages.columns if c not in made]
    address = F.col(f"p.`{url}`")
    joined = pages.alias("p").join(best.alias("b"), address == F.col("b.u"), "left")
    return joined.select(
        *rest,
        url_host(address).alias("host"),
        url_path(address).alias("path"),
        F.when(F.col("b.hit.first") == 1, F.col("b.hit.name")).alias("rule"),
        F.when(F.col("b.hit.first") == 0, F.col("b.hit.name")).alias("pattern"),
        F.coalesce("b.hit.rule_verdict", F.lit(default)).alias("verdict"))


def oracle() -> str:
    """The registered query in DuckDB: every rule against every page."""
    def quote(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    rules = ", ".join(
        f"({quote(r.name)}, {quote(r.verdict)}, {quote(r.pattern)}, {int(r.is_host_rule)})"
        for r in default_rules())
    part = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    WITH rules(name, rule_verdict, regex, is_first) AS (VALUES {rules}),
    parts AS (
      SELECT row_number() OVER () AS rn, page_id,
        coalesce(translate(regexp_extract(url, '{part}', 1), '{upper}', '{upper.lower()}'), '') AS host,
        coalesce(regexp_extract(url, '{part}', 2), '') AS path
      FROM pages),
    hits AS (
      SELECT rn, name, rule_verdict, is_first,
        row_number() OVER (PARTITION BY rn ORDER BY is_first DESC, length(name) DESC, name DESC) AS k
      FROM parts JOIN rules ON host || path <> '' AND regexp_matches(host || path, regex))
    SELECT page_id, host, path, CASE WHEN is_first = 1 THEN name END AS rule,
      CASE WHEN is_first = 0 THEN name END AS pattern, coalesce(rule_verdict, 'allow') AS verdict
    FROM parts LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (rn)
    """
