"""URL filters by pattern rules, indexed by their rarest literal token (operator 7, native).

A rule is a regular expression over host and path, with the literal tokens that each URL it fits must have.
Token counts over all URLs tell which of a rule's tokens is rarest; the rule is filed there. The tokens of a
URL fetch the rules filed under them, and only those run their regular expressions. Up to INLINE rules live in
a map literal and no row moves; more go through a join of distinct URLs' tokens with the index.

Defined results: a null URL, or one without "://", has an empty host and path and gets the default verdict;
among fitting rules the longest wins, of equally long ones a blocking one, then the last by code point;
repeated rows give repeated rows; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

INLINE = 1000


@dataclass(frozen=True)
class UrlRule:
    name: str | None
    regex: str
    verdict: str
    length: int
    tokens: tuple[str, ...] = field(default=())


def host_rule(text: str, verdict: str) -> UrlRule:
    """`host/path`: the host with its subdomains, where the URL's path starts with the path."""
    host, slash, path = text.partition("/")
    host, path = host.lower(), slash + path
    # the last token of the path may go on in the URL
    whole = re.sub(r"[A-Za-z0-9]+\Z", "", path)
    return UrlRule(text, f"^(?:[^/]*\\.)?{java_quote(host)}{java_quote(path) if path else '(?:/|$)'}", verdict, len(host + path), tuple(t for t in re.split("[^a-z0-9]+", (host + whole).lower()) if t))


def word_rule(word: str, verdict: str) -> UrlRule:
    """A whole word anywhere in host or path; not a named rule."""
    return UrlRule(None, f"(?i)(?:^|[^a-z0-9]){java_quote(word)}(?:[^a-z0-9]|$)", verdict, 0, (word.lower(),))


def java_quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_])", r"\\\1", text)


#: Words of hosts and paths that mark gambling, adult, pill, pirated-software, advertising and spam pages.
WORDS = """bet bets betting bingo blackjack casino casinos gambling jackpot lotto poker roulette slots sportsbook
adult camgirls escort escorts hentai milf nude nudes porn porno sex sexy webcams xxx
cialis levitra pharmacy pills steroids tramadol viagra xanax
crack cracked keygen keygens nulled serials torrent torrents warez
ads adserver adservice clickbait popads popunder spam spammer tracker tracking""".split()

RULES = [
    host_rule("net/", "block"),
    host_rule("example.net/en/", "allow"),
    host_rule("example.com/de/", "block"),
    host_rule("org/fr/", "allow"),
    *(word_rule(w, "block") for w in WORDS),
]


def parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def url_tokens(place: Column) -> Column:
    return F.array_distinct(F.split(F.translate(place, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+"))


def file_rules(urls: DataFrame, rules: list[UrlRule]) -> dict[str, list[UrlRule]]:
    """Each rule under its rarest token; '' has those without a token. Counts cover all URLs and only the rules' tokens, so as many rows come to the driver as the rules have tokens."""
    known = sorted({t for r in rules for t in r.tokens})
    here = F.explode(F.array_intersect(url_tokens(F.col("_place")), F.array(*map(F.lit, known)))) if known else None
    counts = {r[0]: r[1] for r in urls.select(here.alias("t")).groupBy("t").count().collect()} if known else {}
    index: dict[str, list[UrlRule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return index


def filter_urls(pages: DataFrame, rules: list[UrlRule], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", inline: int = INLINE) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict."""
    host, path = parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path")).withColumn("_place", F.concat("_host", "_path"))
    index = file_rules(urls, rules)
    as_struct = lambda r: F.struct(F.lit(r.length).alias("length"), F.lit(r.verdict).alias("verdict"), F.lit(r.name).cast("string").alias("rule"), F.lit(r.regex).alias("regex"))
    if not rules:
        best = F.lit(None).cast("struct<verdict:string,rule:string>")
        judged = urls.withColumn("_best", best)
    elif len(rules) <= inline:
        shelf = F.create_map(*(x for t, held in index.items() for x in (F.lit(t), F.array(*map(as_struct, held)))))
        fetched = F.flatten(F.transform(F.filter(F.array_union(url_tokens(F.col("_place")), F.array(F.lit(""))), lambda t: F.map_contains_key(shelf, t)), lambda t: F.element_at(shelf, t)))
        judged = urls.withColumn("_best", F.array_max(F.filter(fetched, lambda r: F.rlike(F.col("_place"), r["regex"]))))
    else:
        spark = pages.sparkSession
        shelf = spark.createDataFrame([(t, r.length, r.verdict, r.name, r.regex) for t, held in index.items() for r in held], "_t string, length int, verdict string, rule string, regex string")
        places = urls.select("_place").distinct()
        hits = places.select("_place", F.explode(F.array_union(url_tokens(F.col("_place")), F.array(F.lit("")))).alias("_t")).join(shelf, "_t").filter(F.rlike(F.col("_place"), F.col("regex")))
        best = hits.groupBy("_place").agg(F.max(F.struct("length", "verdict", "rule", "regex")).alias("_best"))
        judged = urls.join(best, "_place", "left")
    return judged.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM q)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host || path, '(?i)(^|[^a-z0-9])(WORDS)([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM r
""".replace("WORDS", "|".join(WORDS))
