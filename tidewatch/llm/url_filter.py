"""URL verdicts from host rules and wildcard rules, found through their rarest literal token."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ascii_lower
from tidewatch.llm.registry import query, table

#: Rules of the form host/path: a host with its subdomains, and the start of the path.
HOST_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Wildcard rules on the whole address: ``^`` is a separator or an end, ``*`` is anything.
WILDCARD_RULES = [
    ("^casino^", "block"), ("^casino-*", "block"), ("^bets^", "block"), ("^pills^", "block"), ("^adult^", "block"), ("^porn^", "block"),
    ("^xxx^", "block"), ("^spam^", "block"), ("^ads^", "block"), ("^ad^", "block"), ("^track^", "block"), ("^tracker^", "block"),
    ("^warez^", "block"), ("^torrent*.exe^", "block"), ("^museum^*^archive^", "allow"),
]
#: Rules are broadcast below this many characters of rule text, and joined by a shuffle above it.
BROADCAST_CHARS = 4_000_000
WORD = "[a-z0-9]+"


def address_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty for a null or an address without ``://``."""
    there = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.when(there, F.substr(url, F.locate("://", url) + F.lit(3))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def compiled(host_rules, wildcard_rules) -> list[tuple]:
    """(rule, verdict, of a host rule, pattern, literal tokens that every fitting address holds as whole words)."""
    out = []
    for rule, verdict in host_rules:
        host, _, path = rule.partition("/")
        words = re.findall(WORD, host) + [m[0] for m in re.finditer(WORD, path.lower()) if m.end() < len(path)]
        out.append((rule, verdict, True, rf"^(?:[^/]*\.)?{_quoted(host)}/{_quoted(path)}", words))
    for rule, verdict in wildcard_rules:
        pieces = {"*": r"[\s\S]*", "^": "(?:[^a-z0-9]|^|$)"}
        pattern = "(?i)" + "".join(pieces.get(c) or _quoted(c) for c in rule)
        whole = [m[0] for m in re.finditer(WORD, rule.lower())
                 if m.start() and m.end() < len(rule) and "*" not in (rule[m.start() - 1], rule[m.end()])]
        out.append((rule, verdict, False, pattern, whole))
    return out


def _quoted(text: str) -> str:
    return "".join(c if re.match(r"[A-Za-z0-9/_-]", c) else "\\" + c if c.isascii() else c for c in text)


def judge(pages: DataFrame, host_rules=HOST_RULES, wildcard_rules=WILDCARD_RULES, default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to ``pages`` (which needs ``url``; columns with these names are replaced).

    The longest fitting host rule decides; without one the longest fitting wildcard rule, block before allow; else ``default``.
    ``rule`` names a host rule only. Each distinct address is split into words. A rule is stored under that of its literal words which
    the fewest addresses hold (under the empty word if it has none, which every address asks for); an address asks for
    the rules under its words, and only their patterns run.
    """
    spark = pages.sparkSession
    host, path = address_parts(F.col("url"))
    rules = compiled(host_rules, wildcard_rules)
    small = sum(len(r[0]) + len(r[3]) for r in rules) <= BROADCAST_CHARS
    local = F.broadcast if small else (lambda df: df)
    rows = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rules)], "id int, rule string, verdict string, hosted boolean, pattern string, words array<string>")
    addresses = pages.select("url").where("url IS NOT NULL").distinct().select("url", F.concat(host, path).alias("address"))
    asked = addresses.select("url", "address", F.explode(F.array_union(
        F.split(ascii_lower(F.col("address")), "[^a-z0-9]+"), F.array(F.lit("")))).alias("word"))

    words = rows.select("id", F.explode("words").alias("word"))
    counts = asked.join(local(words.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = words.join(counts, "word", "left").groupBy("id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))["word"].alias("word"))
    index = rows.join(rarest, "id", "left").select(
        F.coalesce("word", F.lit("")).alias("word"), "rule", "verdict", "hosted", "pattern")

    fits = asked.join(local(index), "word").where(F.expr("rlike(address, pattern)"))
    rank = F.struct("hosted", F.length("rule").alias("size"), (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")
    best = fits.groupBy("url").agg(F.max(rank).alias("best")).select(F.col("url").alias("__url"), "best")
    plain = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    return plain.join(best, plain["url"] == best["__url"], "left").withColumns({
        "rule": F.when(F.col("best.hosted"), F.col("best.rule")), "verdict": F.coalesce("best.verdict", F.lit(default)),
    }).drop("__url", "best")


def _wildcard_sql(rule: str) -> str:
    pieces = {"*": ".*", "^": "([^a-z0-9]|^|$)"}
    return "".join(pieces.get(c) or re.escape(c) for c in rule)


def _sql() -> str:
    hosts = ", ".join(f"('{r}', '{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for r, v in HOST_RULES)
    wilds = ", ".join(f"('{r}', '{v}', '{_wildcard_sql(r)}')" for r, v in WILDCARD_RULES)
    return f"""
    WITH a AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (
        SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    hosts(rule, verdict, h, s) AS (VALUES {hosts}),
    wilds(rule, verdict, pattern) AS (VALUES {wilds}),
    fits AS (
        SELECT n, rule, verdict, 1 AS hosted FROM p JOIN hosts ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)
        UNION ALL SELECT n, rule, verdict, 0 FROM p JOIN wilds ON regexp_matches(lower(host || path), pattern, 's')),
    best AS (
        SELECT * FROM fits QUALIFY row_number() OVER (
            PARTITION BY n ORDER BY hosted DESC, length(rule) DESC, verdict = 'block' DESC, rule DESC) = 1)
    SELECT page_id, host, path, CASE WHEN hosted = 1 THEN rule END AS rule, coalesce(verdict, 'allow') AS verdict
    FROM p LEFT JOIN best USING (n)"""


@query("op2_url_filter", _sql())
def op2_url_filter(spark, folder):
    """Host, path, rule and verdict of every page; see :func:`judge`. Null addresses have empty parts and the default verdict."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
