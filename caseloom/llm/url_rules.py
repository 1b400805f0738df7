"""URL filters (operator 13): rules indexed by their rarest literal token. Column expressions and joins only.

A rule is a regular expression with the tokens that every URL it fits must hold as a
whole. Of these the one that fewest URLs of the table hold becomes its key; a URL asks
with its own tokens for the rules of these keys, and only those run.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9]+"
#: Rules up to which the index is a constant of the plan; more are joined.
INLINE_RULES = 256
#: What a site rule ranks above any pattern, so that its length decides among site rules alone.
SITE_RANK = 1 << 20

SITES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
PATTERNS = [
    "||cheap-pills.", "||spam-farm.", "||casino.", "||malware.", "||phishing.", "-casino-", "^viagra^", "^porn^", "^xxx^",
    "^free-download^", "^warez^", "^torrent^", "/wp-login.php", "^clickbait^", "*.exe|", "@@||help.*^warez^", "@@^recovery^",
]


@dataclass(frozen=True)
class Rule:
    """``target`` 0 is host and path, 1 the whole URL, both with A-Z lower-cased
    (the path as it is). Of the rules that fit, the highest ``rank`` decides."""

    name: str
    verdict: str
    target: int
    regex: str
    tokens: tuple[str, ...]
    rank: int


def whole_tokens(text: str, open_left: bool, open_right: bool) -> tuple[str, ...]:
    """Tokens of a literal that a URL with this literal must hold as a whole; one at
    an open end may be part of a longer token."""
    found = [m for m in re.finditer(TOKEN, text) if not (open_left and m.start() == 0) and not (open_right and m.end() == len(text))]
    return tuple(dict.fromkeys(m[0] for m in found))


def site(host: str, path: str, verdict: str) -> Rule:
    """A host with its subdomains, and the start of the path. The longest such rule decides."""
    lowered = host.translate(str.maketrans(UPPER, LOWER))
    tokens = whole_tokens((lowered + path).translate(str.maketrans(UPPER, LOWER)), False, True)
    return Rule(host + path, verdict, 0, r"^(?:[^/]*\.)?" + re.escape(lowered + path), tokens, SITE_RANK + len(host + path))


def pattern(line: str) -> Rule:
    """A line of the common filter lists: ``||`` starts at a host or a subdomain, ``|``
    is an end of the URL, ``*`` any characters, ``^`` a separator or the end, and
    ``@@`` in front makes the rule an exception, which beats those that block."""
    body, exception = (line[2:], True) if line.startswith("@@") else (line, False)
    body = body.translate(str.maketrans(UPPER, LOWER))
    start, ends = "", body.endswith("|")
    body = body.removesuffix("|")
    if body.startswith("||"):
        start, body = r"^[^/?#]*://(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        start, body = "^", body[1:]
    parts = body.split("*")
    regex = start + "[\\s\\S]*".join(re.escape(p).replace(r"\^", "(?:[^a-z0-9_.%-]|$)") for p in parts) + ("$" if ends else "")
    tokens = [t for i, p in enumerate(parts) for t in whole_tokens(p, i > 0 or not start, i < len(parts) - 1 or not ends)]
    return Rule(line, "allow" if exception else "block", 1, regex, tuple(dict.fromkeys(tokens)), 2 if exception else 1)


def default_rules() -> list[Rule]:
    return [site(*s) for s in SITES] + [pattern(p) for p in PATTERNS]


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lowered(F.coalesce(url, F.lit(""))), F.lit(TOKEN), F.lit(0)))


def token_counts(urls: DataFrame, url: str, wanted: Iterable[str]) -> dict[str, int]:
    """Rows whose URL holds each wanted token: one number per token of the rules."""
    wanted = sorted(set(wanted))
    found = urls.select(tokens(urls[url]).alias("t"))
    if len(wanted) <= INLINE_RULES:
        each = found.select(F.explode(F.array_intersect("t", F.array(*map(F.lit, wanted)).cast("array<string>"))).alias("t"))
    else:
        names = urls.sparkSession.createDataFrame([(w,) for w in wanted], "t string")
        each = found.select(F.explode("t").alias("t")).join(names, "t", "left_semi")
    return {r["t"]: r["n"] for r in each.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}


def rarest(rule: Rule, counts: dict[str, int]) -> str:
    """The key of a rule; '' for one without a whole token, which every URL asks for."""
    return min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")


_ENTRY = "struct<rank:int,name:string,verdict:string,target:int,regex:string>"


def _fits(rule: Column, targets: Column) -> Column:
    return F.rlike(F.get(targets, rule["target"]), rule["regex"])


def _inline(rows: DataFrame, keyed: dict[str, list[Rule]]) -> DataFrame:
    """Candidates from a constant index, one projection without a shuffle."""
    entries = {k: [{"rank": r.rank, "name": r.name, "verdict": r.verdict, "target": r.target, "regex": r.regex} for r in v] for k, v in keyed.items()}
    index = F.from_json(F.lit(json.dumps(entries)), f"map<string,array<{_ENTRY}>>")
    keys = F.array(*[F.lit(k) for k in keyed]).cast("array<string>")
    asked = F.array_intersect(F.concat(F.col("_tokens"), F.array(F.lit(""))), keys)
    candidates = F.flatten(F.transform(asked, lambda t: F.element_at(index, t)))
    fitting = F.filter(candidates, lambda r: _fits(r, F.col("_targets")))
    return rows.withColumn("_best", F.array_max(F.transform(fitting, lambda r: F.struct(r["rank"], r["name"], r["verdict"]))))


def _joined(rows: DataFrame, keyed: dict[str, list[Rule]]) -> DataFrame:
    """Candidates from a join on the token, for any number of rules. Each distinct
    URL asks once; Spark broadcasts the index where its size allows that."""
    spark = rows.sparkSession
    listed = [(k, r.rank, r.name, r.verdict, r.target, r.regex) for k, v in keyed.items() for r in v]
    index = spark.createDataFrame(listed, "_key string, rank int, name string, verdict string, target int, regex string")
    urls = rows.select("_url", "_tokens", "_targets").dropDuplicates(["_url"])
    asked = urls.select("_url", "_targets", F.explode(F.concat("_tokens", F.array(F.lit("")))).alias("_key"))
    fitting = asked.join(index, "_key").filter(F.rlike(F.get("_targets", F.col("target")), F.col("regex")))
    best = fitting.groupBy("_url").agg(F.max(F.struct("rank", "name", "verdict")).alias("_best"))
    return rows.join(best.withColumnRenamed("_url", "_found"), F.col("_url") == F.col("_found"), "left").drop("_found")


def judge(pages: DataFrame, rules: list[Rule] | None = None, page_id: str = "page_id", url: str = "url", inline_rules: int = INLINE_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, matched for each row.

    ``rule`` names the site rule that decides, NULL where none fits; ``matched`` the
    rule of any kind. Without a fitting rule a URL is allowed. Site rules come before
    patterns, the longest first; among patterns exceptions win. Two rules of one
    rank and verdict are told apart by name, the greater one is shown; the names of
    site rules must differ.

    A NULL URL, or one without "://", has an empty host and path, so no site rule
    fits it; patterns see it as it is, NULL as ''. Each row is judged for itself,
    repeated ones too; an empty table gives no rows. Columns other than the two
    named are not read, and the list of rules may be empty.
    """
    rules = default_rules() if rules is None else rules
    names = [r.name for r in rules if r.target == 0]
    if len(set(names)) < len(names):
        raise ValueError("two site rules for one host and path")
    counts = token_counts(pages, url, [t for r in rules for t in r.tokens]) if rules else {}
    keyed: dict[str, list[Rule]] = {}
    for r in rules:
        keyed.setdefault(rarest(r, counts), []).append(r)
    rows = pages.select(pages[page_id].alias("page_id"), F.coalesce(pages[url], F.lit("")).alias("_url"))
    rows = rows.select("page_id", "_url", host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"), tokens(F.col("_url")).alias("_tokens"))
    rows = rows.withColumn("_targets", F.array(F.concat("host", "path"), lowered(F.col("_url"))))
    if not rules:
        found = rows.withColumn("_best", F.lit(None).cast("struct<rank:int,name:string,verdict:string>"))
    else:
        found = _inline(rows, keyed) if len(rules) <= inline_rules else _joined(rows, keyed)
    return found.select(
        "page_id", "host", "path",
        F.when(F.col("_best.rank") >= SITE_RANK, F.col("_best.name")).alias("rule"),
        F.coalesce("_best.verdict", F.lit("allow")).alias("verdict"),
        F.col("_best.name").alias("matched"),
    )
