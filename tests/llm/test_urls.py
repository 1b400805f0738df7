"""Operator 13: rules by their rarest token against every rule on every URL."""

import random
import re

import pytest

from caseloom.llm import url_rules
from caseloom.llm.url_rules import pattern, site

SCHEMA = "page_id long, url string, host string, rank int, name string, verdict string"
URLS = [
    None, "", "no scheme", "://", "a://b", "http://NET/x", "http://net", "http://a.net?x=/", "http://a.net/", "http://anet/x", "http://a.net/#f", "http://x.example.NET/en/1",
    "http://example.net/en", "http://example.net/EN/3", "http://my-example.net/en/3", "https://m.example.com/de/9.html", "http://example.com/d", "http://q.org/fr/?a", "HTTP://Q.ORG/fr/x",
    "http://www.cheap-pills.example.com/en/4", "http://cheap-pills.example.net/en/4", "http://not-cheap-pills.example.com/", "http://a.com/best-casino-here", "http://a.com/casino", "http://casino.a.com/",
    "http://a.com/x/viagra?y", "http://a.com/xviagra", "http://a.com/get.exe", "http://a.com/get.exe?x", "http://help.a.com/warez/", "http://b.com/warez/", "http://b.com/warez-recovery-now",
    "http://u:p@a.net:80/en/", "ftp://a.b://c.net/en/", "http://\u00c9.org/fr/\u00e9", "http://a.net/" + "x/" * 9000, "http://a\nb.net/en/", "http://a.example.com/de/" + "warez/" * 3,
]


def brute(url, rules):
    url = url or ""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    m = re.search("://([^/?#]*)([^?#]*)", url)
    host, path = (low(m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if re.search(r.regex.replace("$", r"\Z"), [host + path, low(url)][r.target])]
    best = max(fits, key=lambda r: (r.rank, r.name, r.verdict), default=None)
    return host, path, best.name if best and best.target == 0 else None, best.verdict if best else "allow"


def by_contract(url):
    """Host, path and rule by suffix and prefix alone."""
    m = re.search("://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in url_rules.SITES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def judged(docs, rules=None, **more):
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(docs, rules, **more).collect()}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, "h", 1, "n", "v") for i, u in enumerate(URLS)], SCHEMA)


def test_verdicts_are_those_of_all_rules_on_all_urls(pages):
    found = judged(pages)
    assert found == {i: brute(u, url_rules.default_rules()) for i, u in enumerate(URLS)}
    assert judged(pages, inline_rules=0) == found
    for i, u in enumerate(URLS):
        host, path, rule, verdict = by_contract(u)
        assert found[i][:3] == (host, path, rule) and verdict in (None, found[i][3])
    verdicts = {u: found[i][3] for i, u in enumerate(URLS)}
    assert verdicts["http://help.a.com/warez/"] == verdicts["http://b.com/warez-recovery-now"] == "allow" != verdicts["http://b.com/warez/"]
    assert verdicts["http://not-cheap-pills.example.com/"] == "allow" == verdicts["http://cheap-pills.example.net/en/4"]


def test_many_rules_and_repeated_rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 2)))
    names = sorted({(f"{word()}.{word()}", rng.choice(["/", "/a", f"/{word()}/"])) for _ in range(150)})
    rules = [site(h, p, rng.choice(["allow", "block"])) for h, p in names]
    rules += [pattern(p) for p in sorted({rng.choice(["", "@@"]) + rng.choice(["||", "|http", "^", ""]) + f"{word()}{rng.choice('*^-.')}{word()}" + rng.choice(["", "^", "|"]) for _ in range(200)})]
    urls = [f"http://{word()}.{word()}.{word()}/{word()}{rng.choice('/-?#')}{word()}" for _ in range(300)]
    urls += urls[:40] + [None, None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = {i: brute(u, rules) for i, u in enumerate(urls)}
    assert len(rules) > url_rules.INLINE_RULES
    assert judged(pages, rules) == want == judged(pages, rules, inline_rules=len(rules))
    again = url_rules.judge(pages.union(pages), rules)
    assert again.count() == 2 * len(urls)


def test_keys_are_the_rarest_whole_tokens():
    assert site("example.net", "/en/", "allow").tokens == ("example", "net", "en")
    assert site("example.net", "/en", "allow").tokens == ("example", "net")
    assert pattern("cheap-pills").tokens == () and pattern("^cheap-pills^").tokens == ("cheap", "pills")
    assert pattern("||a.b*c.d|").tokens == ("a", "d") and pattern("|http://x").tokens == ("http",)
    rule = site("example.net", "/en/", "allow")
    assert url_rules.rarest(rule, {"example": 9, "net": 3, "en": 3}) == "en"
    assert url_rules.rarest(rule, {"example": 9, "net": 3, "en": 4}) == "net"
    assert url_rules.rarest(pattern("xy"), {}) == ""
    with pytest.raises(ValueError):
        url_rules.judge(None, [site("a", "/", "allow"), site("a", "/", "block")])


def test_no_rules_empty_tables_and_plans_without_python(spark, pages):
    assert {v[3] for v in judged(pages, []).values()} == {"allow"}
    assert url_rules.judge(pages.limit(0)).count() == 0 == url_rules.judge(pages.limit(0), inline_rules=0).count()
    for n in (0, 256):
        plan = url_rules.judge(pages, inline_rules=n)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
        assert n == 0 or "Exchange" not in plan
