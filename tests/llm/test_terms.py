"""Operators 11 and 12: packed terms, divergence of sources, spelling variants."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from corpus import empty, odd, odd_rows, sentence

from caseloom.llm import divergence, packed, spelling
from caseloom.llm.divergence import Settings

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_packed_terms_sort_and_come_back():
    rng = random.Random(2)
    terms = sorted({("é" * rng.randint(0, 2) + "".join(rng.choice("ab") for _ in range(rng.randint(1, 22)))).encode() for _ in range(900)})
    text = b" ".join(rng.sample(terms, len(terms)))
    data, begins = packed.joined(pa.array([text.decode(), None, "tail"]))
    starts, lengths = packed.runs(divergence.CODES[data])
    assert begins.tolist() == [1, len(text) + 2, len(text) + 3] and len(starts) == len(terms) + 1
    seen = []
    for bucket in np.unique(packed.bucket_of(lengths)).tolist():
        at = packed.bucket_of(lengths) == bucket
        keys = packed.packed(divergence.CODES[data], starts[at], lengths[at], bucket)
        found = packed.unpacked([k[packed.radix_order(keys)] for k in keys]).tolist()
        assert found == sorted(found)
        seen += found
        assert packed.blocks_of(keys, 7).max() < 7
    assert sorted(seen) == sorted([*terms, b"tail"])


def brute_audit(rows, least, top, scale=1_000_000_000):
    """rows of (lang, source, text); the contract of the operator, term by term."""
    docs = [(a or "", b or "", TERM.findall(lowered(t or ""))) for a, b, t in rows]
    held, count = collections.Counter(), collections.Counter()
    for lang, source, terms in docs:
        held.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    out = set()
    for lang in {d[0] for d in docs}:
        kept = [t for (a, t), n in held.items() if a == lang and n >= least]
        sources = sorted({d[1] for d in docs if d[0] == lang})
        n = {s: {t: count[lang, s, t] for t in kept} for s in sources}
        whole = {t: sum(n[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + scale * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        p, all_p = {s: share(n[s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, r + 1) for r, (v, o) in enumerate(pairs)}
            best = sorted((-f(p[s][t], all_p[t]), t.encode()) for t in kept if n[s][t] and p[s][t] > all_p[t])
            out |= {(lang, s, "term", t.decode(), -v, r + 1) for r, (v, t) in enumerate(best[:top])}
    return out


def audited(docs, **settings):
    rows = [tuple(r) for r in divergence.audit(docs, Settings(**settings)).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_divergence_is_that_of_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        text = sentence(rng, rng.choice(["en", "fr"]), rng.randint(0, 40)) + rng.choice(["", " ÉTÉ été Zoë", " " + "long" * 6 + "é", " 漢字かな交じり文 x1y", " Ab-aB_AB"])
        rows.append((rng.choice(["en", "en", "fr", None, ""]), rng.choice(["hot", "hot", "a", "b", None]), text))
    rows += [("xx", "one", "alone here"), ("yy", "p", "nothing kept"), ("yy", "q", None), ("yy", "é", ""), ("en", "silent", " 12 3 ")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    want = brute_audit(rows, 3, 7)
    assert audited(docs, top=7) == want
    assert audited(docs, top=7, blocks=1) == want == audited(docs, top=7, blocks=23)
    assert {r[4] for r in want if r[0] == "yy"} == {0} and not [r for r in want if r[0] == "xx" and r[2] == "pair"]


def test_tasks_that_hand_on_often_count_the_same(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, rng.choice(["s", "t"]), sentence(rng, "en", 30)) for i in range(40)]
    docs = spark.createDataFrame([("en", s, t) for _, s, t in rows], "lang string, source string, text string").coalesce(1)
    whole = divergence.counted(docs, 2).count()
    monkeypatch.setattr(divergence, "STEP_BYTES", 300)
    monkeypatch.setattr(divergence, "HELD_ROWS", 60)
    assert divergence.counted(docs, 2).count() > 3 * whole
    assert audited(docs, least_docs=2, top=5) == brute_audit([("en", s, t) for _, s, t in rows], 2, 5)


def test_sums_in_small_tables_are_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    cell = rng.choice(9 * 40, 150, replace=False)
    args = cell % 40, cell // 40, rng.integers(1, 50, 150), 40, rng.integers(200, 900, 9), 40, 10**9
    whole = divergence.pair_sums(*args)
    monkeypatch.setattr(divergence, "CELLS", 10)
    assert (divergence.pair_sums(*args) == whole).all() and whole.any()


def test_blocks_hand_on_a_row_per_source_not_per_pair(spark, monkeypatch):
    docs = spark.createDataFrame([(t, "en", f"s{i % 12}") for i, t in enumerate(["one two three", "two three four", "four five one"] * 12)], "text string, lang string, source string")
    found, written = [], divergence.written
    monkeypatch.setattr(divergence, "written", lambda df, name: (found.append((name, df.count())), written(df, name))[1])
    assert divergence.audit(docs, Settings(blocks=5)).filter("part = 'pair'").count() == 12 * 11
    rows = dict(found)
    assert 0 < rows["term-results"] <= rows["term-blocks"] * 12


def test_divergence_of_odd_rows(spark):
    rows = [(r[2], r[3], r[1]) for r in odd_rows()]
    assert audited(odd(spark), least_docs=1, top=4) == brute_audit(rows, 1, 4)
    assert divergence.audit(empty(spark)).count() == 0


def brute_variants(rows, s):
    """rows of (doc_id, text): the contract of the operator, word by word."""
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % s.typo_every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: c for w, c in n.items() if len(w) >= s.least_length and c >= s.least_count}
    letters = {c for w in words for c in w}
    near = {}
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + d :] for i in range(len(w) + 1) for c in letters for d in (0, 1) if i + d <= len(w)}
        near[w] = [x for x in edits - {w} if x in words]
    out = {}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= s.ratio * words[w]:
            form[w] = best
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(near[w]), words.get(form.get(w)))
    return out


def varied(docs, s):
    rows = spelling.variants(docs, s).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r)[1:] for r in rows}


def spelled(rng, n):
    """Words with many near ones: slips of a few base words, anagrams, letters beyond ASCII, very long runs."""
    base = ["thering", "elleau", "été", "Übergröße", "ononon", "nonono", "a" * 30, "ab" * 40, "straße", "ÿÿÿÿÿ", "mentation"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(base[: rng.randint(1, len(base))])
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randint(0, len(w))
                w = w[:at] + rng.choice(["", "a", "é", "n"]) + w[at + rng.randint(0, 1) :]
            words.append(w)
        rows.append((i, rng.choice([" ", "-", "7", "日"]).join(words)))
    return rows


def test_variants_are_those_of_brute_force(spark):
    rng = random.Random(8)
    rows = [*spelled(rng, 160), (500, None), (501, ""), (None, "thering elleau " * 3), (502, "x" * 5000 + " "), (503, "x" * 5000), (504, "x" * 5000), (505, "x" * 4999 + " thering"), *[(506, "x" * 4999)] * 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for s in (spelling.Settings(), spelling.Settings(typo_every=3, least_count=2, ratio=1 + 1, classes=3, chunk=8), spelling.Settings(classes=1, chunk=5, least_length=1, least_count=1)):
        want = brute_variants(rows, s)
        assert varied(docs, s) == want and sum(v[3] for v in want.values()) > 20
    assert {"x" * 4999, "x" * 5000} <= set(want)


def test_variants_of_odd_rows_and_chains(spark):
    s = spelling.Settings()
    assert varied(odd(spark), s) == brute_variants([(r[0], r[1]) for r in odd_rows()], s)
    assert spelling.variants(empty(spark)).count() == 0
    chain = ["aaaaa" + "b" * i for i in range(1, 8)]
    rows = [(1, " ".join(" ".join([w] * 3 * 2**i) for i, w in enumerate(chain)))]
    got = varied(spark.createDataFrame(rows, "doc_id long, text string"), spelling.Settings(typo_every=2**32 - 1))
    assert {v[1] for v in got.values()} == {chain[-1]} and got[chain[0]][:1] == (chain[1],)


def test_tasks_hand_words_on(spark, monkeypatch):
    rows = spelled(random.Random(9), 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(spelling, "STEP_BYTES", 200)
    monkeypatch.setattr(spelling, "HELD_ROWS", 30)
    s = spelling.Settings()
    assert varied(docs, s) == brute_variants(rows, s)


def test_checksums_are_those_of_the_library():
    rng = random.Random(1)
    words = ["".join(rng.choice("abyzàÿé") for _ in range(rng.choice([1, 2, 9, 64, 65, 200]))) for _ in range(300)]
    codes, begins = spelling.letters(*packed.joined(pa.array([" ".join(words)])))
    starts, lengths = packed.runs(codes)
    prefix = np.full(len(words), zlib.crc32(b"17:"), np.uint32)
    assert spelling.checksums(prefix, codes, starts, lengths).tolist() == [zlib.crc32(f"17:{w}".encode()) for w in words]
