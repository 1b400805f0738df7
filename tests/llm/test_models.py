"""Operators 1, 8 and 9: held-out accuracy, brute force and odd cases."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from corpus import corpus, empty, odd, odd_rows, sentence
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseloom.llm import language, quality_model, quality_rules

NO_LABELS = "doc_id long, quality int, toxic int"


def test_languages_are_learned_and_held_out_rows_predicted(spark):
    docs, _ = corpus(spark)
    rows = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 240
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_every_value_is_learned(spark):
    rng = random.Random(11)
    rows = []
    for n in range(70):  # more values than any limit, one of them with long texts alone
        syllables = ["".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiouyäöå") for _ in range(2)) for _ in range(6)]
        for _ in range(12):
            rows.append((len(rows), " ".join(rng.choice(syllables) for _ in range(6000 if n == 3 else 30)), f"l{n:02d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in language.language_id(docs, language.Settings(epochs=25)).collect()}
    right = [found[i]["lang_pred"] == lang for i, _, lang in rows if lang]
    assert sum(right) > 0.97 * len(right) and {r["lang_pred"] for r in found.values()} >= {f"l{n:02d}" for n in range(70)}
    assert len(language.sample(docs, F.lit(True), language.Settings(least_rows=5, most_rows=70, most_chars=50), "doc_id", "text", "lang")) == 350


def test_unsure_texts_are_rejected_and_clean_ones_stay():
    rng = random.Random(4)
    rows = [(sentence(rng, lang, rng.randint(20, 60)), lang) for lang in ("en", "fr") * 300]
    model = language.train(rows[:500], language.Settings())
    assert 0 < model.threshold < 1
    assert sum(model.predict(t)[1] < model.threshold for t, _ in rows[500:]) <= 1
    assert model.predict("ξψω λκδθ φχς ΩΨΞ " * 5)[1] < model.threshold


def test_language_of_odd_texts(spark):
    rows = language.language_id(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    texts = collections.Counter((i, not any(c.isalpha() for c in t or "")) for i, t, *_ in odd_rows())
    assert collections.Counter((r["doc_id"], r["lang_pred"] == "und") for r in rows) == texts
    assert all(r["rejected"] and r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert language.language_id(empty(spark)).count() == 0
    unlabelled = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.language_id(unlabelled).collect()} == {"und"}


def test_n_grams_are_those_of_the_whole_text(monkeypatch):
    text = "Ab cd! éèñ 12 xyz " * 7
    whole = [np.concatenate([g for g in language.buckets(text, 12)])]
    monkeypatch.setattr(language, "SLICE_CHARS", 5)
    parts = [g for g in language.buckets(text, 12)]
    assert sorted(whole[0].tolist()) == sorted(np.concatenate(parts).tolist())


def test_rejection_follows_the_calibration():
    rows = [("aaa bbb", "x"), ("ccc ddd", "y")] * 40 + [("aaa ccc", "x"), ("aaa ccc", "y")] * 10
    model = language.train(rows, language.Settings())
    assert model.threshold > model.predict("aaa ccc")[1]
    assert model.predict("aaa bbb")[1] >= model.threshold


def test_quality_is_learned_and_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(spark)
    rows = quality_model.quality(docs, labels).collect()
    assert len(rows) == 240 and all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 != 1) for r in rows if r["held_out"]]) > 0.97


def test_quality_of_odd_texts(spark):
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (12, 0, 0), (None, 1, 0), (9, None, 0), (3, 1, 0)], NO_LABELS)
    rows = quality_model.quality(odd(spark), labels).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    by_text = collections.defaultdict(set)
    key = {i: t or "" for i, t, *_ in odd_rows() if i is not None}
    for r in rows:
        if r["doc_id"] is not None:
            by_text[key[r["doc_id"]]].add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    assert {r["score"] for r in quality_model.quality(odd(spark), spark.createDataFrame([], NO_LABELS)).collect()} == {0.5}
    assert {r["predicted"] for r in quality_model.quality(odd(spark), labels.filter("quality = 1 and doc_id = 3")).collect()} == {1}
    assert quality_model.quality(empty(spark), labels).count() == 0


def test_fourier_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(0)
    d, n = 4, 8000
    model = quality_model.Model(np.zeros(d), np.ones(d), rng.normal(0, 1, (d, n)), rng.uniform(0, 2 * np.pi, n), np.zeros(n + 1), np.zeros(1), np.zeros(1))
    x = rng.normal(0, 1, (20, d))
    z = model.features(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2)
    assert np.abs(z @ z.T - kernel).max() < 0.06


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 5)), min_size=1, max_size=12))
def test_isotonic_is_the_best_rising_fit(bins):
    k = np.array([min(a, n) for a, n in bins], float)
    n = np.array([n for _, n in bins], float)
    places, levels = quality_model.isotonic(np.arange(len(k), dtype=float), k, n)
    assert (np.diff(levels) > 0).all() and (np.diff(places) > 0).all()
    # the min-max form of the solution
    y = [max(min(k[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(k))) for a in range(i + 1)) for i in range(len(k))]
    assert np.allclose(sorted(set(np.round(y, 9))), np.round(levels, 9))


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_against_brute_force(spark):
    labels = spark.createDataFrame([(7, 1, 0), (12, 1, 0)], NO_LABELS)
    rows = quality_rules.quality_rules(odd(spark), labels).collect()
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert got == collections.Counter((i, *brute_counts(t)) for i, t, *_ in odd_rows())
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert quality_rules.quality_rules(empty(spark), labels).count() == 0


def test_repeated_windows_against_brute_force(spark):
    @settings(max_examples=25, deadline=None)
    @given(st.lists(st.lists(st.sampled_from("ab"), max_size=60).map(" ".join), min_size=1, max_size=12))
    def check(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = quality_rules.base(docs, "text", quality_rules.Settings()).orderBy("doc_id").collect()
        assert [r["n_repeat_words"] for r in rows] == [brute_counts(t)[4] for t in texts]

    check()


def test_log_ratio_against_brute_force(spark):
    docs, labels = corpus(spark, n=60)
    s = quality_rules.Settings(buckets=512)
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, labels, s).collect()}
    grams = {r["doc_id"]: r["g"] for r in docs.select("doc_id", quality_rules.grams(F.col("text"), 512).alias("g")).collect()}
    tokens = {r["doc_id"]: re.findall(r"\w+|[^\w\s]+", r["text"]) for r in docs.collect()}
    assert all(len(grams[i]) == max(0, 2 * len(t) - 1) for i, t in tokens.items())
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    raw = collections.Counter(g for x in grams.values() for g in x)
    target = collections.Counter(g for i in good for g in grams[i])
    for i, x in grams.items():
        w = [math.log((target[g] + 1) / (target.total() + 512)) - math.log((raw[g] + 1) / (raw.total() + 512)) for g in x]
        assert abs(rows[i]["log_ratio"] - sum(w) / len(w)) < 1e-3
    junk = [r["log_ratio"] for i, r in rows.items() if i % 5 == 1]
    clean = [r["log_ratio"] for i, r in rows.items() if i % 5 != 1]
    assert max(junk) < -0.3 < min(clean)
    none = quality_rules.quality_rules(docs, labels.limit(0), s).collect()
    assert all(r["log_ratio"] == 0 and r["kept"] != r["base_failed"] for r in none)


@pytest.mark.parametrize("name", ["op9_quality_rules", "op2_pseudonyms"])
def test_native_plans_hold_no_python(spark, name):
    from caseloom.llm.catalog import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_ridge_weights_are_those_of_a_direct_solve(spark):
    docs, labels = corpus(spark)
    s = quality_model.Settings(slices=5, features=40)
    model = quality_model.learn(docs, labels, F.lit(True), s)
    rows = quality_model.labelled(docs, labels, F.lit(True), s).filter(F.pmod(F.xxhash64(F.lit(s.seed + 1), "doc_id"), F.lit(4)) > 0).collect()
    x, y = model.features(np.array([r["stats"] for r in rows])), np.array([r["quality"] for r in rows])
    want = np.linalg.solve(x.T @ x / len(x) + s.ridge * np.eye(x.shape[1]), x.T @ y / len(x))
    assert len(rows) > 50 and np.allclose(model.weights, want, atol=1e-6)
