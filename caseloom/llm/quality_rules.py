"""Quality rules (operator 9): word and line counts, and the log-likelihood ratio of
hashed n-grams between a trusted target and the raw corpus. Column expressions only."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A run of letters, digits and underscores, or of anything else that isn't white space.
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"


@dataclass(frozen=True)
class Settings:
    """``trusted_rows`` bounds the trusted sample (by a hash of doc_id); the raw
    counts cover every row. ``threshold`` is in nats per n-gram: a text passes from
    there on."""

    buckets: int = 1 << 14
    trusted_rows: int = 20_000
    smoothing: float = 1.0
    threshold: float = -0.3
    window: int = 8
    min_words: int = 20
    repeat_percent: int = 30
    seed: int = 13


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS, -1), "")


def repeated_words(found: Column, window: int) -> Column:
    """Words that stand in a window of so many words which the text has twice or more.

    Windows are compared by a 64-bit hash, and where two hashes agree, by their
    words. The positions of repeated windows in order give the words covered: each
    window adds as many as lie before the next one.
    """

    def positions(hashes: Column) -> Column:
        keyed = F.transform(hashes, lambda h, i: F.struct(F.array_join(F.slice(found, i + 1, window), " ").alias("k"), i.alias("i")))
        ordered = let(F.array_sort(keyed), lambda s: F.filter(s, lambda x, j: (F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"])))
        return F.array_sort(F.transform(ordered, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - p, F.lit(window))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(positions(hashes), covered))

    hashes = F.transform(F.sequence(F.lit(1), F.size(found) - window + 1), lambda i: F.xxhash64(F.slice(found, i, window)))
    return F.when(F.size(found) > window, let(hashes, count)).otherwise(F.lit(0).cast("long"))


def base(rows: DataFrame, text: str, s: Settings) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = rows.withColumn("_words", words(body)).withColumn("_lines", lines)
    return found.select(
        *rows.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words"), s.window).alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < s.min_words) | (100 * F.col("n_repeat_words") > s.repeat_percent * F.col("n_words")))


def grams(text: Column, buckets: int) -> Column:
    """Buckets of the single tokens and token pairs of a text."""

    def bucket(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")

    def both(t: Column) -> Column:
        pairs = F.transform(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), lambda x, i: bucket(x, F.get(t, i + 1)))
        return F.concat(F.transform(t, lambda x: bucket(x)), pairs)

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), both)


def trusted(labels: DataFrame, s: Settings) -> DataFrame:
    """A bounded set of ids labelled 1, drawn by a hash; an id labelled twice takes
    its greater label."""
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_trusted")).agg(F.max("quality").alias("q")).filter("q = 1").drop("q")
    share = min(1.0, s.trusted_rows / max(1, good.count()))
    rank = F.xxhash64(F.lit(s.seed), "_trusted")
    return good.filter(F.pmod(rank, F.lit(1 << 20)) < share * (1 << 20)).orderBy(rank).limit(2 * s.trusted_rows)


def weights(docs: DataFrame, labels: DataFrame, s: Settings) -> np.ndarray:
    """Log ratio of the two smoothed multinomials per bucket: trusted over raw.

    Counts are summed in each task before they meet, so a shuffle holds at most one
    row per bucket and task, and the driver receives one per bucket. Without
    trusted rows all weights are 0, and every text passes.
    """
    ids = F.broadcast(trusted(labels, s))  # bounded by trusted_rows
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id") == F.col("_trusted"), "left")
    each = marked.select(F.when(F.col("_trusted").isNull(), 0).otherwise(1).alias("t"), F.explode(grams(F.col("text"), s.buckets)).alias("b"))
    rows = each.groupBy("b").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    target, raw = np.zeros(s.buckets), np.zeros(s.buckets)
    for r in rows:
        target[r["b"]], raw[r["b"]] = r["t"], r["n"]
    if not target.sum():
        return np.zeros(s.buckets)
    share = [(x + s.smoothing) / (x.sum() + s.smoothing * s.buckets) for x in (target, raw)]
    return np.log(share[0]) - np.log(share[1])


def ratio(text: Column, weight: np.ndarray) -> Column:
    """Mean weight of the n-grams of a text; 0 for a text without tokens."""
    # one constant array, whose size is the number of buckets
    table = F.from_json(F.lit(json.dumps([float(f"{w:.5g}") for w in weight])), "array<double>")
    total = F.aggregate(F.col("_grams"), F.lit(0.0), lambda a, g: a + F.get(table, g))
    return F.when(F.size("_grams") == 0, 0.0).otherwise(total / F.size("_grams"))


def quality_rules(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, log_ratio, kept for every row.

    A NULL text has no words. Rows without doc_id are counted as raw and get their
    row. Repeated rows count and are returned each.
    """
    s = settings or Settings()
    weight = weights(docs, labels, s)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    found = base(rows, "text", s).withColumn("_grams", grams(F.col("text"), s.buckets)).withColumn("log_ratio", ratio(F.col("_grams"), weight))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= s.threshold)).drop("text", "_grams")
