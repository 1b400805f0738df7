"""Language identification (operator 8).

A text is the average of hashed embeddings of its character n-grams, and a linear
softmax over that average names the language. Both layers are trained together by
stochastic gradient descent; as both are linear, a trained model is one row of
class scores per bucket.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import first_rows
from . import inputs

ORDERS = (2, 3, 4)
SLICE_CHARS = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and of the model.

    Every value of lang is learned. The sample takes up to ``per_language`` rows of each,
    fewer if there are so many values that this passes ``most_rows``, but always
    ``least_rows`` where there are as many, by a hash of doc_id; of a text of more than
    ``most_chars`` characters it takes a stretch of that length at a hashed place. Its last
    fifth calibrates.
    """

    per_language: int = 1000
    least_rows: int = 40
    most_rows: int = 6000
    most_chars: int = 8000
    buckets_log2: int = 16
    dimensions: int = 16
    epochs: int = 6
    rate: float = 0.5
    accepted_error: float = 0.01
    floor: float = 0.9
    seed: int = 7


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def buckets(text: str, log2: int):
    """Buckets of the n-grams of a text, slice by slice; nothing where it has no letter.

    Characters are lowered, and every run of characters that aren't letters, like
    either end of the text, is one border mark. Slices overlap by the n-gram's
    length, so the n-grams are those of the whole text.
    """
    carry = np.zeros(1, np.uint32)
    shift, found = np.uint32(32 - log2), False
    for at in range(0, len(text), SLICE_CHARS):
        codes = np.frombuffer(text[at : at + SLICE_CHARS].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_letters()[codes], codes, np.uint32(0))
        if at + SLICE_CHARS >= len(text):
            codes = np.append(codes, np.uint32(0))
        codes = codes[(codes != 0) | (np.append(carry[-1:], codes[:-1]) != 0)]
        found = found or bool((codes != 0).any())
        joined = np.concatenate([carry, codes])
        for n in ORDERS:
            c = joined[max(0, len(carry) - n + 1) :]
            if len(c) >= n:
                h = np.full(len(c) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
                for k in range(n):
                    h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
                yield (h * np.uint32(0x85EBCA6B)) >> shift
        carry = joined[-(max(ORDERS) - 1) :]


@dataclass
class Model:
    languages: list[str]
    scores: list[np.ndarray]  # per language, the score of each bucket
    bias: np.ndarray
    temperature: float
    threshold: float
    log2: int

    def logits(self, text: str) -> np.ndarray | None:
        """Class scores, or None for a text without a letter."""
        if not self.languages:
            return None
        total, n, letter = np.zeros(len(self.languages)), 0, False
        for b in buckets(text, self.log2):
            n += len(b)
            for i, s in enumerate(self.scores):
                total[i] += s[b].sum(dtype=np.float64)
        letter = n > 0 and any(c.isalpha() for c in text)
        return total / n + self.bias if letter else None

    def predict(self, text: str) -> tuple[str, float]:
        z = self.logits(text)
        if z is None:
            return "und", 0.0
        p = softmax(z / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def sample(docs: DataFrame, learn: Column, s: Settings, doc_id: str, text: str, lang: str) -> list[tuple[str, str]]:
    """Bounded (text, language) rows for training, in an order that a hash of doc_id fixes."""
    rows = docs.filter(learn & F.col(lang).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(F.length("text") > 0)
    counts = [(r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]  # the model has one vector each
    if not counts:
        return []
    each = max(s.least_rows, min(s.per_language, s.most_rows // len(counts)))
    rank = F.xxhash64(F.lit(s.seed), "doc_id")
    place = F.pmod(F.xxhash64(F.lit(s.seed + 1), "doc_id"), F.greatest(F.length("text") - s.most_chars, F.lit(0)) + 1)
    # by a share first that leaves somewhat more than needed, so that few texts travel
    share = (2 * each / F.col("_n") * (1 << 30)).cast("long")
    sizes = F.broadcast(docs.sparkSession.createDataFrame(counts, "lang string, _n long"))  # as many rows as the model has
    drawn = rows.join(sizes, "lang").filter((F.col("_n") <= 4 * each) | (F.pmod(rank, F.lit(1 << 30)) < share))
    drawn = drawn.select("doc_id", "lang", rank.alias("_rank"), F.substring(F.col("text"), (place + 1).cast("int"), F.lit(s.most_chars)).alias("text"))
    drawn = first_rows(drawn, ["lang"], ["_rank", "doc_id", "text"], each, "_nth")
    found = drawn.orderBy("_rank", "doc_id", "text", "lang").select("text", "lang").collect()
    return list(dict.fromkeys((r["text"], r["lang"]) for r in found))


def train(rows: list[tuple[str, str]], s: Settings) -> Model:
    """Fit by stochastic gradient descent; the last fifth of the rows sets the
    temperature and the rejection threshold: the least score from which on wrong
    answers are no more than ``accepted_error`` allows, chance included (two standard
    deviations and one row). No rows give a model that answers ``und``."""
    names = sorted({lang for _, lang in rows})
    place = {n: i for i, n in enumerate(names)}
    bags = []
    for text, lang in rows:
        ids, n = np.unique(np.concatenate([*buckets(text, s.buckets_log2), np.zeros(0, np.uint32)]), return_counts=True)
        if len(ids):
            bags.append((ids.astype(np.int64), (n / n.sum()).astype(np.float32), place[lang]))
    if not bags:
        return Model([], [], np.zeros(0), 1.0, 0.0, s.buckets_log2)
    held = len(bags) // 5
    fit, check = bags[: len(bags) - held], bags[len(bags) - held :] or bags
    rng = np.random.default_rng(s.seed)
    table = rng.normal(0, 0.1, (1 << s.buckets_log2, s.dimensions)).astype(np.float32)
    weights = rng.normal(0, 0.1, (s.dimensions, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    steps, done = s.epochs * len(fit), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(fit)):
            ids, share, y = fit[i]
            rate = np.float32(s.rate * (1 - done / steps))
            done += 1
            mean = share @ table[ids]
            p = softmax(mean @ weights + bias)
            p[y] -= 1
            back = weights @ p
            weights -= rate * np.outer(mean, p)
            bias -= rate * p
            table[ids] -= (rate * len(ids) ** 0.5) * share[:, None] * back
    scores = table @ weights
    z = np.array([share @ scores[ids] + bias for ids, share, _ in check], np.float64)
    y = np.array([k for _, _, k in check])
    grid = 2.0 ** np.arange(-4, 4.25, 0.25)
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / temperature)
    top, wrong = p.max(1), p.argmax(1) != y
    order = np.argsort(-top, kind="stable")
    falling, errors, n = top[order], np.cumsum(wrong[order]), np.arange(1, len(y) + 1)
    expected = s.accepted_error * n
    good = np.flatnonzero((errors <= expected + 2 * np.sqrt(expected) + 1) & np.append(falling[1:] < falling[:-1], True))
    threshold = float(np.nextafter(falling[0], 2)) if not len(good) else float(falling[good[-1]])
    if len(good) and good[-1] == len(y) - 1:  # no wrong answers to keep out: what is clearly less sure than any right one still goes
        threshold = s.floor * float(top[~wrong].min(initial=1.0))
    return Model(names, [np.ascontiguousarray(scores[:, i]) for i in range(len(names))], bias.astype(np.float64), temperature, threshold, s.buckets_log2)


def learn(docs: DataFrame, learn: Column, settings: Settings | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Train on a bounded sample of the rows where ``learn`` holds and lang is not NULL."""
    s = settings or Settings()
    model = train(sample(docs, learn, s, doc_id, text, lang), s)
    inputs.release()  # the driver keeps the weights alone
    return model


def identify(docs: DataFrame, model: Model, text: Column, into: str) -> DataFrame:
    """Add a struct column ``into``: lang_pred, score, rejected.

    A text that is NULL or has no letter is ``und`` with score 0. Rejected are
    those and texts whose calibrated score is below the model's threshold. The
    result depends on the text alone.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def run(column: pa.Array) -> pa.Array:
        m = held.value
        found = [m.predict(t.as_py() or "") for t in column]
        names, scores = [n for n, _ in found], [p for _, p in found]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([n == "und" or p < m.threshold for n, p in found], pa.bool_())], ["lang_pred", "score", "rejected"])

    return docs.withColumn(into, run(text))


def folds(doc_id: Column) -> Column:
    """Held-out rows; a row without doc_id is held out."""
    return F.coalesce(inputs.fold(doc_id, 4) == 2, F.lit(True))


def language_id(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row, learned from
    rows that aren't held out.

    A text that is NULL or has no letter is ``und`` with score 0; a NULL lang is not
    learned from; without rows to learn from all texts are ``und``. Of equally likely
    values the first in order is taken. Repeated rows are answered each, a row without
    doc_id counts as held out, and an empty table gives no rows.
    """
    model = learn(docs, ~folds(F.col("doc_id")), settings)
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), model, F.col("text"), "_found")
    return found.select("doc_id", folds(F.col("doc_id")).alias("held_out"), "_found.lang_pred", "_found.score", "_found.rejected")
