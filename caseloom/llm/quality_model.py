"""Quality classifier (operator 1): ridge regression on random Fourier features
of document statistics, with isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import inputs
from .tokens import safe_pieces

#: Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 exclamation, 6 symbol, 7 line end, 8 blank, 9 beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!", b"#*$%&|<>@=+_/\\^~{}[]", b"\n", b" \t\r"], 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 9

STATISTICS = (
    "log_bytes", "upper", "digits", "marks", "exclamations", "symbols", "line_ends", "beyond_ascii", "word_bytes", "word_bytes_sd",
    "distinct_words", "top_word", "marked_words", "repeated_lines", "line_words")
WORD_SLICE = 1 << 20
#: Pairs of sums that come to the driver.
SUMS = 8


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text; zeros for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=10)
    letters = max(1, kinds[1] + kinds[2])
    seen: Counter[str] = Counter()
    for piece in safe_pieces(text, WORD_SLICE):
        seen.update(piece.split())
    words = seen.total() or 1
    sizes = np.fromiter(map(len, seen), np.float64, len(seen))
    often = np.fromiter(seen.values(), np.float64, len(seen))
    mean = float((sizes * often).sum() / words)
    spread = float(np.sqrt(max(0.0, (sizes**2 * often).sum() / words - mean**2)))
    marked = sum(c for w, c in seen.items() if not w[-1].isalnum())
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log1p(n)), kinds[2] / letters, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n, kinds[9] / n, mean, spread,
        len(seen) / words, float(often.max(initial=0)) / words, marked / words, 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(words / max(1, len(lines)))),
    ]


@dataclass(frozen=True)
class Settings:
    """Bounds and constants. Training takes about ``most_rows`` labelled rows, by a
    hash of doc_id; all other steps cover every row."""

    most_rows: int = 20_000
    features: int = 256
    width: float = 2.0  # of the kernel, in standard deviations per root of the number of statistics
    ridge: float = 1e-3
    bins: int = 512
    slices: int = 16
    seed: int = 11


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features, whose products approximate a Gaussian kernel."""
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.waves + self.phases) * np.sqrt(2 / len(self.phases)), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def isotonic(positions: np.ndarray, positives: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising levels at the weighted places of the pools."""
    pools: list[list[float]] = []  # place * n, positives, n
    for x, k, n in zip(positions, positives, totals, strict=True):
        pools.append([x * n, k, n])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def labelled(docs: DataFrame, labels: DataFrame, learn: Column, s: Settings) -> DataFrame:
    """Statistics of a bounded sample of labelled rows: doc_id, quality, stats.

    A doc_id labelled twice takes its greater label. The sample of ids is
    bounded by ``most_rows``, so it can be broadcast; texts are not shuffled.
    """
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("quality"))
    share = min(1.0, s.most_rows / max(1, marks.count()))
    drawn = marks.filter(F.pmod(F.xxhash64(F.lit(s.seed), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)).orderBy(F.xxhash64(F.lit(s.seed), "doc_id")).limit(2 * s.most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.float64()), ("stats", pa.list_(pa.float64()))])
        for batch in batches:
            for first, texts in inputs.steps(batch):
                yield inputs.record(schema, [batch.column(0).slice(first, len(texts)), batch.column(2).slice(first, len(texts)), [statistics(t) for t in texts]])

    rows = inputs.id_text(docs).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "quality")
    return rows.mapInArrow(run, "doc_id long, quality double, stats array<double>")


def learn(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings | None = None) -> Model:
    """Fit on labelled rows where ``learn`` (of doc_id) holds.

    Three quarters of the sample give the normal equations, summed in each slice
    and then over the slices; the rest calibrates. Without labels every text scores
    one half; with one class every text scores that class.
    """
    s = settings or Settings()
    rng = np.random.default_rng(s.seed)
    d = len(STATISTICS)
    waves, phases = rng.normal(0, 1 / (s.width * d**0.5 / 2), (d, s.features)), rng.uniform(0, 2 * np.pi, s.features)
    model = Model(np.zeros(d), np.ones(d), waves, phases, np.zeros(s.features + 1), np.zeros(1), np.full(1, 0.5))
    rows = written(labelled(docs, labels, learn, s), "quality-sample").withColumn("part", F.pmod(F.xxhash64(F.lit(s.seed + 1), "doc_id"), F.lit(4)))
    moments = rows.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not moments["n"]:
        return model
    model.mean = np.array([moments[f"m{i}"] for i in range(d)])
    model.scale = np.array([moments[f"s{i}"] or 1.0 for i in range(d)])
    model.scale[model.scale < 1e-9] = 1.0
    held = rows.sparkSession.sparkContext.broadcast(model)
    size = s.features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            if batch.num_rows:
                x = held.value.features(np.array(batch.column(1).to_pylist()))
                left += x.T @ x
                right += x.T @ batch.column(0).to_numpy()
                n += batch.num_rows
        if n:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([left.tobytes()]), pa.array([right.tobytes()]), pa.array([n])], ["slice", "a", "b", "n"])

    def added(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("slice")
        total = [np.sum([np.frombuffer(x.as_py()) for x in rows[c]], axis=0).tobytes() for c in ("a", "b")]
        return pa.table([[x] for x in (*total, pa.compute.sum(rows["n"]).as_py())], ["a", "b", "n"])

    fit = rows.filter("part > 0").repartition(s.slices, "doc_id").sortWithinPartitions("doc_id", "stats").select("quality", "stats")
    each = fit.mapInArrow(sums, "slice int, a binary, b binary, n long")
    # added up in Spark, so the driver holds SUMS pairs however many slices there are
    found = each.groupBy((F.col("slice") % SUMS).alias("g")).applyInArrow(added, "a binary, b binary, n long").collect()
    if found:
        left = np.sum([np.frombuffer(r["a"]).reshape(size, size) for r in found], axis=0)
        right = np.sum([np.frombuffer(r["b"]) for r in found], axis=0)
        n = sum(r["n"] for r in found)
        model.weights = np.linalg.solve(left / n + s.ridge * np.eye(size), right / n)
    fitted = rows.sparkSession.sparkContext.broadcast(model)

    def raws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = fitted.value.raw(np.array(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip((raw + 0.5) / 2 * s.bins, 0, s.bins - 1).astype(np.int64)), pa.array(raw)], ["quality", "bin", "raw"])

    both = rows.filter("part = 0").select("quality").distinct().count() > 1
    check = rows.filter("part = 0") if both else rows
    bins = check.select("quality", "stats").mapInArrow(raws, "quality double, bin long, raw double").groupBy("bin").agg(F.avg("raw").alias("x"), F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    model.knots, model.levels = isotonic(*(np.array([r[c] for r in bins], np.float64) for c in ("x", "k", "n")))
    inputs.release()
    return model


def score(docs: DataFrame, model: Model, text: Column, into: str) -> DataFrame:
    """Add a column ``into`` from 0 to 1, higher for better text; a NULL text is an
    empty one. The score depends on the text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        out: list[np.ndarray] = []
        for _, texts in inputs.steps(pa.RecordBatch.from_arrays([column], ["text"])):
            out.append(held.value.score(np.array([statistics(t) for t in texts])))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return docs.withColumn(into, run(text))


def folds(doc_id: Column) -> Column:
    """Held-out rows; a row without doc_id is held out."""
    return F.coalesce(inputs.fold(doc_id, 5) == 0, F.lit(True))


def quality(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on) for every row,
    learned from labelled rows that aren't held out.

    A NULL text is scored as an empty one; an id labelled twice is learned with its
    greater label; a row without doc_id counts as held out. Equal texts score
    equally, repeated rows each. Without labels all score one half; an empty table
    gives no rows.
    """
    model = learn(docs, labels, ~folds(F.col("doc_id")), settings)
    rows = score(inputs.id_text(docs), model, F.col("text"), "score")
    return rows.select("doc_id", folds(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
