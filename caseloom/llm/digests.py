"""Improbable-feature digests of documents (operator 4).

Every window of ``WINDOW`` bytes of a text has an entropy; windows are ranked by how
rare their entropy is in the corpus, the rarest of each neighbourhood is voted for, and
windows with votes enough are the features. Feature hashes go into a chain of Bloom
filters, each filled to ``FILL`` features, and two digests are compared by the overlap
of their filters' bits beyond what chance gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import inputs

WINDOW = 16
NEIGHBOURS = 32
VOTES = 8
#: Windows in a row without votes enough, as in periodic texts, from which each run gives its best one.
GAP = 2 * NEIGHBOURS
#: Neighbours in a text with fewer than two runs, and bytes of a feature of a text shorter than a window.
SHORT_RUN = 4
LEVELS = 1024
BITS = 2048
FILL = 128
HASHES = 4
#: Bytes of texts whose windows are worked on at once; a longer text is cut into slices that overlap.
SLAB = 1 << 20

_COUNT = np.arange(WINDOW + 2, dtype=np.float64)
#: n * log2(n) in fixed point, so that running sums are exact.
_NLOGN = np.round(np.where(_COUNT > 0, _COUNT * np.log2(np.maximum(_COUNT, 1)), 0) * (1 << 20)).astype(np.int64)
_TOP = WINDOW * int(np.log2(WINDOW)) << 20
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy level, 0 to LEVELS - 1, of the window that starts at each byte.

    The entropy follows from the sum of n log n over byte counts n. Moving a window
    by a byte changes that sum by two terms, which depend on how often the leaving
    and the entering byte stand in the window: numbers of equal bytes at distances
    below WINDOW, counted for all places at once.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ahead, behind = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)
    for d in range(1, WINDOW):
        same = (data[:-d] == data[d:]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    first = int(_NLOGN[np.bincount(data[:WINDOW])].sum())
    enters = behind[WINDOW:].astype(np.int64)  # with itself, in the window that ends there
    leaves = ahead[: n - 1].astype(np.int64)
    gone = _NLOGN[leaves] - _NLOGN[leaves - 1]
    # ``enters`` counts the byte in the new window, from which the left one is gone
    total = first + np.concatenate([[0], np.cumsum(_NLOGN[enters] - _NLOGN[enters - 1] - gone)])
    return (_TOP - total) * (LEVELS - 1) // _TOP


def features(data: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Hashes of the selected windows of a slab, in order.

    In each run of NEIGHBOURS windows the one of the least rank, the first of equals,
    has a vote, and those with VOTES are taken. Where none is for GAP windows, each run
    gives its best one. A text with fewer than two runs gives the best window of every
    SHORT_RUN, a text shorter than a window all its runs of SHORT_RUN bytes.
    """
    if len(data) < WINDOW:
        short = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(max(0, SHORT_RUN - len(data)), np.uint8)]), SHORT_RUN)
        return _hash(short) if len(data) else np.zeros(0, np.uint64)
    keys = rank[entropies(data)] << 32 | np.arange(len(data) - WINDOW + 1)
    if len(keys) < 2 * NEIGHBOURS:
        best = np.array([keys[i : i + SHORT_RUN].min() for i in range(0, len(keys), SHORT_RUN)])
        chosen = best & 0xFFFFFFFF
    else:
        least, width = keys, 1
        while width < NEIGHBOURS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        votes = np.bincount(least & 0xFFFFFFFF, minlength=len(keys))
        chosen = _filled(data, keys, np.flatnonzero(votes >= VOTES))
    return _window_hashes(data, chosen)


def _window_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    return np.concatenate([_hash(windows[at[i : i + 4096]]) for i in range(0, len(at), 4096)] or [np.zeros(0, np.uint64)])


def _filled(data: np.ndarray, keys: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """``chosen`` and, where none stands in GAP windows or more, the best window of each
    run of NEIGHBOURS; of equal ranks the least hash, so it depends on the content alone."""
    edges = np.concatenate([[-1], chosen, [len(keys)]])
    more = []
    for g in np.flatnonzero(np.diff(edges) > GAP):
        at = np.arange(edges[g] + 1, edges[g + 1])
        starts = np.arange(0, len(at) - NEIGHBOURS + 1, NEIGHBOURS)
        order = ((keys[at] >> 32).astype(np.uint64) << np.uint64(54)) | (_window_hashes(data, at) >> np.uint64(10))
        run = np.minimum(np.searchsorted(starts, np.arange(len(at)), side="right") - 1, len(starts) - 1)
        best = np.lexsort((np.arange(len(at)), order, run))
        more.append(at[best[np.searchsorted(run, np.arange(len(starts)))]])
    return np.sort(np.concatenate([chosen, *more])) if more else chosen


def _hash(windows: np.ndarray) -> np.ndarray:
    h = (windows.astype(np.uint64) + np.uint64(1)) @ _POWERS[: windows.shape[1]]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def digest(text: bytes, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filters as rows of bytes, features per filter) of a text.

    A text above SLAB bytes is worked on in slabs that overlap by a run, so memory
    stays bounded and every window is seen.
    """
    data = np.frombuffer(text, np.uint8)
    step = SLAB - WINDOW - NEIGHBOURS + 2
    found = np.concatenate([features(data[i : i + SLAB], rank) for i in range(0, max(1, len(data) - WINDOW - NEIGHBOURS + 2), step)])
    n = -(-len(found) // FILL)
    filters = np.zeros((n, BITS), np.uint8)
    if n:
        which = np.arange(len(found)) // FILL
        for k in range(HASHES):
            filters[which, (found >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(filters, axis=1), np.bincount(np.arange(len(found)) // FILL, minlength=n).astype(np.uint8) if n else np.zeros(0, np.uint8)


def to_text(filters: np.ndarray, counts: np.ndarray) -> str:
    """Hex: per filter one byte of features held and BITS bits. Empty for a text without features."""
    return np.hstack([counts[:, None], filters]).tobytes().hex() if len(counts) else ""


def from_text(code: str) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(bytes.fromhex(code), np.uint8).reshape(-1, 1 + BITS // 8)
    return rows[:, 1:], rows[:, 0]


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: for each filter of the shorter chain the best normalised overlap with
    a filter of the other, averaged by features held.

    The overlap of two filters is the number of common bits less that of chance,
    over the greatest possible number less that of chance. Two empty digests are
    alike, an empty one is like no other.
    """
    if len(a[1]) > len(b[1]) or (len(a[1]) == len(b[1]) and int(a[1].sum()) > int(b[1].sum())):
        a, b = b, a
    if not len(a[1]):
        return float(not len(b[1]))
    left, right = a[0], b[0]
    size_left, size_right = _ONES[left].sum(1, dtype=np.int64), _ONES[right].sum(1, dtype=np.int64)
    best = np.zeros(len(left))
    for i in range(len(left)):
        common = np.zeros(len(right))
        for j in range(0, len(right), 1024):
            common[j : j + 1024] = _ONES[right[j : j + 1024] & left[i]].sum(1, dtype=np.int64)
        chance = size_left[i] * size_right / BITS
        room = np.minimum(size_left[i], size_right) - chance
        best[i] = np.clip((common - chance) / np.maximum(room, 1e-9), 0, 1).max()
    return float((best * a[1]).sum() / a[1].sum())


def entropy_ranks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Rank of each entropy level, rarest first, over all windows of all texts.

    Each task sends one row of LEVELS counts. Levels that never occur take the last
    ranks; equal counts are ordered by level.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for _, texts in inputs.steps(batch):
                for t in texts:
                    data = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
                    for i in range(0, len(data) - WINDOW + 1, SLAB - WINDOW + 1):
                        counts += np.bincount(entropies(data[i : i + SLAB]), minlength=LEVELS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["level", "n"])

    rows = inputs.id_text(docs, doc_id, text).mapInArrow(inputs.released(run), "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS, np.int64)
    for r in rows:
        counts[r["level"]] = r["n"]
    order = np.lexsort((np.arange(LEVELS), counts, counts == 0))
    rank = np.empty(LEVELS, np.int64)
    rank[order] = np.arange(LEVELS)
    return rank


def fingerprint(docs: DataFrame, rank: np.ndarray | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint of each row. NULL texts count as empty ones, whose
    fingerprint is the empty string. Equal texts have equal fingerprints under one
    ``rank``; without one it is taken from the table itself."""
    held = docs.sparkSession.sparkContext.broadcast(entropy_ranks(docs, doc_id, text) if rank is None else rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])
        for batch in batches:
            for first, texts in inputs.steps(batch):
                yield inputs.record(schema, [batch.column(0).slice(first, len(texts)), [to_text(*digest(t.encode("utf-8", "surrogatepass"), held.value)) for t in texts]])

    return inputs.id_text(docs, doc_id, text).mapInArrow(inputs.released(run), "doc_id long, fingerprint string")


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDITS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def neighbours(docs: DataFrame, slices: int) -> DataFrame:
    """slice, doc_id, text, guest: rows dealt by ranges of doc_id; the first row of
    each slice stands a second time, as a guest, behind the last row of the slice
    before, and the first row of all behind the last one.

    Bounds are approximate quantiles of doc_id; what the driver holds is a few
    numbers per slice.
    """
    keyed = inputs.id_text(docs).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    marks = keyed.agg(F.percentile_approx("key", [i / slices for i in range(1, slices)] or [0.5], 10 * slices)).first()[0] or []
    bounds = np.unique(np.array(marks, np.int64))

    @F.arrow_udf("int")
    def slice_of(key: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int32))

    dealt = keyed.withColumn("slice", slice_of("key"))
    firsts = {r["slice"]: r["key"] for r in keyed.select("key").withColumn("slice", slice_of("key")).groupBy("slice").agg(F.min("key").alias("key")).collect()}
    there = sorted(firsts)
    before = {s: there[i - 1] for i, s in enumerate(there)}
    starts, hosts = np.array([firsts[s] for s in there], np.int64), np.array([before[s] for s in there], np.int32)

    @F.arrow_udf("int")
    def host_of(key: pa.Array) -> pa.Array:
        """The slice that has this key as a guest, or NULL."""
        at = np.minimum(np.searchsorted(starts, key.to_numpy()), len(starts) - 1)
        return pa.array(hosts[at], pa.int32(), mask=starts[at] != key.to_numpy())

    copies = F.array(F.struct("slice", F.lit(False).alias("guest")), F.when(F.col("host").isNotNull(), F.struct(F.col("host").alias("slice"), F.lit(True).alias("guest"))))
    rows = dealt.withColumn("host", host_of("key") if there else F.lit(None).cast("int"))
    return rows.select("doc_id", "key", "text", F.inline(F.array_compact(copies)))


def edits(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    The edited text keeps the first half of the code points (the larger one) and
    continues with as many of the next document by ascending doc_id as were taken
    off, or all it has; the last document continues with the first. Texts are dealt
    once by ranges of doc_id and read in order, holding two at a time. Rows of equal
    doc_id are ordered by text, NULL ids come first, and NULL texts count as empty.
    """
    spark = docs.sparkSession
    slices = slices or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = spark.sparkContext.broadcast(entropy_ranks(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = held.value
        last: tuple | None = None  # slice, doc_id, text, digest

        def edited(text: str, following: str) -> str:
            half = len(text) // 2
            return text[: len(text) - half] + following[:half]

        for batch in batches:
            parts, ids, guests = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for first, texts in inputs.steps(batch):
                out: list[tuple] = []
                for i, text in enumerate(texts, first):
                    if last and parts[i] != last[0]:
                        last = None
                    if guests[i] and not last:
                        continue
                    own = digest(text.encode("utf-8", "surrogatepass"), rank)
                    if last:
                        new = edited(last[2], text).encode("utf-8", "surrogatepass")
                        changed = digest(new, rank)
                        out.append((last[1], len(last[2]), hashlib.sha256(new).hexdigest(), to_text(*last[3]), to_text(*changed), likeness(last[3], changed), likeness(last[3], own)))
                    last = None if guests[i] else (parts[i], ids[i], text, own)
                if out:
                    yield inputs.record(_EDITS, zip(*out, strict=True))

    dealt = neighbours(docs, slices).repartition("slice").sortWithinPartitions("slice", "guest", "key", "text")
    return dealt.select("slice", "doc_id", "text", "guest").mapInArrow(inputs.released(run), EDITS)
