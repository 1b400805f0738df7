"""Best-fit packing by minimum bin slack (operator 10).

Pieces of one length are alike to a packing, so the problem is its histogram of
lengths, of at most ``capacity`` numbers whatever the corpus. A bin pattern found
on the histogram is used as often as the lengths allow, and Spark deals the pieces
to the patterns by their rank among pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import inputs
from .tokens import chunk_encoder, ended

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length that are ranked in one group of a window.
RANKED_ROWS = 250_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids with ``end_id``
    behind them, cut every ``capacity`` ids. NULL and empty texts have one piece,
    the end id."""

    @inputs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for first, last in inputs.spans(batch.column(1)):
                ids, sizes = ended(*encoder.encode_column(batch.column(1).slice(first, last - first)), end_id)
                count = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                ends = np.cumsum(length)
                view = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
                yield inputs.record(schema, [batch.column(0).slice(first, last - first).take(pa.array(doc)), piece, start, length, sums])

    return inputs.id_text(docs, doc_id, text).mapInArrow(run, PIECES)


def fullest(counts: np.ndarray, room: int) -> dict[int, int]:
    """The multiset of available lengths with the greatest sum up to ``room``.

    ``counts[l]`` pieces of length l may be used. The reachable sums are the bits of
    one integer; adding k pieces of length l shifts it by k * l. Bounded
    multiplicities are added in powers of two, and the search ends as soon as the
    whole room can be filled.
    """
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, k = min(int(counts[length]), room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << k * length & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    best, chosen = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> best & 1:
            best -= k * length
            chosen[length] = chosen.get(length, 0) + k
    return chosen


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bin patterns as ({length: pieces}, bins): the longest piece left, and the
    combination that fills the rest of its bin best, removed as often as it fits."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out = []
    for length in range(capacity, 0, -1):
        while counts[length]:
            counts[length] -= 1
            chosen = fullest(counts, capacity - length)
            counts[length] += 1
            chosen[length] = chosen.get(length, 0) + 1
            bins = min(int(counts[n]) // k for n, k in chosen.items())
            for n, k in chosen.items():
                counts[n] -= k * bins
            out.append((chosen, bins))
    return out


def places(plan: list[tuple[dict[int, int], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """The plan as runs of ranks, in order of (length, rank): place of the run's
    first piece, its pieces per bin, first bin, offset in the bin; and the place of
    rank 0 of each length."""
    used = np.zeros(capacity + 2, np.int64)
    for chosen, bins in plan:
        for length, k in chosen.items():
            used[length + 1] += k * bins
    base = np.cumsum(used)
    rank, rows, first_bin = base[:-1].copy(), [], 0
    for chosen, bins in plan:
        offset = 0
        for length in sorted(chosen, reverse=True):
            k = chosen[length]
            rows.append((int(rank[length]), k, first_bin, offset))
            rank[length] += k * bins
            offset += k * length
        first_bin += bins
    runs = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return runs[:, 0], runs[:, 1], runs[:, 2], runs[:, 3], base


def assign(parts: DataFrame, capacity: int = 2048, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to ``capacity``.

    ``parts`` must give the same rows whenever it is read (a written table): it is
    read once for the histogram and once for the ranks. Ranks are counted in
    groups of a length and a salt, as many as ``ranked_rows`` asks for, so a length
    that many pieces share is spread over tasks.
    """
    spark = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = places(patterns(histogram, capacity), capacity)
    salts = max(64, max(histogram.values(), default=0) // ranked_rows + 1)
    held = spark.sparkContext.broadcast(plan)

    salted = parts.withColumn("_salt", F.pmod(F.xxhash64(*parts.columns), F.lit(salts)).cast("int"))
    group = Window.partitionBy("length", "_salt")
    # at most capacity * salts rows, one per group
    before = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    ranked = salted.withColumn("_rank", F.row_number().over(group.orderBy(*[c for c in parts.columns if c != "length"])))
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") - 1 + F.coalesce("_before", F.lit(0)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        start, per_bin, first_bin, offset, base = held.value
        size = length.to_numpy()
        at = base[size] + rank.to_numpy()
        run = np.searchsorted(start, at, side="right") - 1
        nth = at - start[run]
        return pd.DataFrame({"sequence_id": first_bin[run] + nth // per_bin[run], "offset": offset[run] + nth % per_bin[run] * size})

    return ranked.withColumn("_place", place("length", "_rank")).select(*parts.columns, "_place.sequence_id", "_place.offset")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all texts into sequences of at most ``capacity`` tokens.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Offsets of a sequence run from 0 without gaps. NULL and empty texts take one
    token; repeated rows are packed each; an empty table gives no rows.
    """
    return assign(written(pieces(docs, tokenizer, capacity, end_id, doc_id, text), "pieces"), capacity)
