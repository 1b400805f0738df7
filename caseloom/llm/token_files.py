"""Token-id files with Elias-Fano document boundaries (operator 3).

File format: a folder of Parquet files, one row per segment, written through
Spark's commit protocol so that a lost executor leaves no half file, and read by
path through any store Spark reaches. A segment holds whole documents:

    slice       int     rank of the slice of doc_ids that the segment belongs to
    segment     int     rank of the segment in its slice
    before      long    ids in earlier segments of the slice
    n_ids       long    ids in the segment
    first_doc   long    least doc_id of the segment, NULL if all are NULL
    no_id       int     documents without doc_id, which come first
    doc_ids     binary  Elias-Fano code of doc_id - first_doc
    ends        binary  Elias-Fano code of the place behind each document's last id
    width       int     bytes of an id, 2 or 4
    ids         binary  the ids of all documents, little-endian

Slices are in ascending order of doc_id. A global place is the ids of earlier
slices (one number per slice) + before + the local place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_folder
from . import inputs
from .elias_fano import EliasFano
from .tokens import chunk_encoder, ended, widened

#: Ids of a segment, unless one document has more.
SEGMENT_IDS = 1 << 20

#: Characters of a text that part rows of one doc_id.
PREFIX = 32

SEGMENTS = "slice int, segment int, before long, n_ids long, first_doc long, no_id int, doc_ids binary, ends binary, width int, ids binary"
DOCUMENTS = "slice int, doc_id long, local_start long, n_tokens long, ids binary"
_SEGMENTS = pa.schema([("slice", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("no_id", pa.int32()), ("doc_ids", pa.binary()), ("ends", pa.binary()), ("width", pa.int32()), ("ids", pa.binary())])


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, segment_ids: int = SEGMENT_IDS, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append ``end_id`` and write the files.

    The texts are dealt by ranges of doc_id, rows of one id (those without any, say) by
    the start of their text, and sorted inside each range, so no task sees more than
    one slice. NULL and empty texts are written as the end id
    alone. Rows with a NULL doc_id come first; rows with equal ids stand side by
    side, ordered by text. An empty table gives a folder without rows.
    """

    @inputs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            nonlocal number, before
            real = [k for k in keys if k is not None]
            first = real[0] if real else None
            ends = np.cumsum(np.concatenate(sizes))
            row = inputs.record(_SEGMENTS, [[x] for x in (
                part, number, before, int(ends[-1]), first, len(keys) - len(real), EliasFano.build(np.array([k - first for k in real], np.uint64)).to_bytes(),
                EliasFano.build(ends).to_bytes(), encoder.type.itemsize, np.concatenate(held).tobytes())])
            number, before = number + 1, before + int(ends[-1])
            for part_of in (keys, sizes, held):
                part_of.clear()
            return row

        for batch in batches:
            for first, last in inputs.spans(batch.column(1)):
                names = batch.column(0).slice(first, last - first).to_pylist()
                ids, each = ended(*encoder.encode_column(batch.column(1).slice(first, last - first)), end_id)
                ends, done = np.cumsum(each), 0
                while done < len(each):  # up to the document that fills the segment
                    start = int(ends[done - 1]) if done else 0
                    room = segment_ids - sum(int(h.size) for h in held)
                    stop = min(int(np.searchsorted(ends, start + room)) + 1, len(each))
                    keys += names[done:stop]
                    sizes.append(each[done:stop])
                    held.append(ids[start : ends[stop - 1]])
                    if sum(int(h.size) for h in held) >= segment_ids:
                        yield segment()
                    done = stop
        if keys:
            yield segment()

    rows = inputs.id_text(docs, doc_id, text)
    rows.repartitionByRange("doc_id", F.substring("text", 1, PREFIX)).sortWithinPartitions("doc_id", "text").mapInArrow(run, SEGMENTS).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary,
    little-endian unsigned 32-bit) of each document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("slice", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                keys, starts, ends = boundaries(row)
                kind, view = np.dtype(f"<u{row['width']}"), memoryview(row["ids"])
                for lo in range(0, len(keys), 256):  # bounded batches of widened ids
                    span = range(lo, min(lo + 256, len(keys)))
                    yield inputs.record(schema, [
                        [row["slice"]] * len(span), keys[lo : lo + 256], starts[lo : lo + 256] + row["before"], (ends - starts)[lo : lo + 256],
                        [widened(view[starts[i] * kind.itemsize : ends[i] * kind.itemsize], kind) for i in span]])

    rows = spark.read.schema(SEGMENTS).parquet(path).mapInArrow(run, DOCUMENTS)
    return _placed(spark, path, rows).select("doc_id", "start", "n_tokens", "ids")


def boundaries(row: dict) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, starts and ends of the documents of a segment."""
    real = EliasFano.from_bytes(row["doc_ids"]).values() + (row["first_doc"] or 0)
    ends = EliasFano.from_bytes(row["ends"]).values()
    return [None] * row["no_id"] + real.tolist(), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def document(row: dict, i: int) -> np.ndarray:
    """Ids of the i-th document of a segment, by two selects."""
    ends = EliasFano.from_bytes(row["ends"])
    start = ends.select(i - 1) if i else 0
    return np.frombuffer(row["ids"], f"<u{row['width']}", offset=start * row["width"], count=ends.select(i) - start)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``read_ids`` with the unsigned CRC-32 of the ids (little-endian unsigned
    32-bit) in their place, taken where the file is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("slice", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys, starts, ends = boundaries(row)
                kind, view = np.dtype(f"<u{row['width']}"), memoryview(row["ids"])
                sums = [zlib.crc32(widened(view[a * kind.itemsize : b * kind.itemsize], kind)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield inputs.record(schema, [[row["slice"]] * len(keys), keys, starts + row["before"], ends - starts, sums])

    rows = spark.read.schema(SEGMENTS).parquet(path).mapInArrow(run, "slice int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return _placed(spark, path, rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def _placed(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Add the ids of earlier slices. There is one number per slice, that is per
    task that wrote, so the running sum over them is short."""
    sizes = spark.read.schema(SEGMENTS).parquet(path).groupBy("slice").agg(F.sum("n_ids").alias("n")).collect()
    start, starts = 0, []
    for r in sorted(sizes):
        starts.append((r["slice"], start))
        start += r["n"]
    offsets = spark.createDataFrame(starts, "slice int, slice_start long")
    return rows.join(F.broadcast(offsets), "slice").withColumn("start", F.col("slice_start") + F.col("local_start"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the ids of all documents to a new folder below the shared one and
    return what is read back: doc_id, start, n_tokens, ids_crc32."""
    path = fresh_folder(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer, end_id)
    return read_digests(docs.sparkSession, path)
