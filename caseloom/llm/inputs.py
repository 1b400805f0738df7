"""Column handling shared by the operators.

An operator reads an id and a text column and nothing else unless it says so, so
further columns of its input, whatever their names, cannot clash with its own.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python step handles at once.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def id_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def free(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a row: CRC-32 of its id written as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def spread_join(rows: DataFrame, info: DataFrame, key: str, by: str, how: str = "inner", share: int = 1024) -> DataFrame:
    """``rows`` joined with ``info``, which has one row per key, without a hot task.

    Keys that hold more than 1 / ``share`` of the rows, fewer than ``share`` of them
    whatever the data, are dealt by a hash of column ``by`` over as many salts as make
    their parts no larger than that; their rows of ``info`` are copied to the salts,
    which adds at most 2 * ``share`` rows. ``rows`` must give the same rows whenever
    it is read.
    """
    seen = Observation()
    counts = rows.observe(seen, F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    largest = counts.filter(F.col(key).isNotNull()).orderBy(F.desc("n"), key).limit(share).collect()
    total = seen.get["n"] if largest else 0
    hot = [r for r in largest if r["n"] * share > max(total, share)]
    if not hot:
        return rows.join(info, key, how)
    salts = F.broadcast(rows.sparkSession.createDataFrame([(r[key], -(-r["n"] * share // total)) for r in hot], f"{key} {rows.schema[key].dataType.simpleString()}, _salts long"))
    count = F.coalesce("_salts", F.lit(1).cast("long"))
    left = rows.join(salts, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), count)).drop("_salts")
    right = info.join(salts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def steps(batch: pa.RecordBatch, text: str = "text", step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows that hold ``step_bytes`` of text or one
    row; a NULL text comes as an empty one."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    first = held = 0
    for row, size in enumerate(sizes):
        if row > first and held + size > step_bytes:
            yield first, [t or "" for t in column.slice(first, row - first).to_pylist()]
            first, held = row, 0
        held += size
    if first < len(sizes):
        yield first, [t or "" for t in column.slice(first).to_pylist()]


def spans(column: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of rows that hold about ``step_bytes`` of text or one row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    step = np.cumsum(sizes) // step_bytes
    edges = (np.flatnonzero(step[1:] != step[:-1]) + 1).tolist()
    yield from zip([0, *edges], [*edges, len(column)], strict=True) if len(column) else ()


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function, which gives free memory back to the system when its rows are over:
    workers are used again, and what they keep would add up over the stages of a job."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """Give the free memory of Arrow's pool and of the C library back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def record(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
