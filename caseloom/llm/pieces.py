"""SentencePiece encoding and decoding with offsets (operator 6)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import inputs
from .piece_model import PieceModel, piece_model
from .tokens import safe_pieces

#: Characters that the library encodes in one call; longer texts are cut where no piece can reach over.
CALL_CHARS = 50_000

ENCODED = "doc_id long, ids array<int>, starts array<long>, ends array<long>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_tile boolean"


def encode_texts(model: PieceModel, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text as the library gives them."""
    if not model.splits:
        return [np.array(ids, np.int32) for ids in model.library.encode(texts, num_threads=1)]
    cut = [safe_pieces(t, CALL_CHARS) for t in texts]
    ids = iter(model.library.encode([p for c in cut for p in c], num_threads=1))
    return [np.array([i for _ in c for i in next(ids)] if len(c) > 1 else next(ids), np.int32) for c in cut]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, byte span of each piece in the UTF-8 of the text, decoded text.

    One row per input row; NULL and empty texts have empty lists and an empty
    decoded text. Equal texts have equal results, whatever rows surround them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("decoded", pa.string())])
        for batch in batches:
            for first, texts in inputs.steps(batch):
                ids = encode_texts(model, texts)
                spans = [model.spans(t, i) for t, i in zip(texts, ids, strict=True)]
                decoded = model.library.decode([i.tolist() for i in ids], num_threads=1)
                yield inputs.record(schema, [batch.column(0).slice(first, len(texts)), ids, [s for s, _ in spans], [e for _, e in spans], decoded])

    return inputs.id_text(docs, doc_id, text).mapInArrow(run, ENCODED)


def encode_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``encode`` with digests in place of its lists and texts, taken in the task so
    that ids and texts need not travel back.

    ids_sha256 is of the decimal ids joined by commas. spans_tile says that the
    spans follow each other from the first byte of the text to the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        digits = [str(i) for i in range(len(model.sizes))]
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_bytes", pa.int64()), ("spans_tile", pa.bool_())])
        for batch in batches:
            for first, texts in inputs.steps(batch):
                ids = encode_texts(model, texts)
                lists = [i.tolist() for i in ids]
                decoded = model.library.decode(lists, num_threads=1)
                sizes = [len(t.encode()) for t in texts]
                tiles = []
                for t, i, n in zip(texts, ids, sizes, strict=True):
                    starts, ends = model.spans(t, i)
                    tiles.append(n == 0 if not len(i) else bool(starts[0] == 0 and ends[-1] == n and (starts[1:] == ends[:-1]).all()))
                yield inputs.record(schema, [
                    batch.column(0).slice(first, len(texts)), [len(x) for x in lists],
                    [hashlib.sha256(",".join(map(digits.__getitem__, x)).encode()).hexdigest() for x in lists],
                    [hashlib.sha256(d.encode()).hexdigest() for d in decoded], sizes, tiles])

    return inputs.id_text(docs, doc_id, text).mapInArrow(run, DIGESTS)


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids; a NULL list gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
        for batch in batches:
            lists = [i or [] for i in batch.column(1).to_pylist()]
            yield inputs.record(schema, [batch.column(0), model.library.decode(lists, num_threads=1) if lists else []])

    return encoded.select(encoded[doc_id].cast("long").alias("doc_id"), encoded[ids].alias("ids")).mapInArrow(run, "doc_id long, text string")
