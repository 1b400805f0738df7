"""Token counts (operator 7)."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import inputs
from .piece_model import piece_model
from .tokens import safe_pieces

#: Bytes of text in one call of a library: large enough to carry the call, small enough to bound memory.
CALL_BYTES = 1 << 18
#: Characters beyond which a text is cut, where the vocabulary allows that.
LONG_CHARS = 20_000

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


@functools.lru_cache(maxsize=4)
def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """Lengths of a list of texts, ids thrown away."""
    if path.endswith(".model"):
        model = piece_model(path)

        def pieces(texts: list[str]) -> list[int]:
            if not model.splits:
                return [len(ids) for ids in model.library.encode(texts, num_threads=1)]
            cut = [safe_pieces(t, LONG_CHARS) for t in texts]
            sizes = iter([len(ids) for ids in model.library.encode([p for c in cut for p in c], num_threads=1)])
            return [sum(next(sizes) for _ in c) for c in cut]

        return pieces
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda texts: [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def token_counts(docs: DataFrame, path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``path`` names a ``tokenizers`` file (.json) or a SentencePiece model (.model).
    Texts go to the library in batches of about equal bytes, not rows, so one batch
    of long texts costs what one of short texts does. A long text is cut at single
    spaces that no piece can reach over; a vocabulary without that property, or a
    .json file, gets it whole. One row per input row; NULL and empty texts count 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
        count = _counter(path)
        for batch in batches:
            tokens = [n for _, texts in inputs.steps(batch, step_bytes=CALL_BYTES) for n in count(texts)]
            sizes = pc.fill_null(pc.cast(pc.binary_length(batch.column(1)), pa.int64()), 0)
            yield inputs.record(schema, [batch.column(0), sizes, tokens, [n > limit for n in tokens]])

    return inputs.id_text(docs, doc_id, text).mapInArrow(run, COUNTS)
