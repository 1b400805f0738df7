"""A table function over the chunks of many documents, for SQL with a TABLE argument."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, PartitioningColumn, SelectedColumn, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

WANTED = ("doc_id", "chunk", "text")


class RankedChunks:
    """The ``k`` best chunks of each document, which is a partition of the TABLE
    argument: the query words that a chunk holds are its score, later chunks win ties.

    ``analyze`` asks Spark to partition by doc_id, so a call needs no PARTITION BY, and
    to send the three columns it reads. State is ``k`` chunks; rows come one by one, so
    a document may have any number of chunks, in any order. NULL texts hold no words.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, query: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(rows.dataType, StructType):
            raise ValueError("the first argument is TABLE(...) of chunks")
        missing = [c for c in WANTED if c not in rows.dataType.fieldNames()]
        if missing:
            raise ValueError(f"the table has no column {', '.join(missing)}")
        if not query.isConstantExpression or not k.isConstantExpression or k.value is None or k.value < 1:
            raise ValueError("query and k are constants, k at least 1")
        schema = StructType().add("doc_id", rows.dataType["doc_id"].dataType).add("rank", IntegerType()).add("chunk", IntegerType()).add("score", IntegerType()).add("excerpt", StringType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("doc_id")], select=[SelectedColumn(c) for c in WANTED])

    def __init__(self) -> None:
        self.doc_id = None
        self.best: list[tuple[int, int, str]] = []

    def eval(self, row, query: str, k: int) -> None:
        self.doc_id = row["doc_id"]
        low = (row["text"] or "").lower()
        score = sum(w in low for w in (query or "").lower().split())
        if score:
            keep = heapq.heappush if len(self.best) < k else heapq.heappushpop
            keep(self.best, (score, row["chunk"], row["text"]))

    def terminate(self) -> Iterator[tuple]:
        for rank, (score, chunk, text) in enumerate(sorted(self.best, reverse=True), 1):
            yield self.doc_id, rank, chunk, score, text


def register_ranked_chunks(spark: SparkSession, name: str = "ranked_chunks") -> None:
    """``SELECT * FROM ranked_chunks(TABLE(chunks), 'words', 5)``."""
    spark.udtf.register(name, udtf(RankedChunks))
