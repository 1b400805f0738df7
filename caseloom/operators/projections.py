"""Nearest rows from buckets of signed random projections: an approximate join whose work
grows with the corpus, not with its square.

Every table cuts space by random planes; a row's bucket is the side it lies on of each. A
query asks its own bucket and those across the planes it lies nearest to. Similarities
inside a bucket are exact, so only a missed meeting can cost a neighbour.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .cells import matrix, nothing, unit
from .ordering import first_rows

TIE_DIGITS = 9


@dataclass(frozen=True)
class Projections:
    """``tables`` of planes, as many that a bucket holds about ``bucket`` rows if these
    lie evenly; ``probes`` further buckets a query asks in each; ``block`` rows at
    most meet in one task."""

    tables: int = 16
    bucket: int = 256
    probes: int = 3
    block: int = 4096
    seed: int = 11


def _codes(planes: np.ndarray, probes: int):
    """Buckets of each vector: per table its own, and those across its ``probes`` nearest planes."""
    tables, dim, bits = planes.shape
    flat = planes.transpose(1, 0, 2).reshape(dim, tables * bits)
    weight = 1 << np.arange(bits, dtype=np.int64)

    @F.arrow_udf("array<struct<t:int,code:long>>")
    def run(column: pa.Array) -> pa.Array:
        side = (unit(matrix(column, dim)) @ flat).reshape(-1, tables, bits)
        own = ((side > 0) * weight).sum(2)
        near = np.argsort(np.abs(side), axis=2, kind="stable")[:, :, : min(probes, bits)]
        codes = np.concatenate([own[:, :, None], own[:, :, None] ^ weight[near]], axis=2)
        each = codes.shape[2]
        t = np.broadcast_to(np.arange(tables, dtype=np.int32)[None, :, None], codes.shape).ravel()
        values = pa.StructArray.from_arrays([pa.array(t), pa.array(codes.ravel())], ["t", "code"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * tables * each), values)

    return run


def meetings(queries: DataFrame, corpus: DataFrame, p: Projections) -> tuple[DataFrame, DataFrame] | None:
    """Query and corpus rows by (t, code, chunk, part): rows of one key meet. Buckets with
    more than ``block`` rows of either side, hot ones, are split, and the other side
    copied to the parts."""
    first = corpus.limit(1).collect()
    if not first:
        return None
    n, dim = corpus.count(), len(first[0]["vec"])
    bits = min(40, max(1, math.ceil(math.log2(max(2, n / p.bucket)))))
    planes = np.random.default_rng(p.seed).normal(size=(p.tables, dim, bits))
    dealt = written(corpus.select("id", "vec", F.explode(_codes(planes, 0)("vec")).alias("b")).select("id", "vec", "b.t", "b.code"), "corpus-buckets")
    asked = written(queries.select("query_id", "vec", F.explode(_codes(planes, p.probes)("vec")).alias("b")).select("query_id", "vec", "b.t", "b.code"), "query-buckets")
    many = lambda rows, name: rows.groupBy("t", "code").agg(F.ceil(F.count(F.lit(1)) / p.block).cast("int").alias(name)).filter(F.col(name) > 1)
    hot = written(many(dealt, "parts").join(many(asked, "chunks"), ["t", "code"], "full_outer").select("t", "code", F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("chunks", F.lit(1)).alias("chunks")), "hot-buckets")
    one = F.lit(1)
    split = lambda rows: rows.join(hot, ["t", "code"], "left").withColumns({"parts": F.coalesce("parts", one), "chunks": F.coalesce("chunks", one)})
    part = lambda c, of: F.pmod(F.xxhash64(F.col(c).cast("string")), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = split(asked).withColumn("chunk", part("query_id", "chunks")).withColumn("part", every("parts")).drop("parts", "chunks")
    right = split(dealt).withColumn("part", part("id", "parts")).withColumn("chunk", every("chunks")).drop("parts", "chunks")
    return left, right


KEYS = ["t", "code", "chunk", "part"]


def visited_pairs(queries: DataFrame, corpus: DataFrame, p: Projections | None = None) -> int:
    """Pairs of rows that ``knn_projected`` compares."""
    sides = meetings(queries, corpus, p or Projections())
    if sides is None:
        return 0
    n = [s.groupBy(*KEYS).agg(F.count(F.lit(1)).alias(c)) for s, c in zip(sides, ("a", "b"), strict=True)]
    return n[0].join(n[1], KEYS).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0


def knn_projected(queries: DataFrame, corpus: DataFrame, k: int, projections: Projections | None = None) -> DataFrame:
    """query_id, rank, id, sim: the ``k`` most similar corpus rows that each query meets,
    for ``queries(query_id, vec)`` and ``corpus(id, vec)``. Of the exact neighbours a
    share is found that grows with tables and probes and with how far they stand out;
    ``recall`` measures it. Similarities, their order and ties are exact. A query that
    meets fewer than ``k`` rows has fewer; without a vector it has one row without a hit."""
    p = projections or Projections()
    given = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec"))
    corpus = corpus.select("id", F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null")
    id_type = corpus.schema["id"].dataType
    spec = f"query_id {given.schema['query_id'].dataType.simpleString()}, id {id_type.simpleString()}, sim double"
    none = lambda rows: rows.select("query_id", F.lit(None).cast("int").alias("rank"), F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("double").alias("sim"))
    sides = meetings(given.filter("vec is not null"), corpus, p)
    if sides is None:
        return none(given.filter("vec is null"))

    def best(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or cs.empty:
            return nothing("query_id", "id", "sim")
        cs = cs.sort_values("id", kind="stable")
        q, c = unit(np.stack(qs["vec"].to_numpy())), unit(np.stack(cs["vec"].to_numpy()))
        names, ids, kk = qs["query_id"].to_numpy(), cs["id"].to_numpy(), min(k, len(cs))
        frames = []
        for s in range(0, len(q), 512):
            sims = np.round(q[s : s + 512] @ c.T, TIE_DIGITS)
            col = np.argsort(-sims, axis=1, kind="stable")[:, :kk]
            row = np.repeat(np.arange(len(sims)), kk)
            frames.append(pd.DataFrame({"query_id": names[s : s + 512][row], "id": ids[col.ravel()], "sim": sims[row, col.ravel()]}))
        return pd.concat(frames, ignore_index=True)

    left, right = sides
    found = left.groupBy(*KEYS).cogroup(right.groupBy(*KEYS)).applyInPandas(best, spec)
    # a pair that meets in several buckets counts once; each bucket gave k rows a query at most
    found = found.groupBy("query_id", "id").agg(F.max("sim").alias("sim"))
    top = first_rows(found, ["query_id"], [F.desc("sim"), "id"], k).select("query_id", "rank", "id", "sim")
    return top.unionByName(none(given.filter("vec is null")))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact rows (query_id, id) that were found."""
    want = exact.filter("id is not null").select("query_id", "id")
    n = want.count()
    return want.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count() / n if n else 1.0
