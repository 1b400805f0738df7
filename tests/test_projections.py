"""The approximate nearest-neighbour join against the exact one."""

import numpy as np

from caseloom.operators import vectors
from caseloom.operators.projections import Projections, knn_projected, recall, visited_pairs


def rows(spark, n, seed=1, dim=24):
    """Texts of many topics: a centre for about twenty rows each."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(5).normal(size=(400, dim))
    x = centres[rng.integers(0, n // 20, n)] + rng.normal(0, 0.25, (n, dim))
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>").repartition(4).cache()


def test_recall_and_work(spark):
    p = Projections(bucket=32)
    pairs = {}
    for n in (1000, 4000):
        corpus = rows(spark, n)
        asking = corpus.selectExpr("id as query_id", "vec")
        pairs[n] = visited_pairs(asking, corpus, p)
        if n == 1000:
            found, exact = knn_projected(asking, corpus, 5, p), vectors.knn_join(asking, corpus, 5)
            assert recall(found, exact) >= 0.9
            want = {(r["query_id"], r["id"]): round(r["sim"], 8) for r in exact.collect()}
            got = found.collect()
            assert all(abs(r["sim"] - want[r["query_id"], r["id"]]) < 1e-7 for r in got if (r["query_id"], r["id"]) in want)
            assert len({(r["query_id"], r["rank"]) for r in got}) == len(got)
    assert pairs[4000] < 8 * pairs[1000] and pairs[4000] < 0.5 * 4000 * 4000 * p.tables


def test_hot_buckets_are_split_and_odd_rows_kept(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(300)], "id long, vec array<double>")
    asking = same.selectExpr("id as query_id", "vec").limit(40)
    whole, split = (sorted(map(tuple, knn_projected(asking, same, 3, Projections(tables=2, block=b)).collect())) for b in (4096, 16))
    assert whole == split and {r[2] for r in whole} == {0, 1, 2}
    none = spark.createDataFrame([(1, None), (2, [1.0, 0.0, 0.0])], "query_id long, vec array<double>")
    assert {(r["query_id"], r["id"] is None) for r in knn_projected(none, same, 1).collect()} == {(1, True), (2, False)}
    assert knn_projected(none, same.limit(0), 1).count() == 1 and visited_pairs(none, same.limit(0)) == 0


def test_buckets_without_queries_and_text_ids(spark):
    corpus = rows(spark, 300, seed=3).selectExpr("concat('p', id) as id", "vec")
    asking = corpus.filter("id in ('p0', 'p7')").selectExpr("id as query_id", "vec")
    found = knn_projected(asking, corpus, 1, Projections(bucket=16)).collect()
    assert {(r["query_id"], r["id"]) for r in found} == {("p0", "p0"), ("p7", "p7")}
