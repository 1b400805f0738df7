"""What stays on disk while a query runs, and after it."""

import os
import time
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import functions as F

from caseloom.operators import density, graph
from caseloom.session import written


def shuffles(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",")
    return {f for f in (os.path.basename(x) for x in files.split(",")) if f.startswith("shuffle_")}


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    before = shuffles(spark)
    rows = written(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    for _ in range(50):
        if not (left := shuffles(spark) - before):
            break
        time.sleep(0.1)
    assert not left and rows.count() == 100


def test_ranking_leaves_one_table_of_ranks(spark, monkeypatch):
    seen, most, keep = {}, [], graph.written

    def note(df, name):
        out = keep(df, name)
        seen.setdefault(name, []).append(os.path.dirname(urlparse(out.inputFiles()[0]).path))
        most.append(sum(os.path.exists(p) for p in seen.get("pushed", [])))
        return out

    monkeypatch.setattr(graph, "written", note)
    edges = spark.createDataFrame([(f"n{i}", "E", f"n{(i * j + 1) % 40}") for i in range(40) for j in (3, 7)], "src string, pred string, dst string")
    seeds = spark.createDataFrame([("s", "n1"), ("t", "n2")], "seed_set string, node string")
    rank = graph.personalized_pagerank(edges, seeds, None, iters=12, checkpoint_every=3)
    assert len(seen["pushed"]) == 12 and max(most) <= 4
    assert [name for name in ("links", "dealt-links", "pushed", "ranks") for p in seen[name] if os.path.exists(p)] == ["ranks"]
    total = {r["seed_set"]: r["n"] for r in rank.groupBy("seed_set").agg(F.sum("score").alias("n")).collect()}
    assert set(total) == {"s", "t"} and all(abs(v - 1) < 1e-9 for v in total.values())


def test_tables_that_grow_are_not_sent_by_the_driver(spark, monkeypatch):
    plans, keep = {}, density.written

    def note(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(density, "written", note)
    x = np.random.default_rng(3).normal(size=(120, 2))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    assert density.density_cut(rows, 0.4, 5, 3).count() == 120
    assert {"neighbours", "edges", "crossing", "components", "followed"} <= set(plans)
    # solved: pieces of more edges than one task takes are told apart, a row for each
    assert [name for name, plan in plans.items() if "BroadcastHashJoin" in plan and name != "solved"] == []
