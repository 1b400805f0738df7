"""The table function with a TABLE argument, beside the operator."""

import pytest
from pyspark.sql import functions as F

from caseloom.functions.tablefuncs import register_ranked_chunks
from caseloom.operators import documents


def test_ranked_chunks_are_those_of_the_operator(spark):
    register_ranked_chunks(spark)
    docs = spark.createDataFrame([(i, " ".join(["alpha", "beta", "gamma"][(i * j) % 3] for j in range(400))) for i in range(6)] + [(9, None), (10, "")], "doc_id long, text string")
    chunks = documents.chunk_text(docs, 50).withColumn("more", F.lit("x")).repartition(5)
    chunks.unionByName(spark.createDataFrame([(9, 0, None, "x")], "doc_id long, chunk int, text string, more string"), allowMissingColumns=True).createOrReplaceTempView("some_chunks")
    rows = spark.sql("SELECT * FROM ranked_chunks(TABLE(some_chunks), 'Beta gamma', 4)").collect()
    want = documents.search_chunks(docs, "beta gamma", 4, 50).collect()
    assert {(r["doc_id"], r["rank"], r["chunk"], r["score"]) for r in rows} == {(r["doc_id"], r["rank"], r["chunk"], r["score"]) for r in want} and len(rows) == len(want) > 15
    for bad in ("ranked_chunks(TABLE(SELECT 1 AS doc_id), 'a', 1)", "ranked_chunks('no', 'a', 1)", "ranked_chunks(TABLE(some_chunks), 'a', 0)"):
        with pytest.raises(Exception, match="column|TABLE|at least"):
            spark.sql(f"SELECT * FROM {bad}").collect()
