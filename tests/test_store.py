"""Versions: merges that are read back, crashes before the swap, and two writers."""

import pytest

from caseloom.sources.store import Conflict, Store, merge_into

UPDATE = "concept string, domain string, rule string, source string, rationale string, effective_date string, seq long"


def updates(spark, *rows):
    return spark.createDataFrame([(c, "D", r, "S", "why", y, i) for i, (c, r, y) in enumerate(rows)], UPDATE)


def counts(store, version):
    return {n: store.read(n, version).count() for n in ("concepts", "decisions", "edges", "conflicts")}


def test_merges_are_read_back_and_merged_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "graph"))
    assert store.version() == 0
    assert merge_into(store, updates(spark, ("Food Need", "r1", "2024"), ("Housing", "r2", "2024"))) == 1
    assert counts(store, 1) == {"concepts": 2, "decisions": 2, "edges": 2, "conflicts": 0}
    before = store.read("decisions")
    assert merge_into(store, updates(spark, ("Food Need", "other", "2024"), ("Food Need", "r3", "2025"))) == 2
    assert counts(store, 2) == {"concepts": 2, "decisions": 3, "edges": 3, "conflicts": 1}
    assert {r["rule"] for r in store.read("decisions").collect()} == {"r1", "r2", "r3"}
    assert before.count() == 2 == store.read("decisions", 1).count()  # an older reading is not disturbed


def test_a_crash_before_the_swap_leaves_the_version_as_it_was(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.update(lambda v: {"t": spark.range(3)})
    store.write({"t": spark.range(100)})  # and nothing after it
    assert store.version() == 1 and Store(spark, str(tmp_path / "s")).read("t").count() == 3
    assert store.update(lambda v: {"t": store.read("t", v).union(spark.range(2))}) == 2 and store.read("t").count() == 5


def test_two_writers_lose_nothing(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    one.update(lambda v: {"t": spark.range(1)})
    tried = []

    def slow(version):
        tried.append(version)
        df = one.read("t", version).union(spark.range(10, 12))
        if len(tried) == 1:  # the other writer is done first
            two.update(lambda v: {"t": two.read("t", v).union(spark.range(20, 23))})
        return {"t": df}

    assert one.update(slow) == 3 and tried == [1, 2]
    assert sorted(r["id"] for r in one.read("t").collect()) == [0, 10, 11, 20, 21, 22]
    with pytest.raises(Conflict):
        one.publish(one.write({"t": spark.range(1)}), 1)
    with pytest.raises(Conflict):
        one.update(lambda v: (two.update(lambda w: {"t": two.read("t", w)}), {"t": spark.range(1)})[1], attempts=2)
