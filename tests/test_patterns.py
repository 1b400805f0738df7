"""Patterns against a search over all bindings."""

import itertools
import random

import pytest

from caseloom.operators.patterns import match_pattern

EDGE = "src string, pred string, dst string"


def brute(edges, pattern, labels, of):
    names = list(dict.fromkeys(v for a, _, b in pattern for v in (a, b)))
    nodes = sorted({x for a, _, b in edges for x in (a, b)})
    have = set(edges)
    return {p for p in itertools.product(nodes, repeat=len(names)) if all((dict(zip(names, p, strict=True))[a], q, dict(zip(names, p, strict=True))[b]) in have for a, q, b in pattern)
            and all(of.get(dict(zip(names, p, strict=True))[v]) == want for v, want in labels.items())}


@pytest.mark.parametrize(("pattern", "labels"), [
    ([("a", "P", "b"), ("b", "P", "c"), ("a", "Q", "c")], {}),
    ([("a", "P", "b"), ("b", "P", "c"), ("c", "P", "a")], {"a": "L"}),
    ([("a", "P", "b"), ("c", "Q", "b"), ("c", "P", "d")], {"b": "L", "d": "M"}),
    ([("a", "P", "a"), ("a", "Q", "b"), ("b", "P", "a")], {}),
])
def test_bindings_are_all_there(spark, pattern, labels):
    rng = random.Random(3)
    edges = [(f"n{rng.randint(0, 9)}", rng.choice("PQ"), f"n{rng.randint(0, 9)}") for _ in range(70)]
    of = {f"n{i}": "LM"[i % 2] for i in range(9)}
    got = match_pattern(spark.createDataFrame(edges, EDGE), pattern, labels, spark.createDataFrame(list(of.items()), "id string, label string")).collect()
    want = brute(edges, pattern, labels, of)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 0


def test_a_triangle_does_not_pass_through_the_wedges_of_a_hub(spark):
    """3000 nodes point at a hub that points at 3000 others: nine million wedges, two triangles."""
    ins = spark.range(3000).selectExpr("concat('i', id) as src", "'P' as pred", "'hub' as dst")
    outs = spark.range(3000).selectExpr("'hub' as src", "'P' as pred", "concat('o', id) as dst")
    shut = spark.createDataFrame([("i5", "P", "o7"), ("i8", "P", "o9")], EDGE)
    edges = ins.union(outs).union(shut)
    found = match_pattern(edges, [("a", "P", "b"), ("b", "P", "c"), ("a", "P", "c")])
    assert {tuple(r) for r in found.collect()} == {("i5", "hub", "o7"), ("i8", "hub", "o9")}
    with pytest.raises(ValueError):
        match_pattern(edges, [("a", "P", "b"), ("c", "P", "d")])
    with pytest.raises(ValueError):
        match_pattern(edges, [("a", "P", "b")], {"a": "L"})
