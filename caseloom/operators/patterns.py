"""Graph patterns with labels and cycles."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def match_pattern(edges: DataFrame, pattern: Sequence[tuple[str, str, str]], labels: Mapping[str, str] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """All bindings of the variables of ``pattern``, triples (variable, predicate,
    variable), in ``edges(src, pred, dst)``: a column per variable. ``labels`` names the
    label that ``nodes(id, label)`` must give a variable. Two variables may be bound to one
    node; repeated edges count once; a pattern must hang together.

    The order follows counts. The triple comes first from which the fewest rows are made in
    all, by the edges that nodes have on the average, then the
    variable that most triples tie to those bound. If several do, each row takes the
    one under which its node has the fewest edges, and the others only check what that
    finds: a triangle is looked for from its thinner sides, and the pairs of neighbours
    of a hub are never made.
    """
    labels = dict(labels or {})
    if labels and nodes is None:
        raise ValueError("labels need nodes")
    of_label = {label: nodes.filter(F.col("label") == label).select("id").distinct() for label in set(labels.values())}
    sides: list[tuple[str, str, DataFrame, int]] = []
    spread: list[dict[str, float]] = []  # edges of a node at each end, on the average
    for a, pred, b in pattern:
        pairs = edges.filter(F.col("pred") == pred).select(F.col("src").alias("x"), F.col("dst").alias("y")).distinct()
        if a == b:
            pairs = pairs.filter("x = y")
        for side, var in (("x", a), ("y", b)):
            if var in labels:
                pairs = pairs.join(of_label[labels[var]].withColumnRenamed("id", side), side, "left_semi")
        pairs = written(pairs.select("x", "y"), "pattern-edges")
        n = pairs.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("x").alias("x"), F.approx_count_distinct("y").alias("y")).head()
        sides.append((a, b, pairs, n["n"]))
        spread.append({a: n["n"] / max(1, n["x"]), b: n["n"] / max(1, n["y"])})

    start = min(range(len(sides)), key=lambda i: (_rows_made(sides, spread, i), sides[i][3], i))
    a, b, pairs, _ = sides.pop(start)
    rows = pairs.select(F.col("x").alias(a)) if a == b else pairs.select(F.col("x").alias(a), F.col("y").alias(b))
    bound = {a, b}
    while sides:
        ready = [s for s in sides if s[0] in bound and s[1] in bound]
        for s in ready:
            rows = _checked(rows, s, s[0], s[1])
            sides.remove(s)
        if not sides:
            break
        ties = _ties(sides, bound)
        if not ties:
            raise ValueError("the pattern falls apart")
        new = _next(ties)
        rows = _bound(written(rows, "bindings") if len(ties[new]) > 1 else rows, new, ties[new])
        bound.add(new)
        sides = [s for s in sides if s not in ties[new]]
    return rows.select(*dict.fromkeys(v for a, _, b in pattern for v in (a, b)))


def _ties(sides: list, bound: set) -> dict[str, list]:
    """Variables that are one triple away from those bound, with these triples."""
    ties: dict[str, list] = {}
    for s in sides:
        if (s[0] in bound) != (s[1] in bound):
            ties.setdefault(s[1] if s[0] in bound else s[0], []).append(s)
    return ties


def _next(ties: dict[str, list]) -> str:
    return min(ties, key=lambda v: (-len(ties[v]), min(s[3] for s in ties[v]), v))


def _rows_made(sides: list, spread: list, start: int) -> float:
    """Rows of all steps from this triple on, if nodes have their average of edges."""
    degree = {id(s): d for s, d in zip(sides, spread, strict=True)}
    made = rows = float(sides[start][3])
    bound, rest = {*sides[start][:2]}, [s for i, s in enumerate(sides) if i != start]
    while ties := _ties(rest := [s for s in rest if not {s[0], s[1]} <= bound], bound):
        new = _next(ties)
        rows *= min(degree[id(s)][s[0] if s[1] == new else s[1]] for s in ties[new])
        made += rows
        bound.add(new)
    return made


def _checked(rows: DataFrame, side: tuple, left: str, right: str) -> DataFrame:
    """Rows whose two variables are joined by an edge of this triple."""
    pairs = side[2].select(F.col("x").alias(left)) if left == right else side[2].select(F.col("x").alias(left), F.col("y").alias(right))
    return rows.join(pairs, list(dict.fromkeys((left, right))), "left_semi")


def _bound(rows: DataFrame, new: str, ties: list) -> DataFrame:
    """Rows with the variable ``new``, tied to bound ones by each of ``ties``."""
    froms = [(a, "x", "y") if b == new else (b, "y", "x") for a, b, *_ in ties]

    def grown(part: DataFrame, i: int) -> DataFrame:
        have, own, other = froms[i]
        return part.join(ties[i][2].select(F.col(own).alias(have), F.col(other).alias(new)), have)

    if len(ties) == 1:
        return grown(rows, 0)
    for i, (have, own, _) in enumerate(froms):
        rows = rows.join(ties[i][2].groupBy(F.col(own).alias(have)).agg(F.count(F.lit(1)).alias(f"_d{i}")), have)
    least = F.least(*[F.col(f"_d{i}") for i in range(len(ties))])
    choice = functools.reduce(lambda found, i: F.when(F.col(f"_d{i}") == least, i).otherwise(found), reversed(range(len(ties))), F.lit(-1))
    rows = written(rows.withColumn("_choice", choice).drop(*[f"_d{i}" for i in range(len(ties))]), "bindings")
    parts = []
    for i in range(len(ties)):
        part = grown(rows.filter(F.col("_choice") == i).drop("_choice"), i)
        for j, s in enumerate(ties):
            if j != i:
                part = _checked(part, s, s[0], s[1])
        parts.append(part)
    return functools.reduce(lambda x, y: x.unionByName(y), parts)
