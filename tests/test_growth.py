"""What a query moves or does again, seen in its plan and in what it writes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from caseloom.operators import cells, knowledge, patterns
from caseloom.plans import catalog, views
from caseloom.sources import tables

SF = "/root/testdata/sf0.001"


def written_by(monkeypatch, module):
    seen, keep = {}, module.written

    def note(df, name):
        seen.setdefault(name, []).append(keep(df, name))
        return seen[name][-1]

    monkeypatch.setattr(module, "written", note)
    return seen


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_decisions_are_made_distinct_as_numbers(spark, capsys):
    _, decisions, contradictions = views.knowledge(spark, SF)
    for rows in (decisions, contradictions):
        groups = [x for x in plan_of(rows, capsys).splitlines() if "HashAggregate" in x]
        assert groups and all("l_orderkey" in x.split("functions=")[0] and "concept_id" not in x for x in groups)


def concepts_and_lines(spark):
    concepts = spark.createDataFrame([(f"part_{i}", f"bolt {i % 3}", [f"b#{i}"]) for i in range(60)], "id string, name string, aliases array<string>")
    lines = spark.createDataFrame([(f"x{(i * 37) % 900:04d}", f"part_{i % 60}", "UNRESOLVED", "a", "s", "b", "t", "o", "r", "c", "d") for i in range(900)],
                                  "id string, concept_id string, status string, statement_a string, source_a string, statement_b string, source_b string, owner string, rule string, rationale string, effective_date string")
    return concepts, lines.selectExpr("*", "source_a AS source")


def test_context_adds_terms_without_a_hit(spark, monkeypatch):
    seen = written_by(monkeypatch, knowledge)
    concepts, lines = concepts_and_lines(spark)
    terms = spark.createDataFrame([("bolt 1",), ("nowhere",)], "term string")
    rows = knowledge.knowledge_context(terms, concepts, lines).collect()
    assert len(seen["matches"]) == 1  # the rows found are not joined with the terms
    assert sum(r["term"] == "bolt 1" for r in rows) == 300 and [r["decision_id"] for r in rows if not r["found"]] == [None]


def test_gate_opens_only_the_first_concepts(spark, monkeypatch):
    seen = written_by(monkeypatch, knowledge)
    concepts, lines = concepts_and_lines(spark)
    gate = knowledge.contradiction_gate(spark.createDataFrame([("bolt",)], "term string"), concepts, lines, limit=7).first()
    assert seen["first-concepts"][0].count() == 7
    assert gate["unresolved_count"] == 900 and [d["ct_id"] for d in gate["detail"]] == sorted(r["id"] for r in lines.collect())[:7]


def test_links_are_named_before_they_meet_terms(spark, capsys):
    nodes = spark.range(3_000_000).selectExpr("concat('n', id) AS id", "concat('name ', id % 5) AS name")
    edges = spark.range(3_000_000).selectExpr("concat('n', id) AS src", "'E' AS pred", "concat('m', id) AS dst")
    terms = spark.createDataFrame([("name 1",), ("name",)], "term string")
    joins = [x for x in plan_of(knowledge.related_evidence(terms, nodes, edges), capsys).splitlines() if "Join" in x]
    assert "related" not in joins[0] and any("related" in x for x in joins[1:])


def test_pattern_starts_where_fewest_rows_are_made(spark, monkeypatch):
    seen = written_by(monkeypatch, patterns)
    # the fewest edges are those of two hubs, from which every row leads to many
    edges = [(f"o{i}", "OF", f"p{i % 2}") for i in range(200)] + [(f"s{i % 2}", "MAKES", f"p{i % 2}") for i in range(100)] + [(f"o{i}", "BY", f"s{i % 2}") for i in range(200)]
    df = spark.createDataFrame(edges, "src string, pred string, dst string")
    rows = patterns.match_pattern(df, [("o", "OF", "p"), ("s", "MAKES", "p"), ("o", "BY", "s")]).collect()
    assert len(rows) == 200
    sides = [("a", "b", None, 100), ("a", "c", None, 110), ("b", "c", None, 110)]
    # from the first triple a row leads to 50 others, from the second to one
    spread = [{"a": 50.0, "b": 50.0}, {"a": 50.0, "c": 1.0}, {"b": 50.0, "c": 1.0}]
    assert patterns._rows_made(sides, spread, 0) > patterns._rows_made(sides, spread, 1)
    assert seen["pattern-edges"]


def test_updates_are_grouped_once(spark, monkeypatch):
    seen = written_by(monkeypatch, tables)
    rows = [(f"Part {i % 5}", f"D{i}", f"rule {i}", "S", "why", f"{2000 + i % 2}", f"{i:03d}") for i in range(40)]
    updates = spark.createDataFrame(rows, "concept string, domain string, rule string, source string, rationale string, effective_date string, seq string")
    empty = lambda s: spark.createDataFrame([], s)
    concepts, decisions, edges, conflicts = tables.merge_graph(
        empty("id string, name string, domain string, aliases array<string>"), empty("id string, concept_id string, rule string, source string, rationale string, effective_date string"),
        empty("src string, pred string, dst string"), updates)
    assert [df.count() for df in (concepts, decisions, edges, conflicts)] == [5, 10, 10, 30]
    assert {r["id"]: r["domain"] for r in concepts.collect()}["part_4"] == "D39" and {r["id"]: r["rule"] for r in decisions.collect()}["decision_part_1_2000"] == "rule 6"
    assert [df.count() for df in seen["updates"]] == [10]


@pytest.mark.parametrize("name", ["s04_flatten_bundles", "s20_patient_nodes"])
def test_bundles_are_unpacked_once(spark, capsys, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF), capsys)
    assert sum("Generate posexplode" in x for x in plan.split("== Physical Plan ==")[-1].splitlines()) == 1


def test_transactions_read_each_resource_once(spark, capsys):
    assert "get_json_object" not in plan_of(catalog.QUERIES["s05_transaction_bundles"](spark, SF), capsys)


def test_rows_meet_in_few_groups(spark):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(6000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vec array<double>")
    met = cells.Cells(rows, block=64)
    groups = met.meet(rows.withColumnRenamed("id", "query_id"), "query_id", cells.visits_for_nearest(met, 3),
                      lambda q, c: pd.DataFrame({"q": [len(q)], "c": [len(c)]}), "q long, c long").collect()
    assert sum(r["q"] for r in groups) <= 6000 * 2 * cells.MEETINGS and sum(r["c"] for r in groups) <= 6000 * 2 * cells.MEETINGS
    assert max(max(r["q"], r["c"]) for r in groups) < 3 * 6000 // cells.MEETINGS
    near = {r["query_id"]: r["id"] for r in cells.nearest_rows(met, rows.withColumnRenamed("id", "query_id"), 2, lambda q, c: -cells.euclid(q, c), "bigint", "bigint")
            .filter("query_id <> id").groupBy("query_id").agg(F.max_by("id", "sim").alias("id")).collect()}
    d = ((vecs[:50, None] - vecs[None]) ** 2).sum(2)
    d[np.arange(50), np.arange(50)] = np.inf
    assert [near[i] for i in range(50)] == d.argmin(1).tolist()
