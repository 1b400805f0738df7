import json

import cases as C
import pytest
from pyspark.sql import functions as F

from caseloom.operators import knowledge
from caseloom.sources import fhir, notes, otlp, tables


def test_read_tickets_file(spark, tmp_path):
    rows = [{"ticket_id": "PC-1", "Classification": "BILLING", "Summary": "s" * 600, "Problem": "p" * 4000, "Solution": "x", "has_solution": True},
            {"ticket_id": "PC-2", "Summary": "a", "Problem": "b", "has_solution": 1}, {"ticket_id": "PC-3", "has_solution": "true"}, {"ticket_id": "PC-4", "has_solution": False}, {"ticket_id": ""}]
    (tmp_path / "t.json").write_text(json.dumps(rows))
    got = {r["ticket_id"]: r for r in tables.read_tickets(spark, str(tmp_path / "t.json")).collect()}
    assert sorted(got) == ["PC-1", "PC-2", "PC-3", "PC-4"] and [got[f"PC-{i}"]["has_solution"] for i in (1, 2, 3, 4)] == [True, True, True, False]
    assert len(got["PC-1"]["full_content"]) == len(got["PC-1"]["summary"]) + 1 + len(got["PC-1"]["problem"]) and len(got["PC-1"]["summary"]) == 600 and got["PC-2"]["full_content"] == "a b"


def test_load_if_absent(spark):
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    old = spark.createDataFrame([("b", 9)], "k string, v int")
    assert tables.load_if_absent(new, old, "k").count() == 0 and tables.load_if_absent(new, old.limit(0), "k").count() == 2
    assert [tuple(r) for r in tables.load_if_absent(new, old, "k", skip_if_any=False).collect()] == [("a", 1)]
    assert tables.load_if_absent(new, old, "k", skip_if_any=True).count() == 0 and tables.load_if_absent(new, old.limit(0), "k", skip_if_any=True).count() == 2


def test_wiki_pages_and_gaps(spark, tmp_path):
    (tmp_path / "billing.md").write_text("# Billing\n\n_Last updated: 2025-11-12_\n\n## Knowledge Gaps\n")
    (tmp_path / "lab.md").write_text("# Lab\n\n*Last updated: 2025-01-01*\nThis is UNDOCUMENTED\n")
    (tmp_path / "plain.md").write_text("text\n")
    (tmp_path / "README.md").write_text("# no\n")
    got = {r["file"]: (r["title"], r["last_updated"], r["has_gaps"]) for r in notes.read_wiki(spark, str(tmp_path)).collect()}
    assert got == {"billing.md": ("Billing", "_Last updated: 2025-11-12_", True), "lab.md": ("Lab", "*Last updated: 2025-01-01*", True), "plain.md": ("", "", False)}


def test_publish_creates_extends_and_keeps(spark):
    pages = spark.createDataFrame([("billing", "# B\n*Run the KB Mining notebook to auto-generate articles for these gaps.*"), ("other", "# O")], "slug string, text string")
    arts = spark.createDataFrame([("BILLING", "body", [f"PC-{i}" for i in range(10)]), ("WAITING LISTS", "body", [])], "category string, article_text string, source_tickets array<string>")
    got = {r["slug"]: r for r in notes.publish_article(pages, arts, F.lit("2024-01-31 10:00:00").cast("timestamp")).collect()}
    assert [got[k]["action"] for k in ("billing", "other", "waiting_lists")] == ["augmented", "kept", "created"]
    assert "Partially addressed" in got["billing"]["text"] and "PC-8, PC-9" in got["billing"]["text"]
    assert got["waiting_lists"]["article_id"] == "KB-PC-WAITING_LISTS" and got["other"]["text"] == "# O"


def test_published_articles_count_all_solved_tickets_and_show_eight(spark):
    from caseloom.plans import catalog_sources

    t = spark.createDataFrame([(i, f"PC-{i:02}", "A" if i < 12 else "B", i != 3, "s", "p", "x") for i in range(14)],
                              "doc_id long, ticket_id string, category string, has_solution boolean, summary string, problem string, solution string")
    got = {r["slug"]: r["text"] for r in catalog_sources.published(t).collect()}
    all_of = [f"PC-{i:02}" for i in range(12) if i != 3]
    assert "11 support tickets" in got["a"] and f"**Source tickets:** {', '.join(all_of[:8])}...\n" in got["a"]
    beside = [tuple(r) for r in notes.article_sources(t).collect()]  # every one of them, as rows
    assert sorted(i for a, i in beside if a == "KB-PC-A") == all_of
    assert "**Source tickets:** PC-12, PC-13\n" in got["b"]


def test_triples_and_provenance(spark):
    arts = spark.createDataFrame([("KB-PC-X", "X", "2024", "PC-1, PC-2,,PC-9"), ("KB-PC-Y", "Y", "2024", "")], "article_id string, category string, generated_at string, source_tickets string")
    props, edges = tables.append_triples(arts)
    assert props.count() == 6 and edges.filter("pred = 'AUTHORED_KB'").count() == 2
    assert {r["src"] for r in edges.filter("pred = 'SOURCED_KB'").collect()} == {"pc_ticket:PC-1", "pc_ticket:PC-2"}
    trail = knowledge.provenance_trail(edges, props).collect()
    assert len(trail) == 3 and {(r["article_id"], r["ticket"]) for r in trail} == {("KB-PC-X", "pc_ticket:PC-1"), ("KB-PC-X", "pc_ticket:PC-2"), ("KB-PC-Y", None)}


def test_triples_of_one_row_per_ticket(spark):
    arts = spark.createDataFrame([("KB-PC-X", "X", "2024"), ("KB-PC-Y", "Y", "2024")], "article_id string, category string, generated_at string")
    sources = spark.createDataFrame([("KB-PC-X", " PC-1"), ("KB-PC-X", "PC-2"), ("KB-PC-X", ""), ("KB-PC-Y", None)], "article_id string, ticket_id string")
    props, edges = tables.append_triples(arts, sources=sources)
    assert props.count() == 6 and edges.filter("pred = 'AUTHORED_KB'").count() == 2
    assert {(r["src"], r["dst"]) for r in edges.filter("pred = 'SOURCED_KB'").collect()} == {("pc_ticket:PC-1", "kb_article:KB-PC-X"), ("pc_ticket:PC-2", "kb_article:KB-PC-X")}
    assert "collect_list" not in edges._jdf.queryExecution().executedPlan().toString()


def test_golden_cases_and_stubs(spark, tmp_path):
    doc = {"cases": C.CASES}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    g = tables.read_golden_cases(spark, str(tmp_path / "g.json"))
    assert g.count() == 4 and g.filter("case_id = 'maria-complete'").first()["rule_domains"]["health_care"] == "MEDIUM" and not g.first()["adversarial"]
    (tmp_path / "s.json").write_text(json.dumps([{"id": "k1", "title": "t", "crisis_level": "high"}, {"id": "k2"}]))
    assert tables.read_kb_stubs(spark, str(tmp_path / "s.json")).count() == 2


BUNDLE = {"resourceType": "Bundle", "type": "collection", "entry": [
    {"fullUrl": "urn:1", "resource": {"resourceType": "Patient", "id": "p1", "birthDate": "1980-01-01", "telecom": [{"system": "phone", "value": "1"}]}},
    {"resource": {"resourceType": "Condition", "code": {"text": "Diabetes", "coding": [{"system": "http://snomed.info/sct", "code": "1"}]}}},
    {"resource": {"resourceType": "Observation", "id": "o1", "code": {"text": "HbA1c"}}, "request": {"method": "DELETE", "url": "x"}},
    {"resource": {"resourceType": "DocumentReference", "id": "d1", "description": "n" * 150}}]}


def test_bundles(spark):
    df = spark.createDataFrame([("a", json.dumps(BUNDLE)), ("b", "{broken"), ("c", json.dumps({"resourceType": "Bundle"}))], "file string, j string")
    flat = fhir.flatten_bundles(df, "j", ["file"])
    assert flat["Patient"].first()["birthDate"] == "1980-01-01" and flat["Condition"].first()["code"]["text"] == "Diabetes" and flat["Encounter"].count() == 0
    t = fhir.to_transaction_bundles(df, "j")
    got = {r["file"]: r for r in t.collect()}
    made = json.loads(got["a"]["bundle_json"])
    assert made["type"] == "transaction" and [e["request"]["url"] for e in made["entry"]] == ["Patient/p1", "Condition", "x", "DocumentReference/d1"]
    assert made["entry"][0]["fullUrl"] == "urn:1" and made["entry"][1]["request"]["method"] == "POST" and made["entry"][0]["request"]["method"] == "PUT"
    assert [got[k]["ok"] for k in "abc"] == [True, False, True] and got["c"]["n_entries"] == 0
    assert tuple(fhir.load_counts(t).first()) == (2, 1)


def test_patient_nodes_limit(spark):
    many = {"entry": [{"resource": {"resourceType": "Condition", "code": {"text": f"c{i:02d}"}}} for i in range(30)]}
    df = spark.createDataFrame([("p1", json.dumps(BUNDLE)), ("p2", json.dumps(many)), ("p3", "{}")], "patient_id string, j string")
    assert fhir.patient_nodes(df, "j", F.lit("2024")).filter("node_id = 'patient-p2'").first()["summary"].count("\n") == 29
    rows = fhir.patient_nodes(df, "j", F.lit("2024"), limit=20, note_cut=100).collect()
    got = {r["node_id"]: r["summary"] for r in rows}
    assert {r["node_id"]: r["n_more"] for r in rows} == {"patient-p1": 0, "patient-p2": 10, "patient-p3": 0}
    assert got["patient-p1"] == "Condition: Diabetes\nObs: HbA1c\nNote: " + "n" * 100 and got["patient-p3"] == ""
    assert got["patient-p2"].count("\n") == 19 and got["patient-p2"].endswith("c19")


def test_otlp_values_are_typed(spark):
    attr = lambda k, v: {"key": k, "value": v}
    span = {"traceId": "t", "spanId": "s", "startTimeUnixNano": "1000000", "endTimeUnixNano": "3500000", "status": {"code": 2},
            "attributes": [attr("a", {"stringValue": ""}), attr("b", {"intValue": "0"}), attr("c", {"boolValue": False}), attr("a", {"stringValue": "later"})]}
    r = otlp.spans_from_otlp(spark.createDataFrame([(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]}),), ("{}",)], "j string"), "j").collect()
    assert len(r) == 1 and r[0]["attributes"] == {"a": "later", "b": "0", "c": "false"} and r[0]["duration_ms"] == 2.5 and r[0]["parent_span_id"] == "" and r[0]["status"] == 2


def test_vector_text(spark):
    good = spark.createDataFrame([("a", "0.1,-0.25,3")], "id string, csv string")
    assert tables.vectors_from_csv(good, "csv", 3).first()["vec"] == [0.1, -0.25, 3.0]
    with pytest.raises(Exception, match="vector dimension is not 4"):
        tables.vectors_from_csv(good, "csv", 4).collect()
