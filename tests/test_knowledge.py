import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import knowledge
from caseloom.sources import notes, tables

CONCEPT = "id string, name string, domain string, aliases array<string>"
CONCEPTS = [("food_insecurity_screening", "Food Insecurity Screening", "Economic Stability", ["food insecurity", "hunger screening"]),
            ("housing_instability_threshold", "Housing Instability Threshold", "Neighborhood/Built Environment", ["homelessness risk", "Z59"]),
            ("depression_screening_instrument", "Depression Screening Instrument", "Social Context", ["PHQ", "PHQ-9"])]
DECISION = "id string, concept_id string, rule string, source string, rationale string, effective_date string"
DECISIONS = [(f"decision_{c[0]}_{i}", c[0], f"rule {i}", f"source {i}", "why", f"202{i}-01-01") for c in CONCEPTS for i in (1, 2)]
CONTRA = "id string, concept_id string, statement_a string, source_a string, statement_b string, source_b string, status string, owner string"


def layer(spark, status="UNRESOLVED"):
    rows = [(f"contradiction_{i}", c[0], "a", "SA", "b", "SB", status if i == 0 else "UNRESOLVED", "owner") for i, c in enumerate(CONCEPTS)]
    return spark.createDataFrame(CONCEPTS, CONCEPT), spark.createDataFrame(DECISIONS, DECISION), spark.createDataFrame(rows, CONTRA)


def terms(spark, *t):
    return spark.createDataFrame([(x,) for x in t], "term string")


@pytest.mark.parametrize("status, blocked", [("UNRESOLVED", True), ("RESOLVED", False), ("DEFERRED", False)])
def test_gate_cycle(spark, status, blocked):
    c, _d, x = layer(spark, status)
    g = {r["term"]: r for r in knowledge.contradiction_gate(terms(spark, "Food insecurity", "unknown thing"), c, x).collect()}
    assert g["food insecurity"]["blocked"] == blocked and not g["unknown thing"]["blocked"]
    assert g["food insecurity"]["message"].startswith("BLOCKED: 1" if blocked else "NO_CONTRADICTIONS")
    recs = spark.createDataFrame([(1, "Food insecurity"), (2, "unknown thing"), (3, "never asked")], "rec_id int, concept string")
    kept = {r["rec_id"]: r["allowed"] for r in knowledge.gate_recommendations(recs, knowledge.contradiction_gate(terms(spark, "Food insecurity"), c, x)).collect()}
    assert kept == {1: not blocked, 2: True, 3: True}


def test_context_by_alias_and_short_terms(spark):
    c, d, _x = layer(spark)
    rows = knowledge.knowledge_context(terms(spark, "PHQ-9", "z5", "screening", "nope"), c, d).collect()
    n = {t: sum(1 for r in rows if r["term"] == t and r["decision_id"]) for t in ("phq-9", "z5", "screening", "nope")}
    assert n == {"phq-9": 2, "z5": 2, "screening": 4, "nope": 0} and [r["found"] for r in rows if r["term"] == "nope"] == [False]


def test_substring_join_equals_brute_force(spark):
    import random

    rnd = random.Random(7)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 5))) for _ in range(40)]
    texts = [(i, "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 14)))) for i in range(80)]
    got = {tuple(r) for r in knowledge.substring_join(terms(spark, *words), spark.createDataFrame(texts, "id int, text string")).collect()}
    assert got == {(w, i) for w in words for i, t in texts if w in t}


def test_subgraph_and_evidence(spark):
    c, d, x = layer(spark)
    assert knowledge.contradiction_subgraph(x, c, d).count() == 6
    nodes = spark.createDataFrame([("food_bank", "Food Bank"), ("x1", ""), ("x2", None)], "id string, name string")
    edges = spark.createDataFrame([("x1", "HELPS", "food_bank"), ("food_bank", "NEAR", "x2")], "src string, pred string, dst string")
    r = {(x["relationship"], x["name"]) for x in knowledge.related_evidence(terms(spark, "food bank"), nodes, edges).collect()}
    assert r == {("HELPS", "x1"), ("NEAR", "x2")}


def test_note_review(spark):
    graph = spark.createDataFrame([("a", "UNRESOLVED", None, None), ("b", "UNRESOLVED", None, None), ("c", "RESOLVED", "d1", "w"), ("d", "DEFERRED", None, None), ("e", "UNRESOLVED", None, None)],
                                  "id string, status string, resolved_by string, resolution_rationale string")
    human = spark.createDataFrame([("a", "RESOLVED", "dec1", "because"), ("b", "UNRESOLVED", "", ""), ("c", "UNRESOLVED", "", ""), ("d", "RESOLVED", "", ""), ("e", "UNRESOLVED", "dec2", ""), ("", "RESOLVED", "", "")],
                                  graph.schema)
    got = {r["id"]: (r["action"], r["new_status"], r["new_resolved_by"]) for r in knowledge.note_graph_diff(human, graph).collect()}
    assert got == {"a": ("UPDATE", "RESOLVED", "dec1"), "c": ("REJECTED", None, None), "d": ("UPDATE", "RESOLVED", ""), "e": ("UPDATE", "UNRESOLVED", "dec2")}


def test_merge_graph_keeps_first_decision_and_reports_the_second(spark):
    c, d, _x = layer(spark)
    upd = spark.createDataFrame([("Food Insecurity Screening", "New Domain", "r1", "s1", "w", "2025-01-01", 1), ("Food Insecurity Screening", "Newer Domain", "r2", "s2", "w", "2025-01-01", 2),
                                 ("Brand New", "D", "r3", "s3", "w", "2025-01-01", 3)], "concept string, domain string, rule string, source string, rationale string, effective_date string, seq int")
    edges = spark.createDataFrame([("decision_brand_new_2025-01-01", "GOVERNS", "brand_new")], "src string, pred string, dst string")
    concepts, decisions, e, conflicts = tables.merge_graph(c, d, edges, upd)
    got = {r["id"]: r for r in concepts.collect()}
    assert got["food_insecurity_screening"]["name"] == "Food Insecurity Screening" and got["food_insecurity_screening"]["domain"] == "Newer Domain"
    assert got["brand_new"]["aliases"] == [] and len(got) == 4 and decisions.count() == 8 and e.count() == 2
    assert [(r["rule"], r["seq"]) for r in conflicts.collect()] == [("r2", 2)]
    again = tables.merge_graph(concepts, decisions, e, upd)
    assert again[1].count() == 8 and again[2].count() == 2 and again[3].count() == 3


def test_notes_round_trip(spark, tmp_path):
    c, d, x = layer(spark)
    none = spark.createDataFrame([], "id string, frontmatter map<string,string>")
    first = notes.export_notes(c, d, x, none)
    assert first.groupBy("kind").count().count() == 3 and first.count() == 12
    one = first.filter("id = 'contradiction_0'").first()["text"]
    edited = one.replace("status: UNRESOLVED", "status: RESOLVED\nreviewer: me: too").replace("resolved_by: ", "resolved_by: dec9")
    (tmp_path / "Contradictions").mkdir()
    (tmp_path / "Contradictions" / "contradiction_0.md").write_text(edited)
    (tmp_path / "plain.md").write_text("no frontmatter\n")
    read = notes.read_notes(spark, str(tmp_path))
    got = {r["id"]: r for r in read.collect()}
    assert got["contradiction_0"]["frontmatter"]["reviewer"] == "me: too" and got[None]["body"] == "no frontmatter\n"
    again = notes.export_notes(c, d, x, read.filter("id is not null")).filter("id = 'contradiction_0'").first()
    assert again["frontmatter"]["status"] == "RESOLVED" and again["frontmatter"]["reviewer"] == "me: too" and "[[Decisions/dec9]]" in again["text"]
    diff = knowledge.note_graph_diff(read.filter("id is not null").select("id", *[F.col("frontmatter")[k].alias(k) for k in ("status", "resolved_by", "resolution_rationale")]), x.withColumn("resolved_by", F.lit("")).withColumn("resolution_rationale", F.lit("")))
    assert diff.first()["action"] == "UPDATE"
    notes.write_texts(first, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 12


def test_terms_are_found_by_automata_and_by_grams(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(rng.randint(1, n)))
    terms = sorted({word(5) for _ in range(60)} | {""}) + ["zz"]
    texts = [(i, t) for i, t in enumerate([word(40) for _ in range(200)] + ["", None, "ab" * 9000] + ["aé"] * 30)]
    asked, given = spark.createDataFrame([(t,) for t in terms + terms[:5] + [None]], "term string"), spark.createDataFrame(texts, "id long, text string").repartition(5)
    want = {(t, i) for t in terms if t for i, x in texts if x and t in x}
    for found in (knowledge.substring_join(asked, given), knowledge.substring_join(asked, given, shard_chars=20), knowledge.substring_join(asked, given, most_chars=3)):
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    plan = knowledge.substring_join(asked, spark.createDataFrame(texts, "id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "text" not in plan[: plan.index("MapInArrow")]  # pairs alone are shuffled
    assert knowledge.substring_join(asked.limit(0), given).count() == 0 == knowledge.substring_join(asked, given.limit(0)).count()
