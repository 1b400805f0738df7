import cases as C
from pyspark.sql import functions as F

from caseloom.functions import fixed
from caseloom.operators import patients, playbooks, scoring

MARIA_BLOCK = """SDoH Risk Assessment for maria-gonzalez-001:
  Economic Stability:      HIGH
  Education Access:        HIGH
  Health Care Access:      MEDIUM
  Neighborhood/Built Env:  HIGH
  Social Context:          HIGH
  Transportation Access:   HIGH
Overall Priority: URGENT (5/6 domains elevated)"""


def scored(spark, rules=fixed.SHIPPED_RULES):
    p = C.patients(spark).withColumn("summary", patients.summary_text())
    return scoring.score_domains(p, "summary", rules)


def by_id(df, *cols):
    return {r["patient_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_shipped_rule_counts_and_priorities(spark):
    got = by_id(scored(spark), "high_count", "priority")
    assert got == {"maria-gonzalez-001": (5, "URGENT"), "james-okafor-002": (2, "ROUTINE"), "sarah-kim-003": (3, "HIGH")}


def test_rendered_block(spark):
    assert by_id(scored(spark), "score_text")["maria-gonzalez-001"] == (MARIA_BLOCK,)


def test_health_care_never_low_and_null_text(spark):
    df = spark.createDataFrame([("x", None), ("y", "")], "patient_id string, t string")
    rows = scoring.score_domains(df, "t").collect()
    assert all(r["health_care"] == "MEDIUM" and r["economic"] == "LOW" and r["priority"] == "ROUTINE" for r in rows)


def test_parse_is_the_inverse_of_render(spark):
    s = scored(spark)
    p = scoring.parse_assessment(s).collect()
    assert all(r["domains"][k] == r[k] for r in p for k in C.KEYS) and all(r["parsed_priority"] == r["priority"] for r in p)
    none = scoring.parse_assessment(spark.createDataFrame([("nothing here",)], "score_text string")).first()
    assert none["parsed_priority"] is None and set(none["domains"].values()) == {None}


def test_label_plan_is_the_same_for_everyone(spark):
    plan = scoring.with_plan_steps(scored(spark), "label")
    assert {tuple(r["plan_steps"]) for r in plan.collect()} and plan.select("plan_steps").distinct().count() == 1
    assert scoring.care_plan(scored(spark)).groupBy("patient_id").count().first()["count"] == 6


def test_value_plan_differs(spark):
    plan = scoring.with_plan_steps(scored(spark, fixed.IMPROVED_RULES), "value")
    assert plan.select("plan_steps").distinct().count() == 3


def test_evidence_scale(spark):
    df = spark.createDataFrame([("a", "unemployed, no income, food stamp, debt; at school; alone and isolated")], "patient_id string, t string")
    r = scoring.score_domains_evidence(df, "t").first()
    assert r["economic_stability"] == "HIGH" and r["economic_stability_evidence"] == ["unemploy", "income", "food stamp"]
    assert r["education_access"] == "MEDIUM" and r["healthcare_access"] == "LOW" and r["priority"] == "HIGH" and r["high_count"] == 2


def test_action_brief_modes(spark):
    df = spark.createDataFrame([("a", "lives alone and isolated")], "patient_id string, t string")
    e = scoring.score_domains_evidence(df, "t")
    strict, compat = scoring.action_brief(e).first(), scoring.action_brief(e, compat=True).first()
    assert strict["priority_label"].startswith("ROUTINE") and compat["priority_label"].startswith("HIGH")
    assert len(strict["actions"]) == 2 and len(compat["actions"]) == 5
    assert "--- Risk Summary ---" in strict["brief"]


def test_protocols_and_defaults(spark):
    df = C.patients(spark).withColumn("s", patients.summary_text())
    n = {r["patient_id"]: r["n"] for r in scoring.match_protocols(df, "s").groupBy("patient_id").agg(F.count("*").alias("n")).collect()}
    assert n["maria-gonzalez-001"] == 9  # diabetes 3, blood pressure 2, food 2, transport 2
    none = scoring.match_protocols(spark.createDataFrame([("z", "nothing")], "patient_id string, t string"), "t")
    assert {r["protocol"] for r in none.collect()} == set(fixed.PROTOCOL_DEFAULTS)


def test_community_resources(spark):
    res = spark.createDataFrame(fixed.COMMUNITY_RESOURCES, "prefix string, name string, category string, phone string, services string")
    reqs = spark.createDataFrame([(1, "02115", None), (2, "02115", "food"), (3, "10001", "mental_health"), (4, "99950", None), (5, "99950", "food"), (6, "12", "healthcare")],
                                 "req_id int, zip string, category string")
    n = {r["req_id"]: r["count"] for r in scoring.community_resources(reqs, res).groupBy("req_id").count().collect()}
    assert n == {1: 5, 2: 1, 3: 3, 4: 3, 5: 2, 6: 3}


def test_search_patients(spark):
    p = C.patients(spark)
    hit = lambda q: sorted(r["name"] for r in patients.search_patients(p, q).collect())
    assert [r["name"] for r in patients.search_patients(p).collect()] == ["James Okafor", "Maria Gonzalez", "Sarah Kim"]
    assert hit("maria") == ["Maria Gonzalez"] and hit("HEART") == ["James Okafor"] and hit("sarah-kim-003") == ["Sarah Kim"] and hit("nobody") == []


def test_unpack_stops_at_first_gap(spark):
    from caseloom.functions.columns import unpack

    df = spark.createDataFrame([("a|b||c",), ("",), (None,), ("|x",), ("one",)], "v string")
    assert [r[0] for r in df.select(unpack("v")).collect()] == [["a", "b"], [], [], [], ["one"]]


def test_search_notes_limit_and_blank(spark):
    docs = spark.createDataFrame([("p", i, "current", f"2026-01-{i:02d}", "" if i == 12 else f"note {i}") for i in range(1, 13)],
                                 "patient_id string, doc_id int, status string, date string, description string")
    rows = patients.search_notes(docs, limit=10).orderBy("rank").collect()
    assert len(rows) == 10 and rows[0]["description"] == "(no description)" and patients.search_notes(docs).count() == 12
    assert [r["doc_id"] for r in patients.search_notes(docs, "NOTE 7").collect()] == [7]


def test_playbook_states(spark):
    p = C.patients(spark).withColumn("follow_up", F.lit("no")).withColumn("priority_asked", F.lit(None).cast("string"))
    p = p.unionByName(p.limit(1).withColumn("patient_id", F.lit("")))
    none = spark.createDataFrame([], "patient_id string, approve boolean, approver string")
    runs, steps = playbooks.playbook_batch(p, none)
    got = by_id(runs, "status")
    assert got["maria-gonzalez-001"] == ("awaiting_approval",) and got["james-okafor-002"] == ("succeeded",) and got[""] == ("failed",)
    yes = spark.createDataFrame([("maria-gonzalez-001", True, "lead")], none.schema)
    out = by_id(playbooks.assess_all(p, yes), "output")["maria-gonzalez-001"][0]
    assert "Follow-up triggered for maria-gonzalez-001 (priority=urgent)" in out and MARIA_BLOCK in out
    no = spark.createDataFrame([("maria-gonzalez-001", False, "lead")], none.schema)
    runs, steps = playbooks.playbook_batch(p, no)
    assert by_id(runs, "status")["maria-gonzalez-001"] == ("succeeded",)
    assert by_id(runs, "output")[""] == ("ERROR: patientId is required",)
    assert steps.filter("state = 'rejected'").count() == 1
