import cases as C
import pytest
from pyspark.sql import functions as F

from caseloom.functions import fixed
from caseloom.operators import evals, patients, scoring


def assessed(spark, rules):
    p = C.patients(spark).select("patient_id", patients.summary_text().alias("summary"))
    c = C.cases(spark).join(p, "patient_id").withColumn("text", F.coalesce("agent_summary", "summary"))
    return scoring.score_domains(c, "text", rules)


def test_l1_three_of_four(spark):
    r = {x["case_id"]: x for x in evals.eval_rule_regression(assessed(spark, fixed.SHIPPED_RULES)).collect()}
    assert sum(x["passed"] for x in r.values()) == 3
    assert not r["maria-paraphrase-adversarial"]["passed"] and len(r["maria-paraphrase-adversarial"]["mismatches"]) == 6


@pytest.mark.parametrize("rules, recall", [(fixed.SHIPPED_RULES, 0.714), (fixed.IMPROVED_RULES, 1.0)])
def test_l1b_recall_and_precision(spark, rules, recall):
    h = evals.eval_vs_human(assessed(spark, rules))
    m = evals.micro_average(h).first()
    assert (m["micro_recall"], m["micro_precision"]) == (recall, 1.0)
    if recall < 1:
        maria = h.filter("case_id = 'maria-complete'").first()
        assert maria["recall"] == 0.833 and maria["missed"] == ["health_care"] and maria["priority_match"]


def test_l2_l3(spark):
    t = evals.eval_trajectory(C.cases(spark), C.steps(spark)).collect()
    assert all(r["passed"] and r["precision"] == r["recall"] == 1.0 for r in t)
    o = evals.eval_outcome(C.cases(spark), C.messages(spark)).collect()
    assert all(r["passed"] for r in o) and sorted(r["n_messages"] for r in o) == [0, 4, 4, 4]


def test_l2_finds_wrong_order_missing_and_extra(spark):
    case = C.cases(spark).filter("case_id = 'sarah-assess-only'")
    rows = [("sarah-assess-only", i, t, "") for i, t in enumerate(["DraftCarePlan", "AssessSDoHRisk", "SearchPatients", "TriggerFollowUp", "Other"])]
    r = evals.eval_trajectory(case, spark.createDataFrame(rows, "case_id string, pos int, tool string, result string")).first()
    assert not r["passed"] and not r["assessed_before_plan"] and r["started_before_trigger"] and not r["followup_expectation_met"]
    assert r["missing"] == ["FetchPatientSummary", "SearchSDoHProtocols"] and r["extra"] == ["Other", "TriggerFollowUp"]
    none = evals.eval_trajectory(case, spark.createDataFrame([], "case_id string, pos int, tool string, result string")).first()
    assert none["precision"] == 0.0 and none["recall"] == 0.0 and none["assessed_before_plan"]


def test_l4(spark):
    rows = [("a", "fine", 4, 5, 4), ("b", "he is AFFORDING insulin badly", 4, 5, 4), ("c", "x", None, None, None), ("d", "x", 3, None, None)]
    df = spark.createDataFrame(rows, "case_id string, final_text string, actionable int, privacy_respected int, no_fabrication int")
    got = {r["case_id"]: (r["passed"], r["privacy_respected"]) for r in evals.eval_quality(df).collect()}
    assert got == {"a": (True, 5), "b": (False, 2), "c": (False, None), "d": (True, None)}


@pytest.mark.parametrize("rules, mode, passed, plans", [(fixed.SHIPPED_RULES, "label", False, 1), (fixed.IMPROVED_RULES, "value", True, 3)])
def test_l5_fail_then_pass(spark, rules, mode, passed, plans):
    a = scoring.parse_assessment(assessed(spark, rules).filter("not adversarial"))
    p = evals.plan_bodies(scoring.with_plan_steps(a, mode)).select("patient_id", evals.plan_profile(F.col("domains")).alias("profile"), "body")
    pairs, summary = evals.eval_differentiation(p)
    s = summary.first()
    assert (s["passed"], s["distinct_plans"], s["patients_compared"]) == (passed, plans, 3) and s["all_identical"] == (plans == 1)
    assert sum(r["n_pairs"] for r in pairs.collect()) == s["n_violations"] == (0 if passed else 3)


def test_suite_and_comparison(spark):
    a = assessed(spark, fixed.SHIPPED_RULES)
    s = {r["layer"]: r for r in evals.eval_suite({"L1_rule_regression": evals.eval_rule_regression(a), "L2_trajectory": evals.eval_trajectory(C.cases(spark), C.steps(spark)),
                                                  "L3_outcome": evals.eval_outcome(C.cases(spark), C.messages(spark))}).collect()}
    assert (s["L1_rule_regression"]["passed"], s["L1_rule_regression"]["total"], s["L1_rule_regression"]["failed_gate"]) == (3, 4, True)
    assert not s["L2_trajectory"]["failed_gate"] and s["L3_outcome"]["passed"] == 4
    d = {r["metric"]: r for r in evals.compare_rules(a.select("case_id", "text", "human_domains", "human_priority", "adversarial"), "text", fixed.SHIPPED_RULES, fixed.IMPROVED_RULES).collect()}
    assert (d["micro_recall"]["a"], d["micro_recall"]["b"], d["micro_recall"]["delta"]) == (0.714, 1.0, 0.286)


def test_last_result_and_order(spark):
    s = C.steps(spark).withColumnRenamed("case_id", "run_id")
    r = {(x["run_id"], x["tool"]): x["result"] for x in evals.last_result(s, ["TriggerFollowUp", "DraftCarePlan"]).collect()}
    assert r[("sarah-assess-only", "TriggerFollowUp")] == "" and r[("maria-complete", "DraftCarePlan")] == "DraftCarePlan of maria-complete"
    assert all(x["ok"] for x in evals.ordering_constraint(s, "StartProduction", "TriggerFollowUp").collect())
    assert not any(x["ok"] for x in evals.ordering_constraint(s, "DraftCarePlan", "SearchPatients").collect())
