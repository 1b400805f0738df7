"""Five-layer evaluation of rule sets and agent trajectories, for all cases at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import contains_any, text
from ..session import written
from .scoring import parse_assessment, plan_body, score_domains


def _high(domains: str) -> Column:
    return F.map_keys(F.map_filter(domains, lambda k, v: v == "HIGH"))


def eval_rule_regression(cases: DataFrame) -> DataFrame:
    """Exact domain and priority match. Needs ``score_text``, ``rule_domains``
    (map) and ``rule_priority``."""
    got = parse_assessment(cases)
    wrong = F.filter(F.map_keys("rule_domains"), lambda k: ~F.try_element_at("domains", k)
                     .eqNullSafe(F.try_element_at("rule_domains", k)))
    out = got.withColumn("mismatches", F.array_sort(wrong))
    ok = F.col("parsed_priority").eqNullSafe(F.col("rule_priority"))
    return out.select("case_id", ((F.size("mismatches") == 0) & ok).alias("passed"), "mismatches",
                      F.col("rule_priority").alias("priority_expected"), F.col("parsed_priority").alias("priority_got"))


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def eval_vs_human(cases: DataFrame) -> DataFrame:
    """Precision and recall of HIGH domains against ``human_domains``."""
    got = parse_assessment(cases).withColumn("_p", _high("domains")).withColumn("_t", _high("human_domains"))
    got = (got.withColumn("tp", F.size(F.array_intersect("_p", "_t"))).withColumn("fp", F.size(F.array_except("_p", "_t")))
           .withColumn("fn", F.size(F.array_except("_t", "_p"))))
    got = got.withColumn("_pr", _ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)).withColumn(
        "_re", _ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0))
    f1 = _ratio(2 * F.col("_pr") * F.col("_re"), F.col("_pr") + F.col("_re"), 0.0)
    return got.select("case_id", "tp", "fp", "fn", F.round("_pr", 3).alias("precision"), F.round("_re", 3).alias("recall"),
                      F.round(f1, 3).alias("f1"), F.array_sort(F.array_except("_t", "_p")).alias("missed"),
                      F.col("parsed_priority").eqNullSafe(F.col("human_priority")).alias("priority_match"), "adversarial")


def micro_average(vs_human: DataFrame) -> DataFrame:
    """Micro recall and precision over the non-adversarial cases."""
    sums = vs_human.filter(~F.col("adversarial")).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return sums.select(F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0), 3).alias("micro_recall"),
                       F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), 3).alias("micro_precision"))


def order_ok(a: str, b: str, tool: str = "tool", pos: str = "pos") -> Column:
    """Aggregate: every ``a`` call before every ``b`` call, vacuously true."""
    return F.coalesce(F.max(F.when(F.col(tool) == a, F.col(pos))) < F.min(F.when(F.col(tool) == b, F.col(pos))), F.lit(True))


def ordering_constraint(steps: DataFrame, a: str, b: str, run: str = "run_id") -> DataFrame:
    return steps.groupBy(run).agg(order_ok(a, b).alias("ok"))


def last_result(steps: DataFrame, tools: Sequence[str] | None = None, run: str = "run_id") -> DataFrame:
    """Newest result per run and tool; '' for listed tools a run never called."""
    rows = steps.filter(F.col("tool").isin(*tools)) if tools else steps
    found = rows.groupBy(run, "tool").agg(F.max_by("result", "pos").alias("result"))
    if not tools:
        return found
    wanted = steps.select(run).distinct().select(run, F.explode_outer(F.array(*[F.lit(t) for t in tools])).alias("tool"))
    return wanted.join(found, [run, "tool"], "left").withColumn("result", text("result"))


ORDER_RULES = (("AssessSDoHRisk", "DraftCarePlan"), ("StartProduction", "TriggerFollowUp"))


def eval_trajectory(cases: DataFrame, steps: DataFrame, order_rules: Sequence[tuple[str, str]] = ORDER_RULES,
                    side_effect: str = "TriggerFollowUp") -> DataFrame:
    """Tool-set coverage, two ordering rules and the side-effect expectation.
    Needs ``expected_trajectory`` (array) and ``expect_followup``."""
    (a1, b1), (a2, b2) = order_rules
    seen = steps.groupBy("case_id").agg(F.collect_set("tool").alias("_got"), order_ok(a1, b1).alias("assessed_before_plan"),
                                        order_ok(a2, b2).alias("started_before_trigger"))
    got = F.coalesce(F.col("_got"), F.array().cast("array<string>"))
    out = cases.join(seen, "case_id", "left").withColumn("_g", got).withColumn("_e", F.array_distinct("expected_trajectory"))
    both = F.size(F.array_intersect("_g", "_e"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(True))
    out = out.withColumn("missing", F.array_sort(F.array_except("_e", "_g"))).withColumn(
        "extra", F.array_sort(F.array_except("_g", "_e")))
    met = F.array_contains("_g", side_effect) == F.col("expect_followup")
    return out.select(
        "case_id", ((F.size("missing") == 0) & flag("assessed_before_plan") & flag("started_before_trigger") & met).alias("passed"),
        F.round(_ratio(both, F.size("_g"), 0.0), 3).alias("precision"), F.round(_ratio(both, F.size("_e"), 1.0), 3).alias("recall"),
        "missing", "extra", flag("assessed_before_plan").alias("assessed_before_plan"),
        flag("started_before_trigger").alias("started_before_trigger"), met.alias("followup_expectation_met"))


def eval_outcome(cases: DataFrame, messages: DataFrame) -> DataFrame:
    """Did the side effect happen exactly when expected? ``messages(case_id, patient_id)``."""
    counts = messages.groupBy("case_id", "patient_id").agg(F.count(F.lit(1)).alias("_n"))
    out = cases.join(counts, ["case_id", "patient_id"], "left").withColumn("n_messages", F.coalesce("_n", F.lit(0)))
    fired = F.col("n_messages") > 0
    return out.select("case_id", (fired == F.col("expect_followup")).alias("passed"), fired.alias("fired"), "n_messages")


def eval_quality(cases: DataFrame, phrases: Sequence[str] = tuple(fixed.LEAK_PHRASES)) -> DataFrame:
    """Three rubric scores (input columns); a raw phrase in the final text sets
    privacy to 2. Passes when a score exists and the least is at least 3."""
    privacy = F.when(contains_any(F.lower(text("final_text")), phrases), F.lit(2)).otherwise(F.col("privacy_respected"))
    out = cases.withColumn("privacy_respected", privacy)
    least = F.least("actionable", "privacy_respected", "no_fabrication")
    return out.select("case_id", F.coalesce(least >= 3, F.lit(False)).alias("passed"), "actionable", "privacy_respected",
                      "no_fabrication")


def plan_profile(domains: Column) -> Column:
    """Elevated domains a plan can act on, sorted, as one text key."""
    keys = F.map_keys(F.map_filter(domains, lambda k, v: (v == "HIGH") & k.isin(*fixed.PLAN_DOMAINS)))
    return F.array_join(F.array_sort(keys), ",")


def eval_differentiation(plans: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Do different needs get different plans? ``plans(patient_id, profile,
    body)``, and the columns ``by`` that tell kinds of plans apart. Patients are
    first grouped by (body, profile), of which there are at most 2^domains per
    body; violations pair those groups, so nothing grows with the square of the
    patients. ``n_pairs`` is the number of patient pairs."""
    by = list(by)
    groups = plans.groupBy(*by, F.sha2("body", 256).alias("plan_id"), "profile").agg(
        F.count(F.lit(1)).alias("n"), F.min("patient_id").alias("first_patient"))
    groups = written(groups, "plan-groups")  # short, and read three times below
    a = groups.select(*by, "plan_id", F.col("profile").alias("profile_a"), F.col("n").alias("_na"), F.col("first_patient").alias("patient_a"))
    b = groups.select(*by, "plan_id", F.col("profile").alias("profile_b"), F.col("n").alias("_nb"), F.col("first_patient").alias("patient_b"))
    pairs = a.join(b, [*by, "plan_id"]).filter(F.col("profile_a") < F.col("profile_b")).select(
        *by, "plan_id", "profile_a", "profile_b", "patient_a", "patient_b", (F.col("_na") * F.col("_nb")).alias("n_pairs"))
    per_plan = groups.groupBy(*by, "plan_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("q"))
    bad = (F.col("t") * F.col("t") - F.col("q")) / 2
    summary = per_plan.groupBy(*by).agg(F.count(F.lit(1)).alias("distinct_plans"), F.coalesce(F.sum("t"), F.lit(0)).alias("patients_compared"),
                                        F.coalesce(F.sum(bad), F.lit(0.0)).cast("long").alias("n_violations"))
    return pairs, summary.select(
        *by, (F.col("n_violations") == 0).alias("passed"), "distinct_plans", "patients_compared",
        ((F.col("distinct_plans") == 1) & (F.col("patients_compared") > 1)).alias("all_identical"), "n_violations")


def plan_bodies(planned: DataFrame) -> DataFrame:
    return planned.withColumn("body", plan_body(F.col("plan_steps")))


def eval_suite(layers: dict[str, DataFrame]) -> DataFrame:
    """``passed``/``total`` per layer name from per-case results, plus how many
    of the first three layers failed anywhere (the gate)."""
    rows = reduce(lambda x, y: x.unionByName(y), [d.select(F.lit(name).alias("layer"), "passed") for name, d in layers.items()])
    out = rows.groupBy("layer").agg(F.sum(F.col("passed").cast("long")).alias("passed"), F.count(F.lit(1)).alias("total"))
    gating = F.col("layer").rlike("^L[123]_")
    return out.withColumn("failed_gate", gating & (F.col("passed") < F.col("total")))


def compare_rules(cases: DataFrame, text_col: str, rules_a: Sequence[tuple], rules_b: Sequence[tuple]) -> DataFrame:
    """The same cases under two rule sets: metric, a, b, delta. ``cases`` has
    case_id, ``text_col``, human_domains, human_priority, adversarial."""
    def measured(rules, variant):
        scored = score_domains(cases, text_col, rules, id_col="case_id")
        h = eval_vs_human(scored).filter(~F.col("adversarial"))
        return h.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.sum(F.col("priority_match").cast("long")).alias("pm"),
                     F.count(F.lit(1)).alias("n")).select(
            F.lit(variant).alias("variant"), F.explode_outer(F.array(
                F.struct(F.lit("micro_recall").alias("metric"), F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0), 3).alias("v")),
                F.struct(F.lit("micro_precision").alias("metric"), F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), 3).alias("v")),
                F.struct(F.lit("priority_match").alias("metric"), F.round(_ratio(F.col("pm"), F.col("n"), 0.0), 3).alias("v")))).alias("m"))
    both = measured(rules_a, "a").unionByName(measured(rules_b, "b")).select("variant", "m.*")
    return both.groupBy("metric").agg(F.max(F.when(F.col("variant") == "a", F.col("v"))).alias("a"),
                                      F.max(F.when(F.col("variant") == "b", F.col("v"))).alias("b")).withColumn(
        "delta", F.round(F.col("b") - F.col("a"), 3))


def case_outcome_join(cases: DataFrame, steps: DataFrame, messages: DataFrame, tools: Sequence[str]) -> DataFrame:
    """Cases with the last result of each listed tool and their message count."""
    last = steps.filter(F.col("tool").isin(*tools)).groupBy("case_id").agg(
        *[F.max_by("result", F.when(F.col("tool") == t, F.col("pos"))).alias(t) for t in tools])
    n = messages.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_messages"))
    out = cases.join(last, "case_id", "left").join(n, "case_id", "left")
    for t in tools:
        out = out.withColumn(t, text(t))
    return out.withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))
