"""A declared sequence of steps for all rows of a table at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import condition_expr, filled, hex_id, template_expr, text
from .patients import summary_text
from .scoring import plan_text, protocols_for, score_domains, with_plan_steps

STEPS = ["FetchPatientSummary", "SearchSDoHProtocols", "AssessSDoHRisk", "DraftCarePlan", "TriggerFollowUp", "GetInteropTraces"]


def playbook_batch(patients: DataFrame, decisions: DataFrame, rules=None, thresholds=None) -> tuple[DataFrame, DataFrame]:
    """Summary, protocols, score, plan, conditional follow-up, trace. ``patients``
    adds ``follow_up`` and ``priority_asked``; ``decisions(patient_id, approve,
    approver)`` holds human decisions, joined on the id. URGENT always asks for a
    follow-up, other patients only on request. Without a decision the run waits;
    a rejection is a decision and does not fail the run; a missing id is an
    error and stops it. Returns (runs, run_steps)."""
    base = patients.withColumn("run_id", hex_id(16, F.lit("run"), "patient_id"))
    base = base.withColumn("_ok", filled("patient_id")).withColumn("_summary", summary_text())
    base = base.withColumn("_protocols", protocols_for(F.col("_summary")))
    extra = {k: v for k, v in (("rules", rules), ("thresholds", thresholds)) if v is not None}
    scored = plan_text(with_plan_steps(score_domains(base, "_summary", **extra), "label"))
    urgent = condition_expr([{"column": "score_text", "op": "contains", "literal": "Overall Priority: URGENT"}])
    asked = condition_expr([
        {"group": 0, "column": "follow_up"},
        {"group": 0, "column": "score_text", "op": "contains", "literal": "Overall Priority: URGENT", "negate": True}])
    wants = F.col("_ok") & (urgent | asked)
    level = F.when(urgent, F.lit("urgent")).otherwise(template_expr([("priority_asked", ("default", "routine"))]))
    d = decisions.select("patient_id", F.col("approve").alias("_approve"), "approver")
    rows = scored.withColumn("_wants", wants).withColumn("_level", level).join(d, "patient_id", "left")
    waiting = F.col("_wants") & F.col("_approve").isNull()
    fired = F.col("_wants") & F.coalesce("_approve", F.lit(False))
    job = hex_id(8, F.lit("job"), "patient_id")
    follow = (F.when(fired, F.concat(F.lit("Follow-up triggered for "), F.col("patient_id"), F.lit(" (priority="), F.col("_level"), F.lit(") jobId="), job))
              .when(F.col("_wants") & ~waiting, F.concat(F.lit("REJECTED by "), text("approver"))))
    rows = rows.withColumn("_follow", follow).withColumn("_fired", fired).withColumn(
        "status", F.when(~F.col("_ok"), "failed").when(waiting, "awaiting_approval").otherwise("succeeded"))
    output = (F.when(F.col("status") == "failed", "ERROR: patientId is required")
              .when(F.col("status") == "awaiting_approval", F.concat(F.lit("AWAITING_APPROVAL "), F.col("run_id")))
              .otherwise(template_expr(["", ("score_text",), "\n\n", ("plan_text",), "\n\nFollow-up: ", ("_follow", ("default", "not triggered"))])))
    runs = rows.select("run_id", "patient_id", "status", "priority", "high_count", "_level", output.alias("output"))
    runs = runs.withColumnRenamed("_level", "followup_priority")
    done = F.col("_ok")
    state = lambda cond, wait=None: (F.when(~done, "not_run").when(wait if wait is not None else F.lit(False), "waiting")
                                     .when(cond, "done").otherwise("skipped"))
    first = F.when(done, "done").otherwise("error")
    steps = F.array(*[
        F.struct(F.lit(i + 1).alias("seq"), F.lit(tool).alias("tool"), s.alias("state"))
        for i, (tool, s) in enumerate(zip(STEPS, [
            first, state(F.lit(True)), state(F.lit(True)), state(F.lit(True)),
            F.when(F.col("_wants") & F.col("_approve").isNotNull() & ~F.col("_approve"), "rejected").otherwise(state(F.col("_fired"), waiting)),
            state(F.col("_fired"), waiting)]))])
    return runs, rows.select("run_id", F.explode_outer(steps).alias("s")).select("run_id", "s.*")


def assess_all(patients: DataFrame, decisions: DataFrame, rules=None, thresholds=None) -> DataFrame:
    """One answer line per patient, as if asked row by row from SQL."""
    runs, _ = playbook_batch(patients, decisions, rules, thresholds)
    return runs.select("patient_id", "run_id", "status", "output")


def step_counts(steps: DataFrame) -> DataFrame:
    return steps.groupBy("tool", "state").agg(F.count(F.lit(1)).alias("n"))

