"""Patient search, summaries, notes and onboarding readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import filled, hex_id, text, unpack
from .ordering import first_rows


def search_patients(patients: DataFrame, query: str | None = None) -> DataFrame:
    """All by name without a query; else name or condition substring, or id."""
    if not query:
        return patients.orderBy("name", "patient_id")
    q = query.lower()
    return patients.filter(F.lower("name").contains(q) | F.lower("conditions").contains(q)
                           | (F.col("patient_id") == query))


def summary_text() -> Column:
    """Demographics, one line per condition and observation, then the note."""
    labelled = lambda c, label: F.transform(unpack(c), lambda x: F.concat(F.lit(label), x))
    listed = [labelled("conditions", "Condition: "), labelled("observations", "Observation: ")]
    head = F.concat(F.lit("Patient: "), text("name"), F.lit(", "), text("demographics"))
    return F.array_join(F.concat(F.array(head), *listed, F.array(F.concat(F.lit("Note: "), text("notes")))), "\n")


def patient_summary(patients: DataFrame) -> DataFrame:
    return patients.select("patient_id", summary_text().alias("summary"))


def search_notes(docs: DataFrame, query: str | None = None, limit: int | None = None) -> DataFrame:
    """Matching documents per patient, all or the ``limit`` newest with their rank.
    ``docs(patient_id, doc_id, status, date, description)``."""
    hits = docs.filter(F.lower("description").contains(query.lower())) if query else docs
    shown = F.when(filled("description"), F.col("description")).otherwise(F.lit("(no description)"))
    fields = ["patient_id", "doc_id", "status", "date", shown.alias("description")]
    if limit is None:
        return hits.select(*fields)
    return first_rows(hits, ["patient_id"], [F.desc("date"), "doc_id"], limit).select(*fields, "rank")


def readiness_rule(patients: DataFrame, birth: str = "birthDate", gender: str = "gender", telecom: str = "telecom") -> DataFrame:
    """Add ``ready`` and ``issues``: birth date, gender and a contact point.
    ``telecom`` may be an array or a string column."""
    contact = F.col(telecom)
    has_contact = (F.coalesce(F.size(contact) > 0, F.lit(False))
                   if patients.schema[telecom].dataType.typeName() == "array" else filled(contact))
    found = F.array_compact(F.array(
        F.when(~filled(birth), "missing birthDate"), F.when(~filled(gender), "missing gender"),
        F.when(~has_contact, "no contact point")))
    return patients.withColumn("issues", F.array_join(found, ", ")).withColumn("ready", F.size(found) == 0)


def normalise_followup(requests: DataFrame) -> DataFrame:
    """Id required; unknown priorities become routine; a repeatable job id."""
    known = F.lower(text("priority")).isin(*fixed.FOLLOWUP_PRIORITIES)
    out = requests.withColumn("error", F.when(~filled("patient_id"), "patient_id is required"))
    out = out.withColumn("job_id", F.when(F.col("error").isNull(), hex_id(8, "request_id", "patient_id")))
    return out.withColumn("priority", F.when(known, F.lower("priority")).otherwise("routine"))


def followup_outcomes(requests: DataFrame, consent: DataFrame, schedule: DataFrame, writes: DataFrame) -> DataFrame:
    """Consent, then scheduling, then the plan write; the first step that fails
    names the status. All three are equi-joins, so the same function runs on a
    stream with static side tables. ``consent(patient_id, approved)``,
    ``schedule(region, worker_id)``, ``writes(request_id, write_ok)``."""
    joined = (requests.join(consent, "patient_id", "left").join(schedule, "region", "left").join(writes, "request_id", "left"))
    status = (F.when(~F.coalesce("approved", F.lit(False)), "blocked")
              .when(F.col("worker_id").isNull(), "scheduling_failed")
              .when(~F.coalesce("write_ok", F.lit(True)), "fhir_write_failed").otherwise("completed"))
    out = joined.withColumn("status", status)
    return out.select(
        "request_id", "job_id", "patient_id", "status",
        F.when(F.col("status") == "completed", F.concat(F.lit("plan-"), hex_id(12, "request_id"))).alias("care_plan_id"),
        F.when(F.col("status") == "blocked", "Consent not obtained or denied").alias("error"))


def followup_messages(followups: DataFrame) -> DataFrame:
    """Four header rows per accepted follow-up, from a literal flow table."""
    flow = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("target"), F.lit(b).alias("body_class"))
                     for s, t, b in fixed.FOLLOWUP_FLOW])
    return followups.select("request_id", "patient_id", F.posexplode_outer(flow).alias("_i", "m")).select(
        "request_id", "patient_id", (F.col("_i") + 1).alias("seq"), "m.*", F.lit(9).alias("status"))
