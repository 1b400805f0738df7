"""Is a FHIR store complete enough for assessments? Five checks, one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import filled


def _check(df: DataFrame, name: str, ok: Column, floor: float, empty: float, detail: str) -> DataFrame:
    counted = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(ok.cast("long")), F.lit(0)).alias("ok"))
    pct = F.when(F.col("n") > 0, F.col("ok") / F.col("n") * 100).otherwise(F.lit(float(empty)))
    text = F.concat(F.col("ok").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" " + detail))
    return counted.select(F.lit(name).alias("check"), (pct >= floor).alias("passed"), pct.alias("pct"), text.alias("detail"))


def fhir_readiness(patients: DataFrame, notes: DataFrame, conditions: DataFrame, encounters: DataFrame,
                   as_of: Column) -> DataFrame:
    """``patients(id, birthDate, gender, has_contact)``, ``notes(patient, date)``,
    ``conditions(patient, active, systems array)``, ``encounters(patient, date)``.
    No sampling caps. One row per check plus the mean score and verdict."""
    base = patients.select("id", (filled("birthDate") & filled("gender")).alias("demo"), "has_contact")
    seen_note = (notes.filter(F.col("date") >= F.date_sub(as_of, 90)).select(F.col("patient").alias("id")).distinct()
                 .withColumn("noted", F.lit(True)))
    seen_visit = (encounters.filter(F.col("date") >= F.date_sub(as_of, 365)).select(F.col("patient").alias("id")).distinct()
                  .withColumn("visited", F.lit(True)))
    coded = F.arrays_overlap("systems", F.array(*[F.lit(s) for s in fixed.CODED_SYSTEMS]))
    active = conditions.filter("active").join(base.select(F.col("id").alias("patient")), "patient", "left_semi")
    checks = [
        _check(base, "Patient demographics", F.col("demo"), 90, 0, "patients have birthDate + gender"),
        _check(base.join(seen_note, "id", "left"), "Recent clinical notes (90d)", F.coalesce("noted", F.lit(False)), 70, 0,
               "patients have a DocumentReference in the last 90 days"),
        _check(active, "Conditions coded (SNOMED/ICD-10)", F.coalesce(coded, F.lit(False)), 80, 100,
               "active conditions have SNOMED or ICD-10 codes"),
        _check(base, "Patient contact points", F.col("has_contact"), 80, 0,
               "patients have a phone or email (telecom) on record"),
        _check(base.join(seen_visit, "id", "left"), "Recent encounter (12 months)", F.coalesce("visited", F.lit(False)), 60, 0,
               "patients have an encounter in the last 12 months"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return with_score(out)


def with_score(checks: DataFrame) -> DataFrame:
    """Mean percentage over the check rows; 80 and above is ready."""
    everything = Window.partitionBy(F.lit(1))  # a handful of check rows
    return checks.withColumn("score", F.avg("pct").over(everything)).withColumn("ready", F.col("score") >= 80)
