"""Fixed patients and evaluation cases the acceptance numbers refer to."""

import json
from pathlib import Path

from caseloom.sources import tables

PATIENT = "patient_id string, name string, demographics string, conditions string, observations string, sdoh_flags string, notes string"
#: The patients.
PATIENTS = [
    ("maria-gonzalez-001", "Maria Gonzalez", "42F", "Type 2 Diabetes Mellitus|Hypertension", "HbA1c = 8.9|Blood Pressure = 148/92",
     "food_insecurity|no_transport|unemployed",
     "Patient reports difficulty affording insulin. Lives alone, no transport. Recently lost job, relying on food bank. "
     "Primary language Spanish, limited English."),
    ("james-okafor-002", "James Okafor", "67M", "Congestive Heart Failure|Depression", "BNP = 540|PHQ-9 = 14",
     "social_isolation|housing_issues|medication_cost",
     "Socially isolated since wife passed. Lives in subsidized housing with mold issues. Skipping medications due to cost. No family nearby."),
    ("sarah-kim-003", "Sarah Kim", "29F", "Prenatal care 28wk|Iron deficiency anemia", "Hemoglobin = 9.8",
     "uninsured|food_insecurity|unstable_housing",
     "Uninsured, recently immigrated. Food insecure - skipping meals. No stable housing, staying with relatives. Transport barrier to clinic."),
]
KEYS = ["economic", "education", "health_care", "neighborhood", "social", "transportation"]
#: The evaluation cases, as exported.
GOLDEN = Path(__file__).with_name("golden_cases.json")
CASES = json.loads(GOLDEN.read_text())["cases"]


def patients(spark):
    return spark.createDataFrame(PATIENTS, PATIENT)


def cases(spark):
    return tables.read_golden_cases(spark, str(GOLDEN))


def steps(spark):
    """The scripted agent: the expected tools in order."""
    rows = [(c["id"], i, t, f"{t} of {c['id']}") for c in CASES for i, t in enumerate(c["expected_trajectory"])]
    return spark.createDataFrame(rows, "case_id string, pos int, tool string, result string")


def messages(spark):
    rows = [(c["id"], c["patientId"]) for c in CASES if c["expect_followup"] for _ in range(4)]
    return spark.createDataFrame(rows, "case_id string, patient_id string")
