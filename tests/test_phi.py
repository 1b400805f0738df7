import pytest
from pyspark.sql import functions as F

from caseloom.functions import fixed
from caseloom.operators import phi

TEXTS = [("n", "Seen by John Smith today"), ("e", "write to a.b@example.org now"), ("s", "ssn 123-45-6789"), ("d", "on 2024-03-09 and 3/9/2024"), ("z", "zip 02115-1234"),
         ("m", "MRN: AB12345"), ("h", "member id: XY123456"), ("i", "from 10.1.2.3"), ("c", "score LOW, 3 of 6"), ("0", ""), ("x", None)]


def frame(spark):
    return spark.createDataFrame(TEXTS, "id string, text string")


def test_types_per_text(spark):
    got = {}
    for r in phi.phi_entities(frame(spark), "text").collect():
        got.setdefault(r["id"], set()).add(r["type"])
    assert "FULL_NAME" in got["n"] and "EMAIL" in got["e"] and "SSN" in got["s"] and got["d"] == {"DATE_WITH_DAY"}
    assert "ZIP_CODE" in got["z"] and "MRN" in got["m"] and "HEALTH_PLAN" in got["h"] and got["i"] == {"IP_ADDRESS"} and "c" not in got and "0" not in got


def test_positions_point_at_the_text(spark):
    whole = frame(spark).select("id", F.col("text").alias("whole"))
    rows = phi.phi_entities(frame(spark), "text").join(whole, "id").collect()
    assert rows and all(r["whole"][r["start"]:r["end"]] == r["text"] and r["score"] == 0.5 for r in rows)


def test_counts_in_jvm_equal_python_positions(spark):
    a = {(r["id"], r["type"]): r["count"] for r in phi.phi_entities(frame(spark), "text").groupBy("id", "type").count().collect()}
    s = phi.scan_phi(frame(spark), ["text"]).select("id", F.explode("entities").alias("e")).collect()
    assert a == {(r["id"], r["e"]["type"]): r["e"]["n"] for r in s}


def test_blocked_safe_and_empty_fields(spark):
    df = spark.createDataFrame([("1", "a@b.org", "a@b.org", "", "plain", "fhir")], "id string, ssn string, risk_level string, note string, other string, src string")
    got = {r["field"]: (r["is_sensitive"], r["provider"]) for r in phi.scan_phi(df, ["ssn", "risk_level", "note", "other"], source_col="src").collect()}
    assert got == {"ssn": (True, "local"), "risk_level": (False, "cloud"), "note": (False, "cloud"), "other": (False, "cloud")}
    a = phi.routing_audit(df, ["ssn", "risk_level", "note", "other"], source_col="src").first()
    assert (a["n_local"], a["n_cloud"], a["field_routings"]["ssn"]) == (1, 3, "local")


def test_policy_union_and_unknown_source(spark):
    df = spark.createDataFrame([("fhir",), ("nope",)], "src string")
    custom = phi.field_policy([("fhir", 0.3, ["brand_new"])])
    got = {r["src"]: r for r in phi.policy_for(df, "src", custom).collect()}
    assert got["fhir"]["threshold"] == 0.3 and "brand_new" in got["fhir"]["blocked"] and "ssn" in got["fhir"]["blocked"]
    assert got["nope"]["threshold"] == fixed.PHI_GLOBAL_THRESHOLD and got["nope"]["blocked"] == fixed.PHI_BLOCKED_FIELDS


def test_redaction_is_idempotent_and_keeps_scores(spark):
    once = phi.redact_phi(frame(spark), "text")
    got = {r["id"]: r["redacted"] for r in once.collect()}
    assert got["n"] == "Seen by <FULL_NAME> today" and got["e"] == "write to <EMAIL> now" and got["c"] == "score LOW, 3 of 6" and got["0"] == ""
    twice = {r["id"]: r["redacted"] for r in phi.redact_phi(once, "redacted").collect()}
    assert twice == got


@pytest.mark.parametrize("name, rx", fixed.PHI_PATTERNS)
def test_marks_never_hide_a_match(spark, name, rx):
    df = frame(spark).union(spark.createDataFrame([("q", "# ABCDEF and Medical_Record: ZZ99999 GROUP-ID 1234567 +1 (617) 555-1234 99999")], "id string, text string"))
    c = phi.ascii_text("text")
    assert df.filter(c.rlike(rx) & ~phi.may_match(c, name)).count() == 0


def test_deidentify_fails_closed(spark):
    df = spark.createDataFrame([("a", "Patient Name: Ann Lee, mrn=77, dob: 1970\nrest"), ("b", "claim FAIL_DEID name: x"), ("c", "weather name: x")], "id string, text string")
    got = {r["id"]: r for r in phi.deidentify_payload(df, "text").collect()}
    assert got["a"]["clean"] == "Patient Name=[REDACTED], mrn=[REDACTED], dob=[REDACTED]\nrest"
    assert got["b"]["clean"] is None and got["b"]["failed"] and got["b"]["remediation"].startswith("FAIL_CLOSED")
    assert got["c"]["clean"] == "weather name: x" and not got["c"]["is_healthcare"]


def test_payload_sizes_peek_and_refs(spark):
    df = spark.createDataFrame([("s", "x" * 999), ("m", "y" * 4001), ("l", "z" * 10000)], "id string, text string")
    assert {r["id"]: r["size_class"] for r in phi.payload_class(df, "text").collect()} == {"s": "small", "m": "medium", "l": "large"}
    inline, kept = phi.intercept_large(df, "text")
    assert {r["id"]: r["stored"] for r in inline.collect()} == {"s": False, "m": True, "l": True} and {len(r["value"]) for r in kept.collect()} == {4001, 10000}
    p = {r["id"]: r for r in phi.peek(df, "text", 900, 9999).collect()}
    assert len(p["s"]["slice"]) == 99 and p["s"]["next"] is None and len(p["l"]["slice"]) == 9100 and p["l"]["next"] is None and phi.peek(df, "text", 900, 5000).filter("id = 'l'").first()["next"] == 5900 and phi.peek(df, "text", 20000).first()["error"].startswith("ERROR")
    t = spark.createDataFrame([("1", "s", "{{var:a}}-{{var:b}}{{var:a}}"), ("2", "s", "none"), ("3", "o", "{{var:a}}"), ("4", "s", None)], "id string, session_id string, t string")
    v = spark.createDataFrame([("s", "a", "A$1"), ("s", "c", "C")], "session_id string, name string, value string")
    assert {r["id"]: r["text"] for r in phi.resolve_refs(t, v, "t").collect()} == {"1": "A$1-<missing:b>A$1", "2": "none", "3": "<missing:a>", "4": ""}
