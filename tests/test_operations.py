import datetime as dt

from pyspark.sql import functions as F

from caseloom.operators import access, messages, patients, readiness, tickets
from caseloom.sources import tables
from caseloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def samples(spark, values, metric="Glorefs"):
    rows = [(metric, T0 + dt.timedelta(minutes=i), float(v), i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "metric string, ts timestamp, value double, sample_id int")


def test_anomaly_cases(spark):
    assert messages.zscore_anomalies(samples(spark, [100] * 20)).count() == 0
    spike = messages.zscore_anomalies(samples(spark, [100 + i % 3 for i in range(20)] + [600])).collect()
    assert len(spike) == 1 and spike[0]["value"] == 600 and spike[0]["severity"] == "HIGH"
    assert messages.zscore_anomalies(samples(spark, [100] * 19 + [10000])).first()["z_score"] == 4.25
    assert messages.zscore_anomalies(samples(spark, [1, 2, 900])).count() == 0


def test_trend_cases(spark):
    up = messages.linear_trends(samples(spark, [100 + 20 * i for i in range(20)])).first()
    assert up["direction"] == "increasing" and up["slope"] == 20.0 and up["delta60"] == 1200.0 and up["severity"] == "HIGH"
    down = messages.linear_trends(samples(spark, [500 - 20 * i for i in range(20)])).first()
    assert down["direction"] == "decreasing" and down["threshold_periods"] is None and down["severity"] == "LOW"
    assert messages.linear_trends(samples(spark, [1, 50, 100, 150, 200])).count() == 0


def test_trend_with_a_hot_metric_and_ties(spark):
    """Equal times in many slices: the position still runs 0..n-1 per metric."""
    from caseloom.operators.ordering import running_index

    rows = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("k"), (F.col("id") % 5).alias("t"), "id")
    got = running_index(rows, ["k"], ["t", "id"]).collect()
    for key in ("hot", "cold"):
        mine = sorted([r for r in got if r["k"] == key], key=lambda r: (r["t"], r["id"]))
        assert [r["idx"] for r in mine] == list(range(len(mine)))


HEADER = "id int, source string, target string, body_class string, created timestamp, processed timestamp, status int"


def headers(spark, depth):
    rows = [(i, "A.In", "B.Q", "M.X", T0, None, 1) for i in range(depth)]
    rows += [(100 + i, "A.In", "B.Err", "M.X", T0, T0 + dt.timedelta(milliseconds=40 * (i + 1)), 6 if i < 2 else 9) for i in range(4)]
    return spark.createDataFrame(rows, HEADER)


def test_bottleneck_verdicts(spark):
    as_of = F.lit(T0 + dt.timedelta(minutes=30))
    def verdict(depth):
        h = headers(spark, depth)
        return messages.bottleneck(messages.queue_depth(h), messages.error_rate(h, as_of)).first()
    full, fine = verdict(25), verdict(3)
    assert full["pool_exhausted"] and full["component"] == "B.Q" and "queue depth 25" in full["message"]
    assert not fine["pool_exhausted"] and fine["component"] == "B.Err" and "50.0% (2/4" in fine["message"]
    quiet = headers(spark, 0).filter("status = 9")
    r = messages.bottleneck(messages.queue_depth(quiet), messages.error_rate(quiet, as_of)).first()
    assert r["kind"] == "none" and r["component"] is None
    lat = messages.latency_stats(headers(spark, 1), as_of).first()
    assert (lat["component"], lat["avg_ms"], lat["max_ms"]) == ("B.Err", 100.0, 160)


def test_message_trace_names(spark):
    r = messages.message_trace(headers(spark, 2).withColumn("status", F.when(F.col("id") == 103, 42).otherwise(F.col("status"))), 2).collect()
    assert [(x["id"], x["src"], x["tgt"], x["status"]) for x in r] == [(103, "In", "Err", "Status:42"), (102, "In", "Err", "Completed")]


def test_readiness_rule_cases(spark):
    tel = [{"system": "phone", "value": "1"}]
    rows = [("ok", "1980-01-01", "female", tel), ("b", None, "female", tel), ("g", "1980-01-01", "", tel), ("all", None, None, [])]
    df = spark.createDataFrame(rows, "patient_id string, birthDate string, gender string, telecom array<struct<system:string,value:string>>")
    got = {r["patient_id"]: (r["ready"], r["issues"]) for r in patients.readiness_rule(df).collect()}
    assert got == {"ok": (True, ""), "b": (False, "missing birthDate"), "g": (False, "missing gender"), "all": (False, "missing birthDate, missing gender, no contact point")}


def test_readiness_score_boundary(spark):
    mk = lambda pcts: readiness.with_score(spark.createDataFrame([(f"c{i}", float(p)) for i, p in enumerate(pcts)], "check string, pct double")).first()
    assert mk([100, 50])["score"] == 75.0 and not mk([100, 50])["ready"] and mk([80, 80])["ready"]


def test_readiness_without_patients_or_conditions(spark):
    p = spark.createDataFrame([], "id string, birthDate string, gender string, has_contact boolean")
    d = spark.createDataFrame([], "patient string, date date")
    c = spark.createDataFrame([], "patient string, active boolean, systems array<string>")
    got = {r["check"]: r["pct"] for r in readiness.fhir_readiness(p, d, c, d, F.lit("2024-01-01").cast("date")).collect()}
    assert got["Conditions coded (SNOMED/ICD-10)"] == 100.0 and got["Patient demographics"] == 0.0


TICKET = "ticket_id string, category string, hospital string, summary string, problem string, solution string, status string, has_solution boolean"


def test_completeness_examples(spark):
    rows = [("PC-00001", "BILLING", "h", "s", "p", "fix", "Closed", True), ("PC-00002", "BILLING", "h", "s", "p", "", "", False), ("PC-00003", "", "h", "", "", None, "", False),
            ("PC-00004", "BILLING", "h", "s", "p", "", "Open", False)]
    got = {r["ticket_id"]: (r["score"], r["tier"]) for r in tickets.completeness_score(spark.createDataFrame(rows, TICKET)).collect()}
    assert got == {"PC-00001": (100, "HIGH"), "PC-00002": (60, "MEDIUM"), "PC-00003": (0, "LOW"), "PC-00004": (65, "MEDIUM")}


def test_gate_without_ready_cluster(spark):
    rows = [("PC-1", "A", "h", "s", "", "", "", False), ("PC-2", "A", "h", "", "", "", "", False)]
    df = spark.createDataFrame(rows, TICKET).withColumn("cluster", F.lit(1))
    r = tickets.cluster_gate(df).first()
    assert r["tier"] == "LOW" and not r["ready"] and not r["is_best"]
    p = tickets.cluster_profile(df.unionByName(df.withColumn("cluster", F.lit(-1)))).collect()
    assert {(x["cluster"], x["is_noise"], x["size_rank"]) for x in p} == {(1, False, 1), (-1, True, None)}


def test_samples_and_sets(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 2)
    one, two = (tickets.sample_rows(df.repartition(n), 5, 42, "id", ["g"]).orderBy("id").collect() for n in (1, 7))
    assert one == two and len(one) == 10 and tickets.sample_rows(df, 5, 43, "id").count() == 5
    a, b = spark.range(3).toDF("x"), spark.range(2, 5).toDF("x")
    assert {r.x for r in tickets.set_diff(a, b, ["x"]).collect()} == {0, 1} and {r.x for r in tickets.set_intersection(a, b, ["x"]).collect()} == {2}
    assert tickets.union_unique(a, b, ["x"]).count() == 5


def test_read_metric_samples_drops_bad_rows(spark):
    rows = [("m", "20240101120000123", "5"), ("m", "not a key", "5"), ("m", "20240101120500", "x"), ("m", "20240101100000", "7")]
    s = tables.read_metric_samples(spark.createDataFrame(rows, "metric string, key string, value string"), F.lit(dt.datetime(2024, 1, 1, 12, 30)))
    assert [r["value"] for r in s.collect()] == [5.0]


# --- access ----------------------------------------------------------------------------


def grant(spark, roles, required, **kw):
    req = spark.createDataFrame([("me", "t")], "principal string, tool string")
    who = spark.createDataFrame([("me", roles)], "principal string, roles array<string>")
    return access.entitlements(req, who, spark.createDataFrame([("t", required)], "tool string, required_role string"), **kw).first()


def test_entitlements(spark):
    ok = lambda r: (r["can_list"], r["can_execute"])
    assert ok(grant(spark, [], "")) == (True, True) and ok(grant(spark, [], "Reader")) == (False, False)
    assert ok(grant(spark, ["Reader"], "Reader")) == (True, True) and ok(grant(spark, ["%All"], "Reader")) == (True, True)
    assert ok(grant(spark, ["SampleReader"], "Reader")) == (False, False) and ok(grant(spark, ["SampleReader"], "Reader", substring_roles=True)) == (True, True)
    assert ok(grant(spark, ["%All"], "", deny=["t"], allow=["t"], strict=True)) == (False, False)
    assert ok(grant(spark, [], "", strict=True)) == (True, False) and ok(grant(spark, [], "", strict=True, allow=["u"])) == (False, False)
    assert ok(grant(spark, [], "", strict=True, allow=["t"])) == (True, True)


def test_scopes_are_whole_tokens(spark):
    df = spark.createDataFrame([("a", "mcp.read.denied no.mcp.admin"), ("b", "x mcp.read mcp.admin"), ("c", None)], "subject string, scope string")
    assert {(r["subject"], r["role"]) for r in access.roles_from_scopes(df).collect()} == {("b", "SampleReader"), ("b", "SampleAdmin")}
    arr = spark.createDataFrame([("a", ["mcp.write"])], "subject string, scope array<string>")
    assert access.roles_from_scopes(arr).first()["role"] == "SampleWriter"


def test_approval_precedence(spark):
    df = spark.createDataFrame([("a", "write"), ("b", "read"), ("c", "write"), ("d", "read")], "tool string, effect string")
    got = {r["tool"]: r["required"] for r in access.approval_required(df, {"exempt_tools": ["c"], "extra_tools": ["b", "c"]}).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False}


def test_trend_windows_are_sums_of_panes(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(m, dt.datetime(2024, 1, 3) + dt.timedelta(minutes=float(t)), float(v)) for m, k in (("up", 0.9), ("down", -1.5), ("level", 0.0)) for t in rng.uniform(0, 2000, 300) for v in [50 + k * t / 60 + rng.normal(0, 0.5)]]
    rows += [("once", dt.datetime(2024, 1, 3), 1.0), ("same", dt.datetime(2024, 1, 3), 2.0), (None, dt.datetime(2024, 1, 3), 2.0), ("level", dt.datetime(2024, 1, 3), None)] + [("same", dt.datetime(2024, 1, 3, 1), 2.0)] * 9
    df = spark.createDataFrame(rows, "metric string, ts timestamp, value double")
    got = jobs.trend_windows(df, "6 hours", "2 hours").collect()
    assert {(r["metric"], r["trend"]) for r in got if r["n"] > 40} >= {("up", "flat"), ("down", "flat"), ("level", "flat")}
    fine = jobs.trend_windows(df, "6 hours", "2 hours", flat=0.004).collect()
    assert {r["metric"]: r["trend"] for r in fine if r["n"] > 40 and r["metric"] != "level"} == {"up": "increasing", "down": "decreasing"}
    for r in got:
        ts = [(t - r["start"]).total_seconds() / 3600 for m, t, v in rows if m == r["metric"] and v is not None and 0 <= (t - r["start"]).total_seconds() < 6 * 3600]
        v = [v for m, t, v in rows if m == r["metric"] and v is not None and 0 <= (t - r["start"]).total_seconds() < 6 * 3600]
        assert r["n"] == len(v) and abs(r["slope"] - np.polyfit(ts, v, 1)[0]) < 1e-6 and abs(r["sd"] - np.std(v, ddof=1)) < 1e-6
    assert not [r for r in got if r["metric"] in ("once", "same")]
