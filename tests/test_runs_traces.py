import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import access, documents, runs, traces
from caseloom.streaming import jobs

EVENT = "run_id string, pos long, type string, tool string, principal string"
LOGS = {
    "waiting": ["run_started", "step", "approval_requested"],
    "approved": ["run_started", "approval_requested", "approval_decided", "step", "run_succeeded"],
    "open": ["run_started", "approval_requested", "approval_decided"],
    "twice": ["run_started", "approval_requested", "approval_decided", "approval_decided"],
    "early": ["run_started", "approval_decided", "approval_requested"],
    "late": ["run_started", "run_failed", "approval_decided", "run_succeeded"],
    "cancelled": ["run_started", "approval_requested", "run_cancelled"],
}
WANT = {"waiting": ("awaiting_approval", "tool2", None, 0), "approved": ("succeeded", None, "by2", 0), "open": ("running", None, "by2", 0), "twice": ("running", None, "by2", 1),
        "early": ("awaiting_approval", "tool2", None, 1), "late": ("failed", None, None, 1), "cancelled": ("cancelled", None, None, 0)}


def events(spark):
    rows = [(r, i, k, f"tool{i}", f"by{i}") for r, ks in LOGS.items() for i, k in enumerate(ks)]
    return spark.createDataFrame(rows, EVENT)


def pick(df):
    return {r["run_id"]: (r["status"], r["awaiting"], r["decided_by"], r["illegal"]) for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 5])
def test_run_states(spark, parts):
    assert pick(runs.run_state(events(spark).repartition(parts))) == WANT


def test_run_state_stream_equals_batch(spark, tmp_path):
    for i in (3, 0, 4, 1, 2):  # one file per position, out of order, so states are carried from batch to batch and events come late
        events(spark).filter(F.col("pos") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {}

    def keep(batch, epoch):
        for r in batch.collect():
            seen[r["run_id"]] = (epoch, (r["status"], r["awaiting"], r["decided_by"], r["illegal"]))

    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.run_state_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    assert {k: v[1] for k, v in seen.items()} == WANT and max(v[0] for v in seen.values()) >= 3


def test_replay_follows_the_rules_and_runs_without_python(spark, tmp_path):
    """Every sequence of up to four gates, by the fold and by hand."""
    kinds = {"q": "approval_requested", "d": "approval_decided", "s": "run_succeeded", "f": "run_failed"}
    rows, want = [], {}
    for run in ("".join(x) for n in range(5) for x in itertools.product(kinds, repeat=n)):
        status, tool, by, illegal = "running", None, None, 0
        for i, k in enumerate(run):
            if k == "d":
                if status == "awaiting_approval":
                    status, tool, by = "running", None, f"p{i}"
                else:
                    illegal += 1
            elif status in ("running", "awaiting_approval"):
                status, tool = {"q": ("awaiting_approval", f"t{i}"), "s": ("succeeded", None), "f": ("failed", None)}[k]
        want[f"r{run}"] = (status, tool, by, illegal)
        rows += [(f"r{run}", -1, "step", "t", "p")] + [(f"r{run}", i, kinds[k], f"t{i}", f"p{i}") for i, k in enumerate(run)]
    random.Random(2).shuffle(rows)
    state = jobs.run_state_stream(spark.createDataFrame(rows, "run_id string, pos long, type string, tool string, principal string"))
    assert pick(state) == want and "Python" not in state._jdf.queryExecution().toString() and "Pandas" not in state._jdf.queryExecution().toString()


def test_a_batch_of_a_stream_is_many_files(spark, tmp_path, monkeypatch):
    from caseloom.plans import catalog_runs

    for n in (1, 3):
        monkeypatch.setattr(catalog_runs, "scratch", lambda spark, name: str(tmp_path / f"{n}-{name}"))  # noqa: B023
        got = catalog_runs.drained(spark, catalog_runs.arriving(spark, spark.range(4000), "arrivals", n), "append", "arrived")
        per = {r["epoch"]: r["count"] for r in got.groupBy("epoch").count().collect()}
        assert len(per) == n and sum(per.values()) == 4000 and min(per.values()) > 4000 // n // 2
        assert len(list((tmp_path / f"{n}-arrivals").glob("*.parquet"))) == 4 * n


def test_visible_runs(spark):
    who = spark.createDataFrame([("boss", ["approver"]), ("ann", ["caller"]), ("bob", ["caller"]), ("eve", ["guest"])], "principal string, roles array<string>")
    r = spark.createDataFrame([("r1", "ann"), ("r2", "boss"), ("r3", "eve")], "run_id string, requester string")
    asked = spark.createDataFrame([("boss", "r1"), ("boss", "r2"), ("ann", "r1"), ("bob", "r1"), ("eve", "r3"), ("who", "r1"), ("boss", "gone")], "viewer string, run_id string")
    got = {(x["viewer"], x["run_id"]): (x["visible"], x["may_decide"]) for x in access.visible_runs(r, asked, who).collect()}
    assert got == {("boss", "r1"): (True, True), ("boss", "r2"): (True, False), ("ann", "r1"): (True, False), ("bob", "r1"): (False, False),
                   ("eve", "r3"): (False, False), ("who", "r1"): (False, False), ("boss", "gone"): (False, False)}


def test_queue_excludes_the_requester(spark):
    who = spark.createDataFrame([("by0", ["approver"]), ("z", ["admin"]), ("c", ["caller"])], "principal string, roles array<string>")
    q = runs.approval_queue(runs.run_state(events(spark)), who, F.lit(10)).orderBy("run_id").collect()
    assert [(r["run_id"], r["tool"], r["eligible_approvers"], r["age"]) for r in q] == [("early", "tool2", 1, 8), ("waiting", "tool2", 1, 8)]
    assert runs.approval_queue(runs.run_state(events(spark)), who, allow_self=True).first()["eligible_approvers"] == 2


def test_retention_never_evicts_open_runs(spark):
    rows = [(i, "awaiting_approval" if i < 3 else "succeeded") for i in range(10)]
    df = spark.createDataFrame(rows, "id int, status string")
    keep = lambda n: sorted(r["id"] for r in runs.retain_latest(df, n, ["id"], "status").collect())
    assert keep(5) == [0, 1, 2, 8, 9] and keep(2) == [0, 1, 2] and sorted(r["id"] for r in runs.retain_latest(df, 2, ["id"]).collect()) == [8, 9]


def test_sessions(spark):
    now = dt.datetime(2024, 1, 2, 1, 0, 0)
    df = spark.createDataFrame([("a", now - dt.timedelta(seconds=90000)), ("b", now - dt.timedelta(seconds=10)), ("a", now - dt.timedelta(seconds=99000))], "session_id string, ts timestamp")
    assert {r["session_id"]: r["expired"] for r in runs.expire_sessions(df, F.lit(now)).collect()} == {"a": True, "b": False}
    calls = spark.createDataFrame([("a", 1, "x" * 9, False), ("a", 3, "", False), ("a", 2, "y" * 40, True)], "session_id string, ts int, output string, is_subcall boolean")
    assert tuple(runs.session_usage(calls).first()) == ("a", 2, 13, 1, 3)


SPAN = "trace_id string, span_id string, parent_span_id string, name string, start_ns long, end_ns long, status int, attributes map<string,string>"


def spans(spark):
    rows = [("t", "r", "", "gen_ai.agent_turn", 10, 100, 0, {"session.id": "1", "other": "x"}), ("t", "c2", "r", "b", 50, 60, 0, {"gen_ai.tool.input": "y" * 200}), ("t", "c1", "r", "a", 20, 40, 2, {}),
            ("t", "g", "c1", "g", 25, 30, 0, {}), ("t", "orphan", "gone", "o", 5, 6, 0, {}), ("t", "x", "y", "loop", 1, 2, 0, {}), ("t", "y", "x", "loop", 1, 2, 0, {}), ("u", "r", "", "solo", 1, 2, 0, {})]
    return spark.createDataFrame(rows, SPAN)


def test_tree_order_orphans_and_cycles(spark):
    got = traces.trace_tree(spans(spark), value_cut=120).orderBy("trace_id", "seq").collect()
    assert [(r["trace_id"], r["span_id"], r["depth"], r["seq"], r["cycle"]) for r in got] == [
        ("t", "x", 0, 0, True), ("t", "y", 0, 1, True), ("t", "orphan", 0, 2, False), ("t", "r", 0, 3, False), ("t", "c1", 1, 4, False), ("t", "g", 2, 5, False), ("t", "c2", 1, 6, False), ("u", "r", 0, 0, False)]
    by = {r["span_id"]: r["attrs"] for r in got if r["trace_id"] == "t"}
    assert by["r"] == {"session.id": "1"} and len(by["c2"]["gen_ai.tool.input"]) == 120 and by["c2"]["gen_ai.tool.input"].endswith("...")


def brute_tree(rows):
    """(trace, span): (depth, seq, cycle) by walking each trace."""
    out = {}
    for trace in {r[0] for r in rows}:
        mine = sorted((r[4], r[1], r[2]) for r in rows if r[0] == trace)
        up = {s: p if any(p == x for _, x, _ in mine) else None for _, s, p in mine}
        on = set()
        for s in up:
            seen, at = [], s
            while at is not None and at not in seen:
                seen.append(at)
                at = up[at]
            on |= set(seen[seen.index(at):]) if at is not None else set()
        up = {s: None if s in on else p for s, p in up.items()}
        stack = [(s, 0) for _, s, _ in reversed(mine) if up[s] is None]
        n = 0
        while stack:
            s, d = stack.pop()
            out[trace, s] = d, n, s in on
            n += 1
            stack += [(c, d + 1) for _, c, _ in reversed(mine) if up[c] == s]
    return out


@pytest.mark.parametrize("large", [20_000, 25, 0])
def test_trees_of_any_shape(spark, large):
    rng = random.Random(large)
    rows = []
    for t in range(12):
        n = rng.choice([1, 4, 30, 60])
        for i in range(n):
            parent = rng.choice([f"s{rng.randint(0, n)}", f"s{max(0, i - 1)}", "s0", "", None])
            rows.append((f"t{t}", f"s{i}", parent, "x", rng.randint(0, 20), 30, 0, {}))
    got = traces.trace_tree(spark.createDataFrame(rows, SPAN).repartition(5), paths=True, large=large).collect()
    assert {(r["trace_id"], r["span_id"]): (r["depth"], r["seq"], r["cycle"]) for r in got} == brute_tree(rows)
    assert all(r["path"].count("/") == r["depth"] and r["path"].endswith(":" + r["span_id"]) for r in got) and len(got) == len(rows)


def test_a_chain_of_a_hundred_thousand_spans(spark):
    n = 100_000
    chain = spark.range(n, numPartitions=8).selectExpr("'t' as trace_id", "concat('s', id) as span_id", "if(id = 0, '', concat('s', id - 1)) as parent_span_id", "'x' as name", "id as start_ns", "id + 1 as end_ns", "0 as status", "cast(map() as map<string,string>) as attributes")
    tree = traces.trace_tree(chain).selectExpr("max(depth) as d", "sum(if(depth = seq and span_id = concat('s', seq), 1, 0)) as right")
    assert tuple(tree.first()) == (n - 1, n)


def test_link_parents_across_slices(spark):
    rows = [("t", f"s{i:03d}", "", "gen_ai.chat" if i in (0, 70) else "execute_tool x", i, i, 0, {}) for i in range(100)]
    got = {r["span_id"]: r["parent_span_id"] for r in traces.link_parents(spark.createDataFrame(rows, SPAN).repartition(6)).collect()}
    assert got["s001"] == "s000" and got["s069"] == "s000" and got["s071"] == "s070" and got["s099"] == "s070" and got["s000"] == ""


def test_tool_and_chat_spans(spark):
    call = "call_id string, trace_id string, parent_span_id string, session_id string, tool string, input string, output string, error string, denied boolean, end_ns long, duration_ms long"
    rows = [("1", "t", "p", "s", "ls", "{}", "o" * 900, None, False, 10_000_000, 5), ("2", "t", "p", "s", "rm", "{}", "x", "e" * 300, False, 10_000_000, 5), ("3", "t", "p", None, "su", "{}", "x", "no role", True, 10_000_000, 5)]
    got = {r["attributes"]["gen_ai.tool.call_id"]: r for r in traces.tool_spans(spark.createDataFrame(rows, call), output_cut=500, error_cut=200).collect()}
    assert [got[k]["status"] for k in "123"] == [0, 2, 2] and got["1"]["start_ns"] == 5_000_000 and got["3"]["start_ns"] == 10_000_000
    assert len(got["1"]["attributes"]["gen_ai.tool.output"]) == 500 and len(got["2"]["attributes"]["gen_ai.tool.error"]) == 200 and got["3"]["attributes"]["gen_ai.tool.denied"] == "true"
    chat = spark.createDataFrame([("1", "t", "", "s", "m", 5, 0, "hello", 1, 2)], "call_id string, trace_id string, parent_span_id string, session_id string, model string, input_tokens int, output_tokens int, completion string, start_ns long, end_ns long")
    assert traces.chat_spans(chat).first()["events"] == [] and traces.chat_spans(chat, True).first()["events"][0]["content"] == "hello"
    assert "gen_ai.usage.output_tokens" not in traces.chat_spans(chat).first()["attributes"]


def test_trace_assembly_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    base = spans(spark).filter("span_id not in ('x', 'y')").withColumn("ts", F.lit(t0))
    late = base.filter("trace_id = 'u'").withColumn("trace_id", F.lit("later")).withColumn("ts", F.lit(t0 + dt.timedelta(hours=3)))
    for i, part in enumerate((base, late, late.withColumn("trace_id", F.lit("last")).withColumn("ts", F.lit(t0 + dt.timedelta(hours=6))))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).parquet(str(tmp_path / "in"))
    q = jobs.assemble_traces_stream(stream).writeStream.outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).format("parquet").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).filter("trace_id in ('t', 'u')").collect())
    assert closed == sorted(tuple(r) for r in traces.assemble_traces(base).collect())


def test_changed_patients_and_routing_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    row = lambda pid, ver, birth: (pid, t0 + dt.timedelta(minutes=ver), birth, "f", "tel")
    cols = "patient_id string, updated timestamp, birthDate string, gender string, telecom string"
    spark.createDataFrame([row("a", 1, "1980"), row("a", 1, "1980"), row("b", 2, None)], cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        s = jobs.changed_patients(spark.readStream.schema(cols).parquet(str(tmp_path / "in")))
        q = s.writeStream.foreachBatch(jobs.route_writer(str(tmp_path / "ready"), str(tmp_path / "queue"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert spark.read.parquet(str(tmp_path / "ready")).count() == 1 and spark.read.parquet(str(tmp_path / "queue")).first()["issues"] == "missing birthDate"
    spark.createDataFrame([row("a", 5, "1980")], cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()  # a restart reads only what is new
    assert spark.read.parquet(str(tmp_path / "ready")).count() == 2 and spark.read.parquet(str(tmp_path / "queue")).count() == 1
    batch = spark.createDataFrame([row("a", 1, "1980"), row("a", 5, "1981"), row("b", 2, None)], cols)
    assert jobs.incremental_patients(batch, as_of=F.lit(t0 + dt.timedelta(hours=1))).count() == 2
    assert [r["birthDate"] for r in jobs.incremental_patients(batch, since=F.lit(t0 + dt.timedelta(minutes=3))).collect()] == ["1981"]


# --- texts -------------------------------------------------------------------------------


def test_chunks_and_ties(spark):
    d = spark.createDataFrame([("a", "one two " + "x" * 995 + "two"), ("b", ""), ("c", None)], "doc_id string, text string")
    c = documents.chunk_text(d).orderBy("chunk").collect()
    assert [(r["chunk"], r["start"], r["stop"]) for r in c] == [(0, 0, 1000), (1, 1000, 1006)]
    s = documents.search_chunks(d, "two absent").orderBy("rank").collect()
    assert [(r["chunk"], r["score"]) for r in s] == [(1, 1), (0, 1)]


def test_filter_text_cap(spark):
    d = spark.createDataFrame([("a", "\n".join(["Cat dog"] * 25))], "doc_id string, text string")
    r = documents.filter_text(d, "^cat").first()
    assert len(r["matches"]) == 20 and r["n_more"] == 5 and documents.filter_text(d, "(d)og", group=1).first()["matches"][0] == "d"


def test_explore_decisions(spark):
    d = spark.createDataFrame([("a", "nothing of use", "alpha and beta"), ("b", "alpha beta " * 20, "alpha and beta"), ("c", "alpha", "alpha")], "doc_id string, text string, query string")
    a, t = documents.explore(d)
    got = {r["doc_id"]: (r["decision"], r["confidence"], r["n_parts"]) for r in a.collect()}
    assert got == {"a": ("next_step_plan", 0.2, 2), "b": ("answer", 0.75, 2), "c": ("answer", 0.4, 1)} and t.count() == 12


def test_explore_limits_are_counted(spark):
    d = spark.createDataFrame([("a", "\n".join(f"alpha {i} " + "x" * 900 for i in range(9)), "alpha")], "doc_id string, text string, query string")
    whole, few = documents.explore(d)[0].first(), documents.explore(d, k=2, max_lines=3, max_chars=700)[0].first()
    assert whole["n_more_chunks"] == 0 and whole["n_more_lines"] == 0 and whole["answer"].count("[Chunk ") >= 8
    assert few["n_more_chunks"] > 0 and few["n_more_lines"] > 0 and len(few["answer"]) == 700


def test_answer_quality_scale(spark):
    rows = [("1", "how many billing codes", "", "ctx"), ("2", "how many billing codes", "billing codes " * 4, "ctx"), ("3", "a b", "short", ""), ("4", "many billing codes", "many billing codes " * 3, "ctx")]
    got = {r["id"]: (round(r["score"], 3), r["passed"]) for r in documents.answer_quality(spark.createDataFrame(rows, "id string, query string, answer string, context string")).collect()}
    assert got == {"1": (0.0, False), "2": (4.333, True), "3": (1.0, False), "4": (5.0, True)}


def test_grounding(spark):
    dec = "array<struct<source:string,rule:string,rationale:string,quote:string>>"
    rule = "Screen everyone for food insecurity at each visit"
    rows = [("1", f"We say: {rule}, always.", [("USPSTF", rule, "why", None), ("AHA", "Other rule", "w", "not in there")]), ("2", "unrelated", [("ADA", "Flag housing", "w", None)]), ("3", "none", [("", "x", "", None)])]
    got = {r["answer_id"]: r for r in documents.ground_claims(spark.createDataFrame(rows, f"answer_id string, answer string, decisions {dec}")).collect()}
    assert got["1"]["grounded_text"] == f"We say: {rule[:30]} [SOURCE: USPSTF]{rule[30:]}, always." and (got["1"]["verified"], got["1"]["unverified"], got["1"]["confidence"]) == (1, 1, 0.5)
    assert got["2"]["grounded_text"] == "unrelated\n\n*Grounded by: ADA*" and got["3"]["grounded_text"] == "none" and got["3"]["confidence"] == 0.0


def test_condition_and_template(spark):
    from caseloom.functions.columns import condition_expr, template_expr, traceparent, truthy

    df = spark.createDataFrame([("No", "a URGENT b", None), ("1", "", "x")], "flag string, t string, n string")
    assert [r[0] for r in df.select(truthy("flag")).collect()] == [False, True]
    both = condition_expr([{"column": "flag"}, {"column": "t", "op": "contains", "literal": "URGENT", "negate": True}, {"group": 1, "column": "n", "op": "==", "literal": "None"}])
    assert [r[0] for r in df.select(both).collect()] == [True, True] and df.select(condition_expr([])).first()[0] is True
    assert df.select(template_expr(["<", ("n", "upper"), ">", ("n", ("default", "d"))])).first()[0] == "<>d"
    tp = spark.createDataFrame([("00-" + "a" * 32 + "-" + "b" * 16 + "-01",), ("00-short-b-01",), ("",), (None,)], "h string").select(traceparent("h").alias("t")).collect()
    assert [r["t"]["valid"] for r in tp] == [True, False, False, False] and tp[0]["t"]["span_id"] == "b" * 16
