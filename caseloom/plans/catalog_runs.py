"""Queries over traces, runs, sessions, streams and SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sqlfuncs, tablefuncs
from ..functions.columns import condition_expr, first_match_case, template_expr
from ..operators import access, documents, runs, traces
from ..streaming import jobs
from . import views as V
from .catalog_analytics import as_of
from .catalog_rules import fhir_patients
from .catalog_sources import scratch
from .registry import query
from .views import with_views

# --- traces -------------------------------------------------------------------------------



#: Per fifth conversation: x and y are each other's parent, z hangs on y, o is its own parent.
LOOPS = [("x", "y"), ("y", "x"), ("z", "y"), ("o", "o")]


@query("w06_trace_tree", "WITH RECURSIVE " + V.CTE["spans"] + """,
 loops AS (SELECT DISTINCT trace_id, i, k, CASE WHEN k = 'z' THEN 'y' ELSE '' END AS up FROM spans, (VALUES (1, 'x'), (2, 'y'), (3, 'z'), (4, 'o')) v(i, k) WHERE conv_id % 5 = 0),
 every AS (SELECT trace_id, span_id, parent_span_id, start_ns, end_ns, 2 AS n_attrs, false AS cycle FROM spans UNION ALL SELECT trace_id, k, up, i, i + 1000000, 0, k <> 'z' FROM loops),
 lab AS (SELECT *, lpad(CAST(start_ns AS VARCHAR), 20, '0') || ':' || span_id AS l, (trace_id, parent_span_id) IN (SELECT (trace_id, span_id) FROM every) AS has FROM every),
 tree AS (SELECT trace_id, span_id, 0 AS depth, l AS path FROM lab WHERE NOT has UNION ALL SELECT c.trace_id, c.span_id, t.depth + 1, t.path || '/' || c.l FROM tree t JOIN lab c ON c.trace_id = t.trace_id AND c.parent_span_id = t.span_id AND c.has)
 SELECT t.trace_id, t.span_id, t.depth, t.path, row_number() OVER (PARTITION BY t.trace_id ORDER BY t.path) - 1 AS seq, (s.end_ns - s.start_ns) / 1000000 AS duration_ms, n_attrs, cycle FROM tree t JOIN every s ON s.trace_id = t.trace_id AND s.span_id = t.span_id""")
def _(spark, sf):
    s = V.spans(spark, sf).select("trace_id", "span_id", "parent_span_id", "name", "start_ns", "end_ns", "status", "attributes", "conv_id")
    one = F.explode_outer(F.array(*[F.struct(F.lit(k).alias("span_id"), F.lit(p).alias("parent_span_id"), F.lit(i).cast("long").alias("start_ns")) for i, (k, p) in enumerate(LOOPS, 1)]))
    loops = s.filter("conv_id % 5 = 0").select("trace_id", "conv_id").distinct().select("trace_id", "conv_id", one.alias("l")).select("trace_id", "conv_id", "l.*")
    loops = loops.select("trace_id", "span_id", "parent_span_id", F.lit("loop").alias("name"), "start_ns", (F.col("start_ns") + 1_000_000).alias("end_ns"), F.lit(0).alias("status"),
                         F.create_map().cast("map<string,string>").alias("attributes"), "conv_id")
    t = traces.trace_tree(s.unionByName(loops), paths=True)
    return t.select("trace_id", "span_id", "depth", "path", "seq", "duration_ms", F.size("attrs").alias("n_attrs"), "cycle")


@query("w07_link_parents", with_views("""SELECT trace_id, span_id, CASE WHEN role = 'user' THEN coalesce(last_value(CASE WHEN role = 'assistant' THEN span_id END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY start_ns, span_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), parent_span_id) ELSE parent_span_id END AS parent_span_id FROM spans""", "spans"))
def _(spark, sf):
    return traces.link_parents(V.spans(spark, sf)).select("trace_id", "span_id", "parent_span_id")


ASSEMBLED = """SELECT trace_id, arg_min(name, start_ns) FILTER (parent_span_id = '') AS root, count(*) AS n_spans, (max(end_ns) - min(start_ns)) / 1000000 AS duration_ms, bool_or(status = 2) AS has_error FROM spans GROUP BY 1"""


@query("r08_assemble_traces", with_views(ASSEMBLED, "spans"))
def _(spark, sf):
    return traces.assemble_traces(V.spans(spark, sf))


# --- runs ----------------------------------------------------------------------------------

RUNS = """, ends AS (SELECT run_id, min(pos) AS e, arg_min(type, pos) AS how FROM run_events WHERE type IN ('run_succeeded', 'run_failed', 'run_cancelled') GROUP BY 1),
 gates AS (SELECT r.*, e IS NULL OR pos < e AS live FROM run_events r LEFT JOIN ends USING (run_id) WHERE type IN ('approval_requested', 'approval_decided')),
 seen AS (SELECT *, lag(type) OVER (PARTITION BY run_id ORDER BY pos) AS prev FROM gates WHERE live),
 st AS (SELECT run_id, arg_max(type, pos) AS last, arg_max(tool, pos) FILTER (type = 'approval_requested') AS tool, max(pos) FILTER (type = 'approval_requested') AS asked,
  arg_max(principal, pos) FILTER (type = 'approval_decided' AND prev = 'approval_requested') AS decided_by, count(*) FILTER (type = 'approval_decided' AND coalesce(prev, '') <> 'approval_requested') AS bad FROM seen GROUP BY 1),
 late AS (SELECT run_id, count(*) FILTER (type = 'approval_decided') AS late FROM gates WHERE NOT live GROUP BY 1),
 base AS (SELECT run_id, arg_min(principal, pos) AS requester, count(*) AS n_events, count(*) FILTER (type = 'step') AS n_steps FROM run_events GROUP BY 1),
 states AS (SELECT run_id, requester, CASE how WHEN 'run_succeeded' THEN 'succeeded' WHEN 'run_failed' THEN 'failed' ELSE CASE WHEN last = 'approval_requested' THEN 'awaiting_approval' ELSE 'running' END END AS status,
  CASE WHEN how IS NULL AND last = 'approval_requested' THEN tool END AS awaiting, CASE WHEN how IS NULL AND last = 'approval_requested' THEN asked END AS asked_pos, decided_by, coalesce(bad, 0) + coalesce(late, 0) AS illegal, n_events, n_steps
  FROM base LEFT JOIN ends USING (run_id) LEFT JOIN st USING (run_id) LEFT JOIN late USING (run_id))"""
STATES = with_views("", "run_events").rstrip() + RUNS


@query("r04_run_state", STATES + " SELECT run_id, requester, status, awaiting, asked_pos, decided_by, illegal, n_events, n_steps FROM states")
def _(spark, sf):
    return runs.run_state(V.run_events(spark, sf))


def drained(spark, stream, mode, name, write=None):
    """Run a stream over what is there and return what its batches wrote, with the
    number of the batch in ``epoch``."""
    out = scratch(spark, name)
    write = write or (lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"))
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, name + "-ckpt")).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.option("basePath", out).parquet(f"{out}/epoch=*") if write.__name__ == "<lambda>" else None


def arriving(spark, df, name, batches=1):
    """The rows as a stream of so many batches, dealt over them evenly. A batch is as
    many files as the session has shuffle partitions, so no task writes or reads it whole."""
    path = scratch(spark, name)
    df.repartition(batches * int(spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(path)
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(path)


@query("r04_run_state_stream", STATES + " SELECT run_id, status, awaiting, decided_by, illegal FROM states")
def _(spark, sf):
    """The stateful stream over the same events in four batches, each with events from
    all over a run. The latest row per run is its state."""
    events = V.run_events(spark, sf).select("run_id", "pos", "type", "tool", "principal")
    rows = drained(spark, jobs.run_state_stream(arriving(spark, events, "run-events", 4)), "update", "run-states")
    return rows.groupBy("run_id").agg(F.max_by(F.struct("status", "awaiting", "decided_by", "illegal"), "epoch").alias("s")).select("run_id", "s.*")


@query("r05_approval_queue", with_views("", "run_events", "principals").rstrip() + RUNS + """, can AS (SELECT 'u' || CAST(substring(principal, 2) AS BIGINT) AS u FROM principals WHERE list_contains(roles, 'approver') OR list_contains(roles, 'admin'))
 SELECT run_id, awaiting AS tool, requester, asked_pos, (SELECT count(*) FROM can) - CASE WHEN requester IN (SELECT u FROM can) THEN 1 ELSE 0 END AS eligible_approvers FROM states WHERE status = 'awaiting_approval'""")
def _(spark, sf):
    p = V.principals(spark, sf).withColumn("principal", F.concat(F.lit("u"), F.substring("principal", 2, 20)))
    return runs.approval_queue(runs.run_state(V.run_events(spark, sf)), p)


@query("w05_retain_latest", STATES + """, o AS (SELECT run_id, status, 'run' AS kind FROM states WHERE status NOT IN ('succeeded', 'failed', 'cancelled')),
 t AS (SELECT run_id, status, 'run' FROM states WHERE status IN ('succeeded', 'failed', 'cancelled') ORDER BY run_id DESC LIMIT (SELECT greatest(0, 1000 - count(*)) FROM o))
 SELECT * FROM o UNION ALL SELECT * FROM t UNION ALL (SELECT CAST(event_id AS VARCHAR), type, 'audit' FROM run_events ORDER BY event_id DESC LIMIT 5000)""")
def _(spark, sf):
    kept = runs.retain_latest(runs.run_state(V.run_events(spark, sf)), 1000, ["run_id"], "status").select("run_id", "status", F.lit("run").alias("kind"))
    audit = runs.retain_latest(V.run_events(spark, sf), 5000, ["event_id"]).select(F.col("event_id").cast("string").alias("run_id"), F.col("type").alias("status"), F.lit("audit").alias("kind"))
    return kept.unionByName(audit)


@query("a23_session_usage", """SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) FILTER (role <> 'system') AS iterations, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens,
 count(*) FILTER (role = 'system') AS subcalls, max(turn) AS updated FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    c = V.table(spark, sf, "conversations")
    return runs.session_usage(c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("ts"), F.col("text").alias("output"), (F.col("role") == "system").alias("is_subcall")))


@query("a24_audit_rollup", with_views("""SELECT principal, tool, type AS backend, count(*) AS calls, round(avg(CASE WHEN value < 50 THEN 1 ELSE 0 END), 6) AS ok_rate, round(avg(value), 6) AS avg_ms FROM run_events GROUP BY 1, 2, 3""", "run_events"))
def _(spark, sf):
    a = V.run_events(spark, sf).select("principal", "tool", F.col("type").alias("backend"), (F.col("value") < 50).alias("ok"), F.col("value").alias("elapsed_ms"))
    r = runs.audit_rollup(a)
    return r.withColumn("ok_rate", F.round("ok_rate", 6)).withColumn("avg_ms", F.round("avg_ms", 6))


@query("r06_expire_sessions", f"SELECT user_id AS session_id, epoch_us(max(ts)) // 1000 AS updated_ms, TIMESTAMP '{V.AS_OF}' - max(ts) > INTERVAL 86400 SECOND AS expired FROM events GROUP BY 1")
def _(spark, sf):
    s = V.run_events(spark, sf).select(F.expr("cast(substring(principal, 2) as bigint)").alias("session_id"), "ts")
    e = runs.expire_sessions(s, as_of())
    return e.select("session_id", F.unix_millis("updated").alias("updated_ms"), "expired")


# --- incremental -------------------------------------------------------------------------------


@query("r01_incremental_patients", "SELECT 'p' || o_custkey AS patient_id, arg_max(o_orderkey, k) AS version FROM (SELECT *, epoch_us(o_orderdate) + o_orderkey AS k FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00') GROUP BY o_custkey")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("patient_id"), F.col("o_orderkey").alias("version"),
                                            F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")).alias("updated"), "o_orderdate")
    return jobs.incremental_patients(o.filter("o_orderdate > timestamp'1998-01-01'"), since=F.lit("1998-01-01").cast("timestamp")).select("patient_id", "version")


ROUTES = """SELECT 'p' || c_custkey AS patient_id, CASE WHEN c_acctbal < 0 OR c_custkey % 5 = 0 OR c_custkey % 9 = 0 THEN 'queue' ELSE 'ready' END AS route,
 concat_ws(', ', CASE WHEN c_acctbal < 0 THEN 'missing birthDate' END, CASE WHEN c_custkey % 5 = 0 THEN 'missing gender' END, CASE WHEN c_custkey % 9 = 0 THEN 'no contact point' END) AS issues FROM customer"""


@query("r02_route_ready", ROUTES)
def _(spark, sf):
    ready, queue = jobs.route_ready(fhir_patients(spark, sf), as_of())
    return ready.select("patient_id", F.lit("ready").alias("route"), F.lit("").alias("issues")).unionByName(queue.select("patient_id", F.lit("queue").alias("route"), "issues"))


MONITOR = """SELECT epoch_us(w) // 1000 AS start_ms, target AS component, count(*) AS total, count(*) FILTER (status = 1) AS depth, count(*) FILTER (status = 6) AS errors,
 round(count(*) FILTER (status = 6) / count(*) * 100, 1) AS rate, round(avg((epoch_us(processed) - epoch_us(created)) // 1000), 6) AS avg_ms FROM (
  SELECT *, time_bucket(INTERVAL 5 MINUTE, created) - to_minutes(5 * i) AS w FROM headers, range(0, 12) r(i)) GROUP BY 1, 2"""


def _monitor_columns(df):
    return df.select(F.unix_millis("start").alias("start_ms"), "component", "total", "depth", "errors", "rate", F.round("avg_ms", 6).alias("avg_ms"))


@query("r07_ops_monitor", with_views(MONITOR, "headers"))
def _(spark, sf):
    return _monitor_columns(jobs.ops_monitor(V.headers(spark, sf)))


@query("r07_ops_monitor_stream", with_views(MONITOR, "headers"))
def _(spark, sf):
    """The same windows from a stream in update mode: the latest row of each window,
    those still open at its end included."""
    rows = drained(spark, jobs.ops_monitor(arriving(spark, V.headers(spark, sf), "headers"), watermark=None), "update", "windows")
    last = rows.groupBy("start", "component").agg(F.max_by(F.struct("total", "depth", "errors", "rate", "avg_ms"), "epoch").alias("m"))
    return _monitor_columns(last.select("start", "component", "m.*"))


@query("r07_window_bottlenecks", with_views("", "headers").rstrip() + ", m AS (" + MONITOR + """), p AS (SELECT start_ms, CAST(sum(depth) AS BIGINT) AS queued,
  arg_min(component, (-depth, component)) AS dc, arg_min(component, (-rate, component)) AS rc, max(rate) AS rr FROM m GROUP BY 1)
 SELECT start_ms, queued, CASE WHEN queued > 20 THEN 'backlog' WHEN rr > 10 THEN 'errors' END AS kind, CASE WHEN queued > 20 THEN dc WHEN rr > 10 THEN rc END AS component FROM p""")
def _(spark, sf):
    b = jobs.window_bottlenecks(jobs.ops_monitor(V.headers(spark, sf)))
    return b.select(F.unix_millis("start").alias("start_ms"), "queued", "kind", "component")


@query("r07_metric_windows", with_views("""SELECT epoch_us(w) // 1000 AS start_ms, metric, count(*) AS n, round(avg(value), 6) AS mean, round(greatest(max(value) - avg(value), avg(value) - min(value)) / stddev_samp(value), 4) AS max_z FROM (
  SELECT *, time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * i) AS w FROM samples, range(0, 4) r(i)) GROUP BY 1, 2 HAVING count(*) >= 5 AND stddev_samp(value) > 0""", "samples"))
def _(spark, sf):
    m = jobs.metric_windows(V.samples(spark, sf), "24 hours", "6 hours")
    return m.select(F.unix_millis("start").alias("start_ms"), "metric", "n", F.round("mean", 6).alias("mean"), F.round("max_z", 4).alias("max_z"))


TRENDS = """SELECT epoch_us(w) // 1000 AS start_ms, metric, n, round(total, 2) AS total, round(max_z, 4) AS max_z, round(slope, 4) AS slope, CASE WHEN abs(slope) <= 0.002 * abs(mean) THEN 'flat' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM (
 SELECT w, metric, count(*) AS n, avg(value) AS mean, sum(value) AS total, greatest(max(value) - avg(value), avg(value) - min(value)) / stddev_samp(value) AS max_z, regr_slope(value, epoch_us(ts) / 3600000000.0 - 473352) AS slope
 FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * i) AS w FROM samples, range(0, 4) r(i)) GROUP BY 1, 2 HAVING count(*) >= 5 AND stddev_samp(value) > 0)"""


def _trend_columns(df):
    return df.select(F.unix_millis("start").alias("start_ms"), "metric", "n", F.round(F.col("mean") * F.col("n"), 2).alias("total"), F.round("max_z", 4).alias("max_z"), F.round("slope", 4).alias("slope"), "trend")


@query("r07_trend_windows", with_views(TRENDS, "samples"))
def _(spark, sf):
    return _trend_columns(jobs.trend_windows(V.samples(spark, sf), "24 hours", "6 hours", flat=0.002))


@query("r07_trend_windows_stream", with_views(TRENDS, "samples"))
def _(spark, sf):
    """The same windows from samples that arrive in order of time, in append mode: each
    window is given once, when the watermark has passed its end. A last sample, years
    later and of no metric, closes the windows that are still open."""
    samples = V.samples(spark, sf).select("metric", "ts", "value")
    path = scratch(spark, "samples-in-order")
    third, two = samples.select(F.unix_micros("ts").alias("t")).approxQuantile("t", [0.33, 0.67], 0.01)
    t = F.unix_micros("ts")
    last = samples.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("string").alias("metric"), (F.col("ts") + F.expr("interval 3 years")).alias("ts"), F.lit(0.0).alias("value"))
    for part in (samples.filter(t <= third), samples.filter((t > third) & (t <= two)), samples.filter(t > two), last):
        part.coalesce(1).write.mode("append").parquet(path)  # a file each, in this order
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows = drained(spark, jobs.trend_windows(stream, "24 hours", "6 hours", "1 hour", flat=0.002), "append", "trends")
    return _trend_columns(rows.filter("metric is not null"))


# --- SQL surface ---------------------------------------------------------------------------------


@query("u01_sql_functions", with_views("""SELECT ticket_id, (CASE WHEN summary <> '' THEN 20 ELSE 0 END + CASE WHEN problem <> '' THEN 30 ELSE 0 END + CASE WHEN solution <> '' THEN 35 ELSE 0 END
 + CASE WHEN category <> '' THEN 10 ELSE 0 END + CASE WHEN status <> '' THEN 5 ELSE 0 END) AS score, """ + V.level_sql("lower(problem)", V.SYLLABLE_RULES[0]) + """ AS economic,
 """ + V.priority_sql("(" + " + ".join(f"CASE WHEN {V.any_sql('lower(problem)', r[2])} THEN 1 ELSE 0 END" for r in V.SYLLABLE_RULES) + ")") + """ AS priority,
 greatest(1, length(problem) // 4) AS tokens, CASE WHEN length(problem) < 1000 THEN 'small' WHEN length(problem) < 10000 THEN 'medium' ELSE 'large' END AS size_class FROM tickets""", "tickets"))
def _(spark, sf):
    sqlfuncs.register_sql_functions(spark, V.SYLLABLE_RULES)
    V.tickets(spark, sf, heavy=True).createOrReplaceTempView("u01_tickets")
    return spark.sql("""SELECT ticket_id, ticket_score(summary, problem, solution, category, status) AS score, risk_economic(problem) AS economic,
      risk_priority(risk_high_count(problem)) AS priority, token_estimate(problem) AS tokens, payload_size(problem) AS size_class FROM u01_tickets""")


@query("u02_table_functions", with_views("""SELECT 'protocol' AS kind, doc_id, p AS name FROM documents, (VALUES ('A1', 'tion', 'heit'), ('B1', 'ment', 'ung')) v(p, a, b) WHERE contains(lower(text), a) OR contains(lower(text), b)
 UNION ALL SELECT 'protocol', doc_id, 'Z1' FROM documents WHERE NOT (contains(lower(text), 'tion') OR contains(lower(text), 'heit') OR contains(lower(text), 'ment') OR contains(lower(text), 'ung'))
 UNION ALL SELECT 'chunk', doc_id, c || ':' || (CASE WHEN contains(lower(t), 'que') THEN 1 ELSE 0 END + CASE WHEN contains(lower(t), 'the') THEN 1 ELSE 0 END) FROM (
  SELECT doc_id, c, substring(text, c * 1000 + 1, 1000) AS t FROM documents, unnest(range(0, (length(text) + 999) // 1000)) u(c)) WHERE contains(lower(t), 'que') OR contains(lower(t), 'the')""", "tickets"))
def _(spark, sf):
    sqlfuncs.register_table_functions(spark, [(["tion", "heit"], ["A1"]), (["ment", "ung"], ["B1"])], ["Z1"])
    V.texts(spark, sf).createOrReplaceTempView("u02_documents")
    return spark.sql("""SELECT 'protocol' AS kind, d.doc_id, m.protocol AS name FROM u02_documents d, LATERAL match_protocols(d.text) m
      UNION ALL SELECT 'chunk', d.doc_id, concat(c.chunk, ':', c.score) FROM u02_documents d, LATERAL search_chunks(d.text, 'que the') c""")


@query("u02_ranked_chunks", """WITH chunks AS (SELECT doc_id, CAST(c AS INTEGER) AS chunk, substring(text, c * 1000 + 1, 1000) AS text FROM documents, unnest(range(0, (length(text) + 999) // 1000)) u(c)),
 s AS (SELECT *, CASE WHEN contains(lower(text), 'que') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'tion') THEN 1 ELSE 0 END AS score FROM chunks)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk DESC) AS rank, chunk, score, text AS excerpt FROM s WHERE score > 0 QUALIFY rank <= 3""")
def _(spark, sf):
    tablefuncs.register_ranked_chunks(spark)
    documents.chunk_text(V.texts(spark, sf)).createOrReplaceTempView("u02_chunks")
    return spark.sql("SELECT * FROM ranked_chunks(TABLE(u02_chunks), 'que the tion', 3)")


@query("u05_condition_expr", """SELECT o_orderkey, (o_orderstatus = 'F' AND NOT contains(o_orderpriority, 'HIGH')) OR (o_orderpriority <> '5-LOW' AND o_orderkey % 2 <> 0) AS applies FROM orders""")
def _(spark, sf):
    o = V.table(spark, sf, "orders").withColumn("flag", F.when(F.col("o_orderkey") % 2 == 0, "off").otherwise("1"))
    cond = condition_expr([{"group": 0, "column": "o_orderstatus", "op": "==", "literal": "F"}, {"group": 0, "column": "o_orderpriority", "op": "contains", "literal": "HIGH", "negate": True},
                           {"group": 1, "column": "o_orderpriority", "op": "!=", "literal": "5-LOW"}, {"group": 1, "column": "flag"}])
    return o.select("o_orderkey", cond.alias("applies"))


@query("u06_template_expr", """SELECT o_orderkey, 'Order ' || o_orderkey || ' is ' || lower(o_orderstatus) || ' for ' || CASE WHEN o_orderkey % 3 = 0 THEN 'nobody' ELSE CAST(o_custkey AS VARCHAR) END || '.' AS text FROM orders""")
def _(spark, sf):
    o = V.table(spark, sf, "orders").withColumn("who", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")))
    return o.select("o_orderkey", template_expr(["Order ", ("o_orderkey",), " is ", ("o_orderstatus", "lower"), " for ", ("who", ("default", "nobody")), "."]).alias("text"))


@query("u07_first_match_case", """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'ERROR: no case matches the arguments given' END AS result FROM orders""")
def _(spark, sf):
    cases = [(F.col("o_totalprice") > 300000, F.lit("large")), (F.col("o_orderstatus") == "F", F.col("o_orderpriority"))]
    return V.table(spark, sf, "orders").select("o_orderkey", first_match_case(cases, "ERROR: no case matches the arguments given").alias("result"))


@query("r01_changed_patients_stream", "SELECT 'p' || o_custkey AS patient_id, arg_max(o_orderkey, k) AS version FROM (SELECT *, epoch_us(o_orderdate) + o_orderkey AS k FROM orders) GROUP BY o_custkey")
def _(spark, sf):
    """Every version arrives twice; the stream passes each once, its reader keeps the latest."""
    o = V.table(spark, sf, "orders").select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("patient_id"), F.col("o_orderkey").alias("version"),
                                            F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")).alias("updated"))
    rows = drained(spark, jobs.changed_patients(arriving(spark, o.unionByName(o), "patients")), "append", "changed")
    n = rows.groupBy("patient_id", "updated").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("version")).filter("n = 1")
    return jobs.incremental_patients(n.drop("n"), since=F.lit("1900-01-01").cast("timestamp")).select("patient_id", "version")


@query("r02_route_ready_stream", ROUTES)
def _(spark, sf):
    ready, queue = scratch(spark, "ready"), scratch(spark, "queue")
    drained(spark, arriving(spark, fhir_patients(spark, sf), "new-patients", 3), "append", "routes", jobs.route_writer(ready, queue, as_of()))
    at = lambda path: spark.read.option("basePath", path).parquet(f"{path}/epoch=*")
    return at(ready).select("patient_id", F.lit("ready").alias("route"), F.lit("").alias("issues")).unionByName(at(queue).select("patient_id", F.lit("queue").alias("route"), "issues"))


@query("r08_assemble_traces_stream", with_views(ASSEMBLED, "spans"))
def _(spark, sf):
    s = V.spans(spark, sf).select("trace_id", "span_id", "parent_span_id", "name", "start_ns", "end_ns", "status", F.timestamp_micros(F.floor(F.col("start_ns") / 1000)).alias("ts"))
    rows = drained(spark, jobs.assemble_traces_stream(arriving(spark, s, "spans")), "complete", "traces")
    return rows.drop("epoch")


@query("r06_expire_sessions_stream", """SELECT user_id AS session_id, epoch_us(max(ts)) // 1000 AS updated_ms FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM (
  SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, island""")
def _(spark, sf):
    s = V.run_events(spark, sf).select(F.expr("cast(substring(principal, 2) as bigint)").alias("session_id"), "ts")
    rows = drained(spark, jobs.expire_sessions_stream(arriving(spark, s, "calls")), "complete", "sessions")
    return rows.select("session_id", F.unix_millis("updated").alias("updated_ms"))


_RIGHTS = "(SELECT bool_or({}) FROM principals p WHERE 'u' || substring(p.principal, 2) = viewer)"
_APPROVES = "coalesce(" + _RIGHTS.format("list_contains(roles, 'approver') OR list_contains(roles, 'admin')") + ", false)"
_LISTS = "coalesce(" + _RIGHTS.format("list_contains(roles, 'caller') OR list_contains(roles, 'approver') OR list_contains(roles, 'admin')") + ", false)"


@query("j13_visible_runs", STATES.replace("WITH ", "WITH " + V.CTE["principals"] + ",\n", 1) + f""", asked AS (SELECT requester AS viewer, run_id, requester FROM states UNION ALL
  SELECT 'u' || ((CAST(substring(requester, 2) AS BIGINT) + 1) % 150), run_id, requester FROM states)
 SELECT viewer, run_id, {_APPROVES} OR (viewer = requester AND {_LISTS}) AS visible, {_APPROVES} AND viewer <> requester AS may_decide FROM asked""")
def _(spark, sf):
    """Each run is asked for by its requester and by the next user."""
    p = V.principals(spark, sf).withColumn("principal", F.concat(F.lit("u"), F.substring("principal", 2, 20)))
    r = runs.run_state(V.run_events(spark, sf)).select("run_id", "requester")
    following = F.concat(F.lit("u"), ((F.substring("requester", 2, 20).cast("long") + 1) % 150).cast("string"))
    asked = r.select(F.col("requester").alias("viewer"), "run_id").unionByName(r.select(following.alias("viewer"), "run_id"))
    return access.visible_runs(r, asked, p)


@query("a24_audit_cube", with_views("""SELECT principal, tool, type AS backend, grouping(principal, tool, type) AS level, count(*) AS calls, round(avg(CASE WHEN value < 50 THEN 1 ELSE 0 END), 6) AS ok_rate,
 round(avg(value), 6) AS avg_ms FROM run_events GROUP BY CUBE (principal, tool, type)""", "run_events"))
def _(spark, sf):
    a = V.run_events(spark, sf).select("principal", "tool", F.col("type").alias("backend"), (F.col("value") < 50).alias("ok"), F.col("value").alias("elapsed_ms"))
    return runs.audit_cube(a).withColumn("ok_rate", F.round("ok_rate", 6)).withColumn("avg_ms", F.round("avg_ms", 6))


@query("a24_run_summary", STATES + " SELECT run_id, requester, status, n_steps, coalesce(decided_by, '') AS decider FROM states")
def _(spark, sf):
    return runs.run_summary(runs.run_state(V.run_events(spark, sf)))
