"""Queries over tickets, messages, metrics, readiness, evaluation and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import evals, messages, patients, readiness, scoring, tickets
from . import views as V
from .catalog_rules import fhir_patients, followups, scored
from .registry import query
from .views import with_views

SCORE = """(CASE WHEN summary <> '' THEN 20 ELSE 0 END + CASE WHEN problem <> '' THEN 30 ELSE 0 END + CASE WHEN solution <> '' THEN 35 ELSE 0 END
 + CASE WHEN category <> '' THEN 10 ELSE 0 END + CASE WHEN status <> '' THEN 5 ELSE 0 END)"""
TIER = f"CASE WHEN {SCORE} >= 80 THEN 'HIGH' WHEN {SCORE} >= 50 THEN 'MEDIUM' ELSE 'LOW' END"


@query("p10_search_tickets_keyword", with_views("""SELECT row_number() OVER (ORDER BY has_solution DESC, ticket_id) AS rank, ticket_id, category, has_solution, summary
 FROM tickets WHERE contains(lower(summary), 'tion') OR contains(lower(problem), 'tion') OR category = 'TION HEIT' ORDER BY has_solution DESC, ticket_id LIMIT 8""", "tickets"))
def _(spark, sf):
    return tickets.search_tickets_keyword(V.tickets(spark, sf), "tion heit")


@query("p11_completeness_score", with_views(f"SELECT ticket_id, {SCORE} AS score, {TIER} AS tier, category, status FROM tickets", "tickets"))
def _(spark, sf):
    return tickets.completeness_score(V.tickets(spark, sf))


@query("a01_category_coverage", with_views("""SELECT category, count(*) AS total, CAST(sum(CAST(has_solution AS INTEGER)) AS BIGINT) AS resolved,
 round(sum(CAST(has_solution AS INTEGER)) / count(*) * 100, 0) AS pct FROM tickets GROUP BY category""", "tickets"))
def _(spark, sf):
    return tickets.category_coverage(V.tickets(spark, sf))


@query("a02_gap_report", with_views("""SELECT coalesce(category, 'TOTAL') AS category, count(*) AS total, CAST(sum(CAST(has_solution AS INTEGER)) AS BIGINT) AS solved,
 round((1 - sum(CAST(has_solution AS INTEGER)) / count(*)) * 100, 0) AS gap_pct, category IS NULL AS is_total FROM tickets GROUP BY ROLLUP (category)""", "tickets"))
def _(spark, sf):
    return tickets.gap_report(V.tickets(spark, sf))


TOPN = """ranked AS (SELECT *, row_number() OVER (PARTITION BY category, has_solution ORDER BY ticket_id) AS r FROM tickets)"""


@query("a03_cluster_summary",
       "WITH " + V.CTE["tickets"] + ",\n" + TOPN + """
SELECT category, count(*) AS total, CAST(sum(CAST(has_solution AS INTEGER)) AS BIGINT) AS resolved, round(sum(CAST(has_solution AS INTEGER)) / count(*) * 100, 0) AS pct,
 coalesce(string_agg(CASE WHEN has_solution AND r <= 4 THEN ticket_id || ': ' || summary || ' / ' || solution END, chr(10) ORDER BY r), '') AS anchors,
 coalesce(string_agg(CASE WHEN NOT has_solution AND r <= 3 THEN ticket_id || ': ' || summary END, chr(10) ORDER BY r), '') AS unresolved
 FROM ranked GROUP BY category""")
def _(spark, sf):
    s = tickets.cluster_summary(V.tickets(spark, sf))
    line = lambda r: F.concat(r["ticket_id"], F.lit(": "), r["summary"], F.lit(" / "), r["fix"])
    return s.select("category", "total", "resolved", "pct", F.array_join(F.transform("anchors", line), "\n").alias("anchors"),
                    F.array_join(F.transform("unresolved", lambda r: F.concat(r["ticket_id"], F.lit(": "), r["summary"])), "\n").alias("unresolved"))


@query("w01_top_n_per_category", "WITH " + V.CTE["tickets"] + ",\n" + TOPN + """
SELECT category, CASE WHEN has_solution THEN 'solved' ELSE 'open' END AS kind, r AS rank, ticket_id FROM ranked WHERE r <= CASE WHEN has_solution THEN 4 ELSE 3 END""")
def _(spark, sf):
    return tickets.top_n_per_category(V.tickets(spark, sf)).select("category", "kind", "rank", "ticket_id")


@query("t06_article_context", "WITH " + V.CTE["tickets"] + ",\n" + TOPN + """
SELECT category, count(*) FILTER (has_solution) AS n_sources, string_agg(CASE WHEN has_solution THEN 'Ticket ' || ticket_id || ':' || chr(10) || 'Problem: ' || problem || chr(10) || 'Resolution: ' || solution
 ELSE 'Ticket ' || ticket_id || ' (unresolved):' || chr(10) || 'Problem: ' || problem END, chr(10) || chr(10) ORDER BY has_solution DESC, r) AS context
 FROM ranked WHERE r <= CASE WHEN has_solution THEN 5 ELSE 3 END GROUP BY category HAVING count(*) FILTER (has_solution) > 0""")
def _(spark, sf):
    return tickets.article_context(V.tickets(spark, sf), 5, 3)


PROFILE = """cc AS (SELECT cluster, category, count(*) AS n, sum(CAST(has_solution AS INTEGER)) AS s FROM clustered GROUP BY 1, 2),
 cr AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, category) AS r FROM cc),
 cp AS (SELECT cluster, CAST(sum(n) AS BIGINT) AS size, max(CASE WHEN r = 1 THEN category END) AS dominant, CAST(sum(s) AS BIGINT) AS n_solved,
  string_agg(CASE WHEN r <= 3 THEN category || '=' || n END, ',' ORDER BY r) AS top3 FROM cr GROUP BY cluster),
 big AS (SELECT cluster, row_number() OVER (ORDER BY size DESC, cluster) AS size_rank FROM cp WHERE cluster <> -1)"""


@query("a04_cluster_profile", with_views("", "tickets", "vectors", "clustered").rstrip() + ",\n" + PROFILE + """
SELECT cp.*, cp.cluster = -1 AS is_noise, CASE WHEN size_rank <= 3 THEN size_rank END AS size_rank FROM cp LEFT JOIN big ON cp.cluster = big.cluster""")
def _(spark, sf):
    return tickets.cluster_profile(V.clustered(spark, sf))


@query("a05_cluster_gate", with_views("", "tickets", "vectors", "clustered").rstrip() + ",\n" + PROFILE + f""",
 sc AS (SELECT c.cluster, {SCORE} AS score, {TIER} AS tier, row_number() OVER (PARTITION BY c.cluster ORDER BY ticket_id) AS r FROM clustered c WHERE c.cluster <> -1),
 g AS (SELECT sc.cluster, avg(score) AS avg_score, avg(CASE WHEN tier = 'HIGH' THEN 1 ELSE 0 END) AS h, avg(CASE WHEN tier IN ('HIGH', 'MEDIUM') THEN 1 ELSE 0 END) AS m FROM sc GROUP BY 1),
 g2 AS (SELECT g.cluster, avg_score, CASE WHEN h > 0.5 THEN 'HIGH' WHEN m > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS tier, size FROM g JOIN cp ON cp.cluster = g.cluster)
SELECT cluster, avg_score, tier, tier <> 'LOW' AS ready, tier <> 'LOW' AND row_number() OVER (ORDER BY tier <> 'LOW' DESC, avg_score DESC, size DESC, cluster) = 1 AS is_best FROM g2""")
def _(spark, sf):
    return tickets.cluster_gate(V.clustered(spark, sf))


@query("j10_coverage_gaps", with_views("""SELECT category, count(*) AS total, CAST(sum(CAST(has_solution AS INTEGER)) AS BIGINT) AS resolved, round(sum(CAST(has_solution AS INTEGER)) / count(*) * 100, 0) AS pct
 FROM tickets WHERE lower(category) NOT IN (SELECT lower(source) FROM documents GROUP BY source HAVING min(doc_id) % 2 = 0) GROUP BY category""", "tickets"))
def _(spark, sf):
    pages = V.table(spark, sf, "documents").groupBy("source").agg(F.min("doc_id").alias("m")).filter("m % 2 = 0").select(
        F.concat(F.lower("source"), F.lit(".md")).alias("file"))
    return tickets.coverage_gaps(V.tickets(spark, sf), pages)


@query("j15_enrich_hits", with_views("""SELECT v.id, vec_id AS score, coalesce(nullif(category, ''), '?') AS category, coalesce(summary, '') AS summary FROM vectors v LEFT JOIN tickets t ON t.ticket_id = v.id""",
                                     "tickets", "vectors"))
def _(spark, sf):
    hits = V.vectors(spark, sf).select(F.concat(F.lit("pc_ticket:"), F.col("id")).alias("id"), F.col("vec_id").alias("score"))
    return tickets.enrich_hits(hits, V.tickets(spark, sf))


# --- sorts and sets -------------------------------------------------------------------


@query("k01_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return tickets.top_k(o, [F.desc("o_totalprice"), "o_orderkey"], 25)


@query("k02_sample_rows", with_views("""SELECT cluster, has_solution, ticket_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster, has_solution ORDER BY sha256(ticket_id || '#42'), ticket_id) AS r FROM clustered) WHERE r <= 3""",
                                     "tickets", "vectors", "clustered"))
def _(spark, sf):
    return tickets.sample_rows(V.clustered(spark, sf), 3, 42, "ticket_id", ["cluster", "has_solution"]).select("cluster", "has_solution", "ticket_id")


@query("k03_set_diff", with_views("SELECT ticket_id AS id FROM tickets EXCEPT SELECT id FROM vectors", "tickets", "vectors"))
def _(spark, sf):
    return tickets.set_diff(V.tickets(spark, sf).withColumnRenamed("ticket_id", "id"), V.vectors(spark, sf), ["id"])


@query("k04_set_intersection", with_views("SELECT ticket_id AS id FROM tickets INTERSECT SELECT id FROM vectors", "tickets", "vectors"))
def _(spark, sf):
    return tickets.set_intersection(V.tickets(spark, sf).withColumnRenamed("ticket_id", "id"), V.vectors(spark, sf), ["id"])


@query("k05_union_unique", with_views("""SELECT id, min_by(origin, o) AS origin FROM (SELECT ticket_id AS id, 'ticket' AS origin, 0 AS o FROM tickets WHERE has_solution UNION ALL SELECT id, 'vector', 1 FROM vectors) GROUP BY id""",
                                      "tickets", "vectors"))
def _(spark, sf):
    a = V.tickets(spark, sf).filter("has_solution").select(F.col("ticket_id").alias("id"), F.lit("ticket").alias("origin"))
    return tickets.union_unique(a, V.vectors(spark, sf).select("id", F.lit("vector").alias("origin")), ["id"])


# --- messages and metrics ---------------------------------------------------------------

as_of = lambda: F.lit(V.AS_OF).cast("timestamp")
RECENT = f"created > TIMESTAMP '{V.AS_OF}' - INTERVAL 7200 MINUTE AND created <= TIMESTAMP '{V.AS_OF}'"


@query("p13_message_trace", with_views("""SELECT id, epoch_us(created) // 1000 AS created_ms, split_part(source, '.', -1) AS src, split_part(target, '.', -1) AS tgt, split_part(body_class, '.', -1) AS cls,
 CASE status WHEN 1 THEN 'Queued' WHEN 2 THEN 'Delivered' WHEN 6 THEN 'Aborted' ELSE 'Completed' END AS status FROM headers ORDER BY id DESC LIMIT 20""", "headers"))
def _(spark, sf):
    return messages.message_trace(V.headers(spark, sf)).select("id", F.unix_millis("created").alias("created_ms"), "src", "tgt", "cls", "status")


@query("a08_queue_depth", with_views("SELECT target AS component, count(*) AS depth FROM headers WHERE status = 1 GROUP BY 1", "headers"))
def _(spark, sf):
    return messages.queue_depth(V.headers(spark, sf))


@query("a09_error_rate", with_views(f"""SELECT target AS component, CAST(sum(CASE WHEN status = 6 THEN 1 ELSE 0 END) AS BIGINT) AS errors, count(*) AS total,
 round(sum(CASE WHEN status = 6 THEN 1 ELSE 0 END) / count(*) * 100, 1) AS rate FROM headers WHERE {RECENT} GROUP BY 1""", "headers"))
def _(spark, sf):
    return messages.error_rate(V.headers(spark, sf), as_of(), 7200)


@query("a10_latency_stats", with_views(f"""SELECT target AS component, round(avg((epoch_us(processed) - epoch_us(created)) // 1000), 6) AS avg_ms, max((epoch_us(processed) - epoch_us(created)) // 1000) AS max_ms
 FROM headers WHERE processed IS NOT NULL AND {RECENT} GROUP BY 1""", "headers"))
def _(spark, sf):
    return messages.latency_stats(V.headers(spark, sf), as_of(), 7200).withColumn("avg_ms", F.round("avg_ms", 6))


@query("a11_bottleneck", with_views(f"""SELECT true AS pool_exhausted, component, 'backlog' AS kind, 'Message backlog detected — ' || component || ' queue depth ' || depth || '.' AS message
 FROM (SELECT target AS component, count(*) AS depth FROM headers WHERE status = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
 UNION ALL SELECT false, component, 'errors', component || ' error rate ' || CAST(round(errors / total * 100, 1) AS VARCHAR) || '% (' || errors || '/' || total || ' messages in the window).'
 FROM (SELECT target AS component, CAST(sum(CASE WHEN status = 6 THEN 1 ELSE 0 END) AS BIGINT) AS errors, count(*) AS total FROM headers WHERE {RECENT} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)""", "headers"))
def _(spark, sf):
    h = V.headers(spark, sf)
    depth, errors = messages.queue_depth(h), messages.error_rate(h, as_of(), 7200)
    return messages.bottleneck(depth, errors).unionByName(messages.bottleneck(depth, errors, queue_limit=10**12))


@query("a06_zscore_anomalies", with_views("""SELECT metric, epoch_us(ts) // 1000 AS ts_ms, value, round(z, 2) AS z_score, CASE WHEN z > 3.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, round(mean, 2) AS mean FROM (
  SELECT s.*, m.mean, abs((value - mean) / sd) AS z FROM samples s JOIN (SELECT metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM samples GROUP BY 1) m
  ON s.metric = m.metric WHERE n >= 5 AND sd > 0) WHERE z > 2.5""", "samples"))
def _(spark, sf):
    a = messages.zscore_anomalies(V.samples(spark, sf))
    return a.select("metric", F.unix_millis("ts").alias("ts_ms"), "value", "z_score", "severity", "mean")


@query("a07_linear_trends", with_views("""SELECT metric, CASE WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, round(s, 4) AS slope, round(m, 2) AS mean, round(s * 60, 2) AS delta60,
  round(p, 1) AS threshold_periods, CASE WHEN p < 7 THEN 'HIGH' WHEN p < 30 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM (
 SELECT metric, s, m, CASE WHEN s > 0 AND m > 0 THEN m * 0.5 / (s * 60) END AS p FROM (
  SELECT metric, count(*) AS n, regr_slope(value, i) AS s, avg(value) AS m FROM (
   SELECT metric, value + pos * k AS value, CAST(row_number() OVER (PARTITION BY metric ORDER BY ts, sample_id) - 1 AS DOUBLE) AS i FROM (
    SELECT *, epoch_us(ts) / 60000000.0 - 28401120 AS pos, CASE metric WHEN 'click' THEN 0.3::DOUBLE WHEN 'error' THEN -0.3::DOUBLE WHEN 'view' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS k FROM samples)) GROUP BY 1)
 WHERE n >= 10 AND abs(s) > 0.05 * m)""", "samples"))
def _(spark, sf):
    slope = F.when(F.col("metric") == "click", 0.3).when(F.col("metric") == "error", -0.3).when(F.col("metric") == "view", 2.0).otherwise(0.0)
    minutes = F.unix_micros("ts") / 60000000.0 - 28401120
    return messages.linear_trends(V.samples(spark, sf).withColumn("value", F.col("value") + minutes * slope))


# --- readiness -----------------------------------------------------------------------

CHECKS = """base AS (SELECT c_custkey, c_acctbal >= 0 AND c_custkey % 5 <> 0 AS demo, c_custkey % 9 <> 0 AS phone,
  c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1998-08-01' - 90) AS noted,
  c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '1998-08-01' - 365) AS visited FROM customer),
 cond AS (SELECT o_orderstatus IN ('F', 'O') AS coded FROM orders WHERE o_orderkey % 3 <> 0),
 n(name, floor, ok, n, txt) AS (
  SELECT 'Patient demographics', 90, count(*) FILTER (demo), count(*), 'patients have birthDate + gender' FROM base
  UNION ALL SELECT 'Recent clinical notes (90d)', 70, count(*) FILTER (noted), count(*), 'patients have a DocumentReference in the last 90 days' FROM base
  UNION ALL SELECT 'Conditions coded (SNOMED/ICD-10)', 80, count(*) FILTER (coded), count(*), 'active conditions have SNOMED or ICD-10 codes' FROM cond
  UNION ALL SELECT 'Patient contact points', 80, count(*) FILTER (phone), count(*), 'patients have a phone or email (telecom) on record' FROM base
  UNION ALL SELECT 'Recent encounter (12 months)', 60, count(*) FILTER (visited), count(*), 'patients have an encounter in the last 12 months' FROM base)"""


@query("a12_fhir_readiness", "WITH " + CHECKS + """
SELECT name AS "check", ok / n * 100 >= floor AS passed, round(ok / n * 100, 6) AS pct, ok || '/' || n || ' ' || txt AS detail, round(avg(ok / n * 100) OVER (), 6) AS score, avg(ok / n * 100) OVER () >= 80 AS ready FROM n""")
def _(spark, sf):
    p = fhir_patients(spark, sf).select(F.col("patient_id").alias("id"), "birthDate", "gender", F.col("telecom").isNotNull().alias("has_contact"))
    o = V.table(spark, sf, "orders").withColumn("patient", F.concat(F.lit("p"), F.col("o_custkey").cast("string"))).withColumn("date", F.col("o_orderdate").cast("date"))
    system = F.when(F.col("o_orderstatus") == "F", fixed.CODED_SYSTEMS[0]).when(F.col("o_orderstatus") == "O", fixed.CODED_SYSTEMS[1]).otherwise("local")
    cond = o.select("patient", (F.col("o_orderkey") % 3 != 0).alias("active"), F.array(system).alias("systems"))
    r = readiness.fhir_readiness(p, o.select("patient", "date"), cond, o.filter("o_orderstatus = 'F'").select("patient", "date"), F.lit("1998-08-01").cast("date"))
    return r.withColumn("pct", F.round("pct", 6)).withColumn("score", F.round("score", 6))


# --- evaluation ------------------------------------------------------------------------

KEYS = [r[0] for r in V.SYLLABLE_RULES]
TOOLS = {"1-URGENT": "TriggerFollowUp", "2-HIGH": "AssessSDoHRisk", "3-MEDIUM": "DraftCarePlan", "4-NOT SPECIFIED": "StartProduction", "5-LOW": "SearchPatients"}
EXPECTED = ["SearchPatients", "AssessSDoHRisk", "DraftCarePlan"]


def eval_cases(spark, sf):
    """Each patient is a case: the narrow rules predict, the wide rules are the truth."""
    truth = scored(spark, sf, V.SYLLABLE_RULES_WIDE)
    dom = F.create_map(*[x for k in KEYS for x in (F.lit(k), F.col(k))])
    t = truth.select("patient_id", "notes", "c_custkey", "c_acctbal", dom.alias("rule_domains"), F.col("priority").alias("rule_priority")).withColumn(
        "human_domains", F.col("rule_domains")).withColumn("human_priority", F.col("rule_priority"))
    t = t.withColumn("case_id", F.col("patient_id")).withColumn("adversarial", F.col("c_custkey") % 4 == 3)
    t = t.withColumn("expect_followup", F.col("c_acctbal") >= 0).withColumn("expected_trajectory", F.array(*[F.lit(x) for x in EXPECTED]))
    return t


def predicted(spark, sf):
    return scoring.score_domains(eval_cases(spark, sf), "notes", V.SYLLABLE_RULES)


def case_steps(spark, sf):
    table = F.create_map(*[F.lit(v) for kv in TOOLS.items() for v in kv])
    o = V.table(spark, sf, "orders")
    return o.select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("case_id"), F.element_at(table, F.col("o_orderpriority")).alias("tool"), F.col("o_orderkey").alias("pos"),
                    F.concat_ws(" ", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("result"))


def case_messages(spark, sf):
    return case_steps(spark, sf).filter("tool = 'TriggerFollowUp'").select("case_id", F.col("case_id").alias("patient_id"))


PRED = "pred AS (SELECT a.*, " + ", ".join(f"b.{k} AS t_{k}" for k in KEYS) + """, b.priority AS t_priority, a.c_custkey % 4 = 3 AS adversarial, a.c_acctbal >= 0 AS expect_followup
 FROM scored a JOIN scored_wide b ON a.patient_id = b.patient_id)"""
EVAL = with_views("", "patients", "scored", "scored_wide").rstrip() + ",\n" + PRED
_MISS = "concat_ws(',', " + ", ".join(f"CASE WHEN {k} <> t_{k} THEN '{k}' END" for k in sorted(KEYS)) + ")"
_TP = " + ".join(f"CASE WHEN {k} = 'HIGH' AND t_{k} = 'HIGH' THEN 1 ELSE 0 END" for k in KEYS)
_FP = " + ".join(f"CASE WHEN {k} = 'HIGH' AND t_{k} <> 'HIGH' THEN 1 ELSE 0 END" for k in KEYS)
_FN = " + ".join(f"CASE WHEN {k} <> 'HIGH' AND t_{k} = 'HIGH' THEN 1 ELSE 0 END" for k in KEYS)
HUMAN = f"hum AS (SELECT *, {_TP} AS tp, {_FP} AS fp, {_FN} AS fn FROM pred)"
PR, RE = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END"


@query("a13_eval_rule_regression", EVAL + f" SELECT patient_id AS case_id, {_MISS} = '' AND priority = t_priority AS passed, {_MISS} AS mismatches FROM pred")
def _(spark, sf):
    return evals.eval_rule_regression(predicted(spark, sf)).select("case_id", "passed", F.array_join("mismatches", ",").alias("mismatches"))


@query("a14_eval_vs_human", EVAL + ",\n" + HUMAN + f""" SELECT patient_id AS case_id, tp, fp, fn, round({PR}, 3) AS precision, round({RE}, 3) AS recall,
 round(CASE WHEN {PR} + {RE} > 0 THEN 2 * ({PR}) * ({RE}) / ({PR} + {RE}) ELSE 0.0 END, 3) AS f1, priority = t_priority AS priority_match FROM hum""")
def _(spark, sf):
    h = evals.eval_vs_human(predicted(spark, sf))
    return h.select("case_id", "tp", "fp", "fn", "precision", "recall", "f1", "priority_match")


_MICRO = EVAL + ",\n" + HUMAN + ", s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM hum WHERE NOT adversarial) "


@query("a14_micro_average", _MICRO + f"SELECT round({RE}, 3) AS micro_recall, round({PR}, 3) AS micro_precision FROM s")
def _(spark, sf):
    return evals.micro_average(evals.eval_vs_human(predicted(spark, sf)))


_TOOL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TOOLS.items()) + " END"
STEPS = f"steps AS (SELECT 'p' || o_custkey AS case_id, {_TOOL} AS tool, o_orderkey AS pos, o_orderstatus || ' ' || o_orderkey AS result FROM orders)"
_EXP = ", ".join(f"'{x}'" for x in EXPECTED)
_BEFORE = lambda a, b: f"coalesce(max(CASE WHEN tool = '{a}' THEN pos END) < min(CASE WHEN tool = '{b}' THEN pos END), true)"
TRAJ = STEPS + f""", seen AS (SELECT case_id, count(DISTINCT CASE WHEN tool IN ({_EXP}) THEN tool END) AS hit, count(DISTINCT tool) AS got,
  {_BEFORE('AssessSDoHRisk', 'DraftCarePlan')} AS b1, {_BEFORE('StartProduction', 'TriggerFollowUp')} AS b2, bool_or(tool = 'TriggerFollowUp') AS trig,
  array_to_string(list_sort(list_filter([{_EXP}], lambda x: NOT list_contains(list(tool), x))), ',') AS missing, array_to_string(list_sort(list_filter(list_distinct(list(tool)), lambda x: NOT list_contains([{_EXP}], x))), ',') AS extra FROM steps GROUP BY 1),
 traj AS (SELECT 'p' || c_custkey AS case_id, coalesce(hit, 0) AS hit, coalesce(got, 0) AS got, coalesce(b1, true) AS b1, coalesce(b2, true) AS b2, coalesce(trig, false) = (c_acctbal >= 0) AS met,
  coalesce(missing, array_to_string(list_sort([{_EXP}]), ',')) AS missing, coalesce(extra, '') AS extra
  FROM customer LEFT JOIN seen ON seen.case_id = 'p' || c_custkey)"""


@query("a15_eval_trajectory", "WITH " + TRAJ + """ SELECT case_id, hit = 3 AND b1 AND b2 AND met AS passed, round(CASE WHEN got > 0 THEN hit / got ELSE 0.0 END, 3) AS precision, round(hit / 3, 3) AS recall,
 missing, extra, b1 AS assessed_before_plan, b2 AS started_before_trigger, met AS followup_expectation_met FROM traj""")
def _(spark, sf):
    t = evals.eval_trajectory(eval_cases(spark, sf), case_steps(spark, sf))
    return t.select("case_id", "passed", "precision", "recall", F.array_join(F.array_sort("missing"), ",").alias("missing"), F.array_join(F.array_sort("extra"), ",").alias("extra"), "assessed_before_plan",
                    "started_before_trigger", "followup_expectation_met")


OUTCOME = """SELECT 'p' || c_custkey AS case_id, (coalesce(n, 0) > 0) = (c_acctbal >= 0) AS passed, coalesce(n, 0) > 0 AS fired, coalesce(n, 0) AS n_messages FROM customer
 LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) m ON o_custkey = c_custkey"""


@query("a16_eval_outcome", OUTCOME)
def _(spark, sf):
    return evals.eval_outcome(eval_cases(spark, sf), case_messages(spark, sf))


def quality_cases(spark, sf):
    return eval_cases(spark, sf).withColumn("final_text", F.col("notes")).withColumn("actionable", F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey") % 5 + 1)).withColumn(
        "privacy_respected", F.lit(5).cast("long")).withColumn("no_fabrication", F.lit(4).cast("long"))


QUALITY = """qual AS (SELECT patient_id AS case_id, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 5 + 1 END AS actionable, CASE WHEN contains(lower(coalesce(notes, '')), 'heit') THEN 2 ELSE 5 END AS privacy_respected FROM patients)"""


@query("a17_eval_quality", "WITH " + V.CTE["patients"] + ", " + QUALITY + " SELECT case_id, least(actionable, privacy_respected, 4) >= 3 AS passed, actionable, privacy_respected FROM qual")
def _(spark, sf):
    return evals.eval_quality(quality_cases(spark, sf), ["heit"]).select("case_id", "passed", "actionable", "privacy_respected")


def plans_of(spark, sf, mode):
    p = scoring.parse_assessment(scored(spark, sf))
    p = evals.plan_bodies(scoring.with_plan_steps(p, mode))
    return p.select("patient_id", evals.plan_profile(F.col("domains")).alias("profile"), "body")


_PROFILE = "concat_ws(',', " + ", ".join(f"CASE WHEN {k} = 'HIGH' THEN '{k}' END" for k in sorted(fixed.PLAN_DOMAINS)) + ")"


@query("a18_same_plan_different_needs", with_views(f"""SELECT a.profile AS profile_a, b.profile AS profile_b, a.n * b.n AS n_pairs, a.f AS patient_a, b.f AS patient_b FROM
 (SELECT {_PROFILE} AS profile, count(*) AS n, min(patient_id) AS f FROM scored GROUP BY 1) a JOIN (SELECT {_PROFILE} AS profile, count(*) AS n, min(patient_id) AS f FROM scored GROUP BY 1) b ON a.profile < b.profile""",
                                                   "patients", "scored"))
def _(spark, sf):
    pairs, _s = evals.eval_differentiation(plans_of(spark, sf, "label"))
    return pairs.select("profile_a", "profile_b", "n_pairs", "patient_a", "patient_b")


@query("a18_eval_differentiation", with_views(f"""SELECT 'label' AS mode, count(DISTINCT p) = 1 AS passed, 1 AS distinct_plans, CAST(sum(n) AS BIGINT) AS patients_compared, true AS all_identical,
  CAST((sum(n) * sum(n) - sum(n * n)) / 2 AS BIGINT) AS n_violations FROM (SELECT {_PROFILE} AS p, count(*) AS n FROM scored GROUP BY 1)
 UNION ALL SELECT 'value', true, count(DISTINCT {_PROFILE}), count(*), false, 0 FROM scored""", "patients", "scored"))
def _(spark, sf):
    """Scored once; both kinds of plan on one row."""
    p = scoring.parse_assessment(scored(spark, sf)).withColumn("profile", evals.plan_profile(F.col("domains")))
    for mode in ("label", "value"):
        p = evals.plan_bodies(scoring.with_plan_steps(p, mode)).withColumnRenamed("body", f"_{mode}").drop("plan_steps")
    kinds = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"_{m}").alias("body")) for m in ("label", "value")])
    return evals.eval_differentiation(p.select("patient_id", "profile", F.explode_outer(kinds).alias("k")).select("patient_id", "profile", "k.*"), ["mode"])[1]


@query("a19_eval_suite", EVAL + ", " + TRAJ + ", " + QUALITY + f""", outc AS ({OUTCOME}),
 l(layer, passed) AS (SELECT 'L1_rule_regression', {_MISS} = '' AND priority = t_priority FROM pred UNION ALL SELECT 'L2_trajectory', hit = 3 AND b1 AND b2 AND met FROM traj
  UNION ALL SELECT 'L3_outcome', passed FROM outc UNION ALL SELECT 'L4_quality', least(actionable, privacy_respected, 4) >= 3 FROM qual)
 SELECT layer, count(*) FILTER (passed) AS passed, count(*) AS total, layer <> 'L4_quality' AND count(*) FILTER (passed) < count(*) AS failed_gate FROM l GROUP BY layer""")
def _(spark, sf):
    cases = eval_cases(spark, sf)
    return evals.eval_suite({
        "L1_rule_regression": evals.eval_rule_regression(predicted(spark, sf)), "L2_trajectory": evals.eval_trajectory(cases, case_steps(spark, sf)),
        "L3_outcome": evals.eval_outcome(cases, case_messages(spark, sf)), "L4_quality": evals.eval_quality(quality_cases(spark, sf), ["heit"])})


@query("a20_compare_rules", _MICRO + f""", pm AS (SELECT round(avg(CASE WHEN priority = t_priority THEN 1 ELSE 0 END), 3) AS v FROM pred WHERE NOT adversarial)
 SELECT metric, a, b, round(b - a, 3) AS delta FROM (SELECT 'micro_recall' AS metric, round({RE}, 3) AS a, 1.0::DOUBLE AS b FROM s UNION ALL SELECT 'micro_precision', round({PR}, 3), 1.0::DOUBLE FROM s
  UNION ALL SELECT 'priority_match', v, 1.0::DOUBLE FROM pm)""")
def _(spark, sf):
    return evals.compare_rules(eval_cases(spark, sf), "notes", V.SYLLABLE_RULES, V.SYLLABLE_RULES_WIDE)


@query("w03_ordering_constraint", f"WITH {STEPS} SELECT case_id AS run_id, {_BEFORE('AssessSDoHRisk', 'DraftCarePlan')} AS ok FROM steps GROUP BY 1")
def _(spark, sf):
    return evals.ordering_constraint(case_steps(spark, sf).withColumnRenamed("case_id", "run_id"), "AssessSDoHRisk", "DraftCarePlan")


@query("w04_last_result", f"""WITH {STEPS} SELECT r.case_id AS run_id, t.tool, coalesce(arg_max(s.result, s.pos), '') AS result FROM (SELECT DISTINCT case_id FROM steps) r
 JOIN (VALUES ('AssessSDoHRisk'), ('DraftCarePlan')) t(tool) ON true LEFT JOIN steps s ON s.case_id = r.case_id AND s.tool = t.tool GROUP BY 1, 2""")
def _(spark, sf):
    return evals.last_result(case_steps(spark, sf).withColumnRenamed("case_id", "run_id"), ["AssessSDoHRisk", "DraftCarePlan"])


@query("j16_case_outcome_join", f"""WITH {STEPS} SELECT 'p' || c_custkey AS case_id, coalesce(a, '') AS assessment, coalesce(d, '') AS plan, coalesce(n, 0) AS n_messages FROM customer LEFT JOIN (
 SELECT case_id, arg_max(result, pos) FILTER (tool = 'AssessSDoHRisk') AS a, arg_max(result, pos) FILTER (tool = 'DraftCarePlan') AS d, count(*) FILTER (tool = 'TriggerFollowUp') AS n FROM steps GROUP BY 1) s
 ON s.case_id = 'p' || c_custkey""")
def _(spark, sf):
    tools = ["AssessSDoHRisk", "DraftCarePlan"]
    cases = V.table(spark, sf, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("case_id"))
    j = evals.case_outcome_join(cases, case_steps(spark, sf), case_messages(spark, sf), tools)
    return j.select("case_id", F.col("AssessSDoHRisk").alias("assessment"), F.col("DraftCarePlan").alias("plan"), "n_messages")


# --- follow-ups --------------------------------------------------------------------------

OUT = """CASE WHEN NOT coalesce(c_acctbal >= 0, false) THEN 'blocked' WHEN o_custkey % 26 = 25 THEN 'scheduling_failed' WHEN o_orderkey % 17 = 0 THEN 'fhir_write_failed' ELSE 'completed' END"""


def followup_inputs(spark, sf):
    req = patients.normalise_followup(followups(spark, sf)).filter("error is null").withColumn("region", (F.col("o_custkey") % 26).cast("int"))
    consent = V.table(spark, sf, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("patient_id"), (F.col("c_acctbal") >= 0).alias("approved"))
    schedule = V.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("region")).agg(F.min("s_suppkey").cast("string").alias("worker_id"))
    schedule = V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("region")).join(schedule, "region", "left").withColumn("worker_id", F.coalesce("worker_id", F.lit("0")))
    writes = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), (F.col("o_orderkey") % 17 != 0).alias("write_ok"))
    return req, consent, schedule, writes


@query("r03_followup_outcomes", f"""SELECT o_orderkey AS request_id, {OUT} AS status, CASE WHEN {OUT} = 'completed' THEN 'plan-' || substring(sha256(CAST(o_orderkey AS VARCHAR)), 1, 12) END AS care_plan_id,
 CASE WHEN {OUT} = 'blocked' THEN 'Consent not obtained or denied' END AS error FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 40 <> 0""")
def _(spark, sf):
    return patients.followup_outcomes(*followup_inputs(spark, sf)).select("request_id", "status", "care_plan_id", "error")


@query("r09_followup_messages", "WITH flow(seq, source, target, body_class) AS (VALUES " + ", ".join(f"({i + 1}, '{s}', '{t}', '{b}')" for i, (s, t, b) in enumerate(fixed.FOLLOWUP_FLOW)) +
       ") SELECT o_orderkey AS request_id, seq, source, target, body_class, 9 AS status FROM orders, flow WHERE o_orderkey % 40 <> 0")
def _(spark, sf):
    return patients.followup_messages(patients.normalise_followup(followups(spark, sf)).filter("error is null")).select("request_id", "seq", "source", "target", "body_class", "status")
