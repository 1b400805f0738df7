"""Queries over patients, rules, personal health information and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import build_traceparent, hex_id, traceparent
from ..operators import access, evals, messages, patients, phi, playbooks, scoring, traces
from . import views as V
from .registry import query
from .views import PC_ID_SQL, with_views

SYL = V.SYLLABLE_RULES
LOW_NOTE = "lower(coalesce(notes, ''))"


def scored(spark, sf, rules=SYL):
    return scoring.score_domains(V.patients(spark, sf), "notes", rules)


@query("p01_search_patients", with_views("""SELECT patient_id, name, conditions FROM patients
 WHERE contains(lower(name), 'machinery') OR contains(lower(conditions), 'machinery') OR patient_id = 'MACHINERY'""", "patients"))
def _(spark, sf):
    return patients.search_patients(V.patients(spark, sf), "MACHINERY").select("patient_id", "name", "conditions")


@query("p02_patient_summary", with_views(f"SELECT patient_id, {V.summary_sql()} AS summary FROM patients", "patients"))
def _(spark, sf):
    return patients.patient_summary(V.patients(spark, sf))


@query("p03_score_domains", with_views("SELECT patient_id, economic, education, health_care, neighborhood, social, transportation, high_count, priority, score_text FROM scored",
                                       "patients", "scored"))
def _(spark, sf):
    return scored(spark, sf).select("patient_id", *[r[0] for r in SYL], "high_count", "priority", "score_text")


@query("p04_score_domains_improved", with_views("SELECT patient_id, economic, education, health_care, neighborhood, social, transportation, high_count, priority FROM scored_wide",
                                                "patients", "scored_wide"))
def _(spark, sf):
    return scored(spark, sf, V.SYLLABLE_RULES_WIDE).select("patient_id", *[r[0] for r in SYL], "high_count", "priority")


EVIDENCE = [("economic_stability", "Economic Stability", ["tion", "heit", "ment", "ung"]), ("education_access", "Education Access", ["est", "ous"]),
            ("healthcare_access", "Health Care Access", ["schen", "wh", "que"]), ("neighborhood_environment", "Neighborhood/Built Env", ["and", "eux", "ly"]),
            ("social_context", "Social Context", ["ing", "ado", "ver"])]


def _evidence_ctes() -> str:
    arr = lambda w: "[" + ", ".join(f"'{x}'" for x in w) + "]"
    hits = ", ".join(f"list_filter({arr(w)}, lambda w: contains({LOW_NOTE}, w)) AS h_{k}" for k, _, w in EVIDENCE)
    lev = ", ".join(f"CASE WHEN len(h_{k}) >= 2 THEN 'HIGH' WHEN len(h_{k}) = 1 THEN 'MEDIUM' ELSE 'LOW' END AS {k}" for k, *_ in EVIDENCE)
    high = " + ".join(f"CASE WHEN {k} = 'HIGH' THEN 1 ELSE 0 END" for k, *_ in EVIDENCE)
    return f""", ev1 AS (SELECT *, {hits} FROM patients), ev2 AS (SELECT *, {lev} FROM ev1), ev3 AS (SELECT *, {high} AS high_count FROM ev2),
 ev AS (SELECT *, {V.priority_sql('high_count', 4, 2)} AS priority FROM ev3)
"""


@query("p05_score_domains_evidence", "WITH " + V.CTE["patients"] + _evidence_ctes() +
       "SELECT patient_id, economic_stability, healthcare_access, array_to_string(h_economic_stability[1:3], ',') AS evidence, high_count, priority FROM ev")
def _(spark, sf):
    out = scoring.score_domains_evidence(V.patients(spark, sf), "notes", EVIDENCE)
    return out.select("patient_id", "economic_stability", "healthcare_access", F.array_join("economic_stability_evidence", ",").alias("evidence"), "high_count", "priority")


def _plan_sql(value: bool) -> str:
    rows = []
    if value:
        rows = [(f"{k} = 'HIGH'", s) for k, s in fixed.VALUE_PLAN]
    else:
        for words, steps in fixed.LABEL_PLAN:
            rows += [(V.any_sql("lower(score_text)", words), s) for s in steps]
    rows.append(("true", fixed.CLOSING_STEP))
    parts = " UNION ALL ".join(f"SELECT patient_id, {i} AS o, '{s}' AS step FROM scored WHERE {c}" for i, (c, s) in enumerate(rows))
    return f"SELECT patient_id, row_number() OVER (PARTITION BY patient_id ORDER BY o) AS step_no, step FROM ({parts})"


@query("p06_care_plan", with_views(_plan_sql(False), "patients", "scored"))
def _(spark, sf):
    return scoring.care_plan(scored(spark, sf), "label")


@query("p07_care_plan_by_value", with_views(_plan_sql(True), "patients", "scored"))
def _(spark, sf):
    return scoring.care_plan(scored(spark, sf), "value")


def _brief_sql() -> str:
    acts = " + ".join(f"CASE WHEN {k} = 'HIGH' THEN 1 ELSE 0 END" for _, k, _ in fixed.BRIEF_ACTIONS)
    label = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.BRIEF_LABELS.items())
    return f"SELECT patient_id, CASE priority {label} END AS priority_label, {acts} + 1 + CASE WHEN priority = 'URGENT' THEN 2 ELSE 0 END AS n_actions FROM ev"


@query("p08_action_brief", "WITH " + V.CTE["patients"] + _evidence_ctes() + _brief_sql())
def _(spark, sf):
    ev = scoring.score_domains_evidence(V.patients(spark, sf), "notes", EVIDENCE)
    return scoring.action_brief(ev).select("patient_id", "priority_label", F.size("actions").alias("n_actions"))


@query("p09_search_notes", """SELECT 'p' || o_custkey AS patient_id, o_orderkey AS doc_id, description FROM (
  SELECT *, o_orderpriority || ' ' || o_orderstatus AS description FROM orders) WHERE contains(lower(description), 'high')""")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    docs = o.select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("patient_id"), F.col("o_orderkey").alias("doc_id"), F.lit("current").alias("status"),
                    F.col("o_orderdate").alias("date"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("description"))
    return patients.search_notes(docs, "HIGH").select("patient_id", "doc_id", "description")


READY = """CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS no_birth, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS no_gender, CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS no_phone"""
ISSUES = """concat_ws(', ', CASE WHEN no_birth = 1 THEN 'missing birthDate' END, CASE WHEN no_gender = 1 THEN 'missing gender' END, CASE WHEN no_phone = 1 THEN 'no contact point' END)"""


def fhir_patients(spark, sf):
    c = V.table(spark, sf, "customer")
    phone = F.array(F.struct(F.lit("phone").alias("system"), F.lit("1").alias("value")))
    return c.select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("patient_id"), F.when(F.col("c_acctbal") >= 0, "1970-01-01").alias("birthDate"),
                    F.when(F.col("c_custkey") % 5 != 0, "other").otherwise("").alias("gender"), F.when(F.col("c_custkey") % 9 != 0, phone).alias("telecom"), "c_custkey")


@query("p12_readiness_rule", f"SELECT 'p' || c_custkey AS patient_id, {ISSUES} AS issues, no_birth + no_gender + no_phone = 0 AS ready FROM (SELECT *, {READY} FROM customer)")
def _(spark, sf):
    return patients.readiness_rule(fhir_patients(spark, sf)).select("patient_id", "issues", "ready")


# --- personal health information: text made ASCII first, on both sides ---------------

ASCII = "regexp_replace({c}, '[^\\x00-\\x7F]', ' ', 'g')"


def _sql_rx(rx: str) -> str:
    return "'" + rx.replace("'", "''") + "'"


def phi_counts_sql(c: str) -> str:
    return ", ".join(f"len(regexp_extract_all({c}, {_sql_rx(rx)})) AS n_{name.lower()}" for name, rx in fixed.PHI_PATTERNS)


def redact_sql(c: str) -> str:
    for name, rx in fixed.PHI_PATTERNS:
        c = f"regexp_replace({c}, {_sql_rx(rx)}, '<{name}>', 'g')"
    return c


PHI_SUM = " + ".join(f"n_{name.lower()}" for name, _ in fixed.PHI_PATTERNS)


@query("p14_field_policy", "SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 2) THEN 0.3::DOUBLE ELSE 0.35::DOUBLE END AS threshold, 19 AS n_blocked, 9 AS n_safe FROM documents")
def _(spark, sf):
    names = F.array(*[F.lit(x) for x in ("fhir", "sdoh_assessment", "prior_auth", "unheard_of")])
    d = V.texts(spark, sf).withColumn("src", F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int")))
    return phi.policy_for(d, "src").select("doc_id", "threshold", F.size("blocked").alias("n_blocked"), F.size("safe").alias("n_safe"))


def phi_fields(spark, sf):
    d = V.texts(spark, sf)
    return d.select("doc_id", "text", F.col("lang").alias("risk_level"), F.col("source").alias("email"), F.lit("fhir").alias("src"))


@query("p15_scan_phi", f"""WITH c AS (SELECT doc_id, {phi_counts_sql(ASCII.format(c='text'))} FROM documents)
 SELECT doc_id, 'text' AS field, {PHI_SUM} > 0 AS is_sensitive, CAST({PHI_SUM} AS BIGINT) AS n, CASE WHEN {PHI_SUM} > 0 THEN 'local' ELSE 'cloud' END AS provider FROM c
 UNION ALL SELECT doc_id, 'risk_level', false, 0, 'cloud' FROM documents UNION ALL SELECT doc_id, 'email', true, 1, 'local' FROM documents""")
def _(spark, sf):
    s = phi.scan_phi(phi_fields(spark, sf), ["text", "risk_level", "email"], "doc_id", "src")
    return s.select("doc_id", "field", "is_sensitive", F.aggregate("entities", F.lit(0).cast("long"), lambda a, e: a + e["n"]).alias("n"), "provider")


def _entity_totals_sql() -> str:
    one = "SELECT * FROM (SELECT '{n}' AS type, CAST(sum(len(regexp_extract_all({t}, {rx}))) AS BIGINT) AS n FROM documents) WHERE n > 0"
    return " UNION ALL ".join(one.format(n=n, t=ASCII.format(c="text"), rx=_sql_rx(rx)) for n, rx in fixed.PHI_PATTERNS)


@query("p15_phi_entities", _entity_totals_sql())
def _(spark, sf):
    e = phi.phi_entities(V.texts(spark, sf), "text", "doc_id")
    return e.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("p16_redact_phi", f"""SELECT doc_id, {redact_sql(ASCII.format(c='text'))} AS redacted, CAST({PHI_SUM} AS BIGINT) AS n_entities FROM (
 SELECT doc_id, text, {phi_counts_sql(ASCII.format(c='text'))} FROM documents)""")
def _(spark, sf):
    return phi.redact_phi(V.texts(spark, sf), "text", "doc_id")


@query("p17_routing_audit", f"""WITH c AS (SELECT doc_id, {phi_counts_sql(ASCII.format(c='text'))} FROM documents)
 SELECT doc_id, CASE WHEN {PHI_SUM} > 0 THEN 'local' ELSE 'cloud' END AS text_to, CASE WHEN {PHI_SUM} > 0 THEN 2 ELSE 1 END AS n_local, CASE WHEN {PHI_SUM} > 0 THEN 1 ELSE 2 END AS n_cloud FROM c""")
def _(spark, sf):
    a = phi.routing_audit(phi_fields(spark, sf), ["text", "risk_level", "email"], "doc_id", "src")
    return a.select("doc_id", F.col("field_routings")["text"].alias("text_to"), "n_local", "n_cloud")


def payloads(spark, sf):
    """Documents with trigger words put in front of every fifth one."""
    d = V.texts(spark, sf)
    head = (F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("Patient Name: Ann Lee, mrn=77, "), F.lit("dob: 1970\n")))
            .when(F.col("doc_id") % 15 == 5, "claim FAIL_DEID ").when(F.col("doc_id") % 5 == 0, "encounter ssn : 123\n").otherwise(""))
    return d.select(F.col("doc_id").alias("id"), F.concat(head, "text").alias("text"))


PAYLOADS = """WITH payloads AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'Patient Name: Ann Lee, mrn=77, dob: 1970' || chr(10) WHEN doc_id % 15 = 5 THEN 'claim FAIL_DEID '
 WHEN doc_id % 5 = 0 THEN 'encounter ssn : 123' || chr(10) ELSE '' END || text AS text FROM documents)
"""
_HEALTH = V.any_sql("lower(text)", fixed.HEALTH_WORDS)
_MASK = "text"
for _rx, _to in fixed.DEIDENTIFY_PATTERNS:
    _to = _to.replace("$1", "\\1")
    _MASK = f"regexp_replace({_MASK}, {_sql_rx(_rx)}, '{_to}', 'g')"


@query("p18_deidentify_payload", PAYLOADS + f"""SELECT id, {_HEALTH} AS is_healthcare, {_HEALTH} AND contains(text, 'FAIL_DEID') AS failed,
 CASE WHEN {_HEALTH} AND contains(text, 'FAIL_DEID') THEN NULL WHEN {_HEALTH} THEN {_MASK} ELSE text END AS clean,
 CASE WHEN {_HEALTH} AND contains(text, 'FAIL_DEID') THEN '{fixed.DEIDENTIFY_REMEDIATION}' END AS remediation FROM payloads""")
def _(spark, sf):
    return phi.deidentify_payload(payloads(spark, sf), "text").select("id", "is_healthcare", "failed", "clean", "remediation")


@query("p19_payload_class", PAYLOADS + """SELECT id, length(text) AS n_chars, greatest(1, length(text) // 4) AS tokens,
 CASE WHEN length(text) < 1000 THEN 'small' WHEN length(text) < 10000 THEN 'medium' ELSE 'large' END AS size_class FROM payloads""")
def _(spark, sf):
    return phi.payload_class(payloads(spark, sf), "text")


@query("p20_intercept_large", PAYLOADS + """, f AS (SELECT *, length(text) <= 4000 AND greatest(1, length(text) // 4) <= 1000 AS keep FROM payloads)
SELECT id, NOT keep AS stored, CASE WHEN keep THEN text ELSE 'Large output (' || length(text) || ' chars, ~' || greatest(1, length(text) // 4) || ' tokens) stored in ''' || id || '_result''.' || chr(10) ||
 'Preview: ' || replace(substring(text, 1, 200), chr(10), ' ') || '...' END AS output, CASE WHEN keep THEN 0 ELSE length(text) END AS n_stored FROM f""")
def _(spark, sf):
    inline, kept = phi.intercept_large(payloads(spark, sf), "text")
    sizes = kept.select("id", F.length("value").alias("n_stored"))
    return inline.join(sizes, "id", "left").withColumn("n_stored", F.coalesce("n_stored", F.lit(0)))


@query("p21_peek", PAYLOADS + """SELECT id, length(text) AS total, CASE WHEN 500 < length(text) THEN substring(text, 501, 1000) END AS slice,
 CASE WHEN 1500 < length(text) THEN 1500 END AS next FROM payloads""")
def _(spark, sf):
    return phi.peek(payloads(spark, sf), "text", 500, 1000).select("id", "total", "slice", "next")


@query("p22_resolve_refs", """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'see ' || source || ' and <missing:nope>.' ELSE text END AS text FROM documents""")
def _(spark, sf):
    d = V.texts(spark, sf)
    t = F.when(F.col("doc_id") % 3 == 0, "see {{var:where}} and {{var:nope}}.").otherwise(F.col("text"))
    rows = d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("session_id"), t.alias("text"))
    variables = d.select(F.col("doc_id").alias("session_id"), F.lit("where").alias("name"), F.col("source").alias("value"))
    return phi.resolve_refs(rows, variables, "text")


@query("p23_parse_assessment", with_views("SELECT patient_id, economic, transportation, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE priority END AS priority FROM scored", "patients", "scored"))
def _(spark, sf):
    s = scored(spark, sf)
    cut = F.when(F.col("c_custkey") % 6 == 0, F.replace("score_text", F.lit("Overall Priority"), F.lit("Overall"))).otherwise(F.col("score_text"))
    p = scoring.parse_assessment(s.select("patient_id", cut.alias("score_text")))
    return p.select("patient_id", F.col("domains")["economic"].alias("economic"), F.col("domains")["transportation"].alias("transportation"), F.col("parsed_priority").alias("priority"))


def followups(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderkey") % 40 != 0, F.concat(F.lit("p"), F.col("o_custkey").cast("string"))).alias("patient_id"),
                    F.lower(F.substring("o_orderpriority", 3, 100)).alias("priority"), "o_custkey", F.lit(None).cast("string").alias("requested_by"))


@query("p24_normalise_followup", """SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 40 <> 0 THEN 'p' || o_custkey END AS patient_id,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'routine' END AS priority, CASE WHEN o_orderkey % 40 = 0 THEN 'patient_id is required' END AS error,
 CASE WHEN o_orderkey % 40 <> 0 THEN substring(sha256(o_orderkey || '|p' || o_custkey), 1, 8) END AS job_id FROM orders""")
def _(spark, sf):
    return patients.normalise_followup(followups(spark, sf)).select("request_id", "patient_id", "priority", "error", "job_id")


@query("p25_approval_required", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN false WHEN l_returnflag = 'R' THEN true ELSE l_quantity > 25 END AS required FROM lineitem""")
def _(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat("l_linestatus", "l_returnflag").alias("tool"),
                                               F.when(F.col("l_quantity") > 25, "write").otherwise("read").alias("effect"))
    pol = {"exempt_tools": ["OA"], "extra_tools": ["OR", "FR"]}
    return access.approval_required(li, pol).select("l_orderkey", "l_linenumber", "l_partkey", "required")


@query("p26_traceparent", """SELECT event_id, event_id % 3 <> 0 AS valid, CASE WHEN event_id % 3 <> 0 THEN substring(sha256(CAST(event_id AS VARCHAR)), 1, 32) END AS trace_id,
 CASE WHEN event_id % 3 <> 0 THEN substring(sha256(CAST(user_id AS VARCHAR)), 1, 16) END AS span_id FROM events""")
def _(spark, sf):
    e = V.table(spark, sf, "events")
    good = build_traceparent(hex_id(32, "event_id"), hex_id(16, "user_id"))
    tp = traceparent(F.when(F.col("event_id") % 3 == 0, F.substring(good, 1, 40)).otherwise(good))
    return e.select("event_id", tp.alias("t")).select("event_id", "t.*")


@query("p27_tool_spans", """SELECT 't' || conv_id AS trace_id, 'execute_tool ' || role AS name, (turn + 1) * 1000000000 - CASE WHEN turn % 5 = 4 THEN 0 ELSE length(text) * 1000000 END AS start_ns,
 CASE WHEN turn % 5 = 4 OR turn % 3 = 2 THEN 2 ELSE 0 END AS status, CASE WHEN turn % 5 = 4 THEN NULL ELSE length(text) END AS n_out,
 CASE WHEN turn % 3 = 2 THEN 'failed' END AS error, CASE WHEN turn % 5 = 4 THEN 'true' END AS denied, turn AS call_id FROM conversations""")
def _(spark, sf):
    c = V.table(spark, sf, "conversations")
    calls = c.select(F.col("turn").cast("string").alias("call_id"), F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("trace_id"), F.lit("").alias("parent_span_id"),
                     F.col("conv_id").cast("string").alias("session_id"), F.col("role").alias("tool"), F.lit("{}").alias("input"), F.col("text").alias("output"),
                     F.when(F.col("turn") % 3 == 2, "failed").alias("error"), (F.col("turn") % 5 == 4).alias("denied"),
                     ((F.col("turn") + 1) * 1_000_000_000).alias("end_ns"), F.length("text").alias("duration_ms"))
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    s = traces.tool_spans(calls)
    return s.select("trace_id", "name", "start_ns", "status", F.length(at("gen_ai.tool.output")).alias("n_out"), at("gen_ai.tool.error").alias("error"),
                    at("gen_ai.tool.denied").alias("denied"), at("gen_ai.tool.call_id").cast("long").alias("call_id"))


@query("p28_chat_spans", """SELECT 't' || conv_id AS trace_id, turn AS call_id_seen, CASE WHEN length(text) // 4 > 0 THEN CAST(length(text) // 4 AS VARCHAR) END AS input_tokens,
 CASE WHEN role = 'assistant' AND text <> '' THEN 1 ELSE 0 END AS n_events, (turn + 1) * 1000000000 AS start_ns FROM conversations""")
def _(spark, sf):
    c = V.table(spark, sf, "conversations")
    calls = c.select(F.col("turn").alias("call_id"), F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("trace_id"), F.lit("").alias("parent_span_id"),
                     F.col("turn").cast("string").alias("session_id"), F.lit("m").alias("model"), F.floor(F.length("text") / 4).alias("input_tokens"), F.lit(0).alias("output_tokens"),
                     F.when(F.col("role") == "assistant", F.col("text")).alias("completion"), ((F.col("turn") + 1) * 1_000_000_000).alias("start_ns"), F.lit(0).cast("long").alias("end_ns"))
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    s = traces.chat_spans(calls, capture=True)
    return s.select("trace_id", at("session.id").cast("long").alias("call_id_seen"), at("gen_ai.usage.input_tokens").alias("input_tokens"), F.size("events").alias("n_events"), "start_ns")


@query("p28_turn_spans", """SELECT 't' || conv_id AS trace_id, min(turn + 1) * 1000000000 AS start_ns, max(turn + 2) * 1000000000 AS end_ns, 'gen_ai.agent_turn' AS name FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    c = V.table(spark, sf, "conversations").groupBy("conv_id").agg((F.min("turn") + 1).alias("a"), (F.max("turn") + 2).alias("b"))
    turns = c.select(F.col("conv_id").alias("turn_id"), F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("trace_id"), F.lit("q").alias("query"),
                     (F.col("a") * 1_000_000_000).alias("start_ns"), (F.col("b") * 1_000_000_000).alias("end_ns"))
    return traces.turn_spans(turns).select("trace_id", "start_ns", "end_ns", "name")


@query("p29_message_spans", with_views("""SELECT CASE kind WHEN 'service' THEN 'bs.' WHEN 'process' THEN 'bp.' ELSE 'bo.' END || split_part(target, '.', -1) AS name,
 CASE kind WHEN 'service' THEN 'Server' WHEN 'process' THEN 'Internal' ELSE 'Client' END AS span_kind, epoch_us(created) * 1000 AS start_ns, epoch_us(coalesce(processed, created)) * 1000 AS end_ns,
 CASE WHEN status IN (4, 6) THEN 'Error' ELSE 'Ok' END AS status, CASE kind WHEN 'service' THEN 'receive' WHEN 'process' THEN 'process' ELSE 'send' END AS op FROM headers""", "headers"))
def _(spark, sf):
    s = messages.message_spans(V.headers(spark, sf))
    return s.select("name", "span_kind", "start_ns", "end_ns", "status", F.col("attributes")["messaging.operation"].alias("op"))


# --- joins on rules -------------------------------------------------------------------


def _protocol_sql() -> str:
    low = "lower(conditions || ' ' || coalesce(notes, ''))"
    parts = []
    for words, names in V.SYLLABLE_PROTOCOLS:
        parts += [f"SELECT patient_id, '{n}' AS protocol FROM patients WHERE {V.any_sql(low, words)}" for n in names]
    none = " OR ".join(V.any_sql(low, w) for w, _ in V.SYLLABLE_PROTOCOLS)
    parts += [f"SELECT patient_id, '{n}' FROM patients WHERE NOT ({none})" for n in V.SYLLABLE_DEFAULTS]
    return "SELECT DISTINCT patient_id, protocol FROM (" + " UNION ALL ".join(parts) + ")"


@query("j01_match_protocols", with_views(_protocol_sql(), "patients"))
def _(spark, sf):
    p = V.patients(spark, sf).withColumn("_t", F.concat_ws(" ", "conditions", F.coalesce("notes", F.lit(""))))
    return scoring.match_protocols(p, "_t", V.SYLLABLE_PROTOCOLS, V.SYLLABLE_DEFAULTS)


def _resources_sql() -> str:
    res = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (p, n, c)) + ")" for p, n, c, *_ in fixed.COMMUNITY_RESOURCES)
    fall = ", ".join(f"('{n}', '{c}')" for n, c, *_ in fixed.FALLBACK_RESOURCES)
    return f"""WITH req AS (SELECT o_orderkey AS req_id, CASE o_orderkey % 4 WHEN 0 THEN '021' WHEN 1 THEN '100' WHEN 2 THEN '999' ELSE '000' END AS prefix,
  CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'food' WHEN 2 THEN 'transportation' WHEN 3 THEN 'healthcare' ELSE 'nothing' END AS want FROM orders),
 res(prefix, name, category) AS (VALUES {res}), fall(name, category) AS (VALUES {fall}),
 found AS (SELECT req_id, name, res.category FROM req JOIN res ON req.prefix = res.prefix AND (want = '' OR res.category = want OR res.category = 'all')),
 miss AS (SELECT * FROM req WHERE req_id NOT IN (SELECT req_id FROM found))
 SELECT req_id, name, category FROM found UNION ALL SELECT req_id, name, category FROM miss JOIN fall ON want = '' OR prefix IN ('021', '100') OR category = want OR category = 'all'"""


@query("j02_community_resources", _resources_sql())
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    zips = F.array(*[F.lit(z) for z in ("02115", "10001", "99950", "12")])
    wants = F.array(*[F.lit(z) for z in ("", "food", "transportation", "healthcare", "nothing")])
    reqs = o.select(F.col("o_orderkey").alias("req_id"), F.element_at(zips, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("zip"),
                    F.element_at(wants, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("category"))
    res = spark.createDataFrame(fixed.COMMUNITY_RESOURCES, "prefix string, name string, category string, phone string, services string")
    return scoring.community_resources(reqs, res).select("req_id", "name", "category")


# --- playbook and SQL functions --------------------------------------------------------


def playbook_inputs(spark, sf):
    p = V.patients(spark, sf).withColumn("follow_up", F.when(F.col("c_custkey") % 3 == 0, "yes").otherwise("no")).withColumn(
        "priority_asked", F.when(F.col("c_custkey") % 2 == 0, "emergent"))
    d = V.table(spark, sf, "customer").filter("c_acctbal >= 2000").select(
        F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("patient_id"), (F.col("c_acctbal") >= 5000).alias("approve"), F.lit("lead").alias("approver"))
    return p, d


PLAYBOOK = f"""summed AS (SELECT *, {V.summary_sql()} AS summary FROM patients),
{V.scored_cte(SYL, 'ps', 'summed', 'summary')},
pb AS (SELECT *, substring(sha256('run|' || patient_id), 1, 16) AS run_id, high_count >= 5 OR c_custkey % 3 = 0 AS wants, c_acctbal >= 2000 AS decided, c_acctbal >= 5000 AS yes,
 CASE WHEN high_count >= 5 THEN 'urgent' WHEN c_custkey % 2 = 0 THEN 'emergent' ELSE 'routine' END AS followup_priority FROM ps)"""
PB_STATUS = "CASE WHEN wants AND NOT decided THEN 'awaiting_approval' ELSE 'succeeded' END"


@query("u04_playbook_runs", "WITH " + V.CTE["patients"] + ",\n" + PLAYBOOK + f"""
SELECT patient_id, run_id, {PB_STATUS} AS status, priority, followup_priority FROM pb""")
def _(spark, sf):
    runs, _s = playbooks.playbook_batch(*playbook_inputs(spark, sf), rules=SYL)
    return runs.select("patient_id", "run_id", "status", "priority", "followup_priority")


@query("u04_playbook_steps", "WITH " + V.CTE["patients"] + ",\n" + PLAYBOOK + """
SELECT tool, state, count(*) AS n FROM (SELECT tool, CASE WHEN o <= 4 THEN 'done' WHEN NOT wants THEN 'skipped' WHEN NOT decided THEN 'waiting' WHEN yes THEN 'done' WHEN o = 5 THEN 'rejected' ELSE 'skipped' END AS state
 FROM pb, (VALUES (1, 'FetchPatientSummary'), (2, 'SearchSDoHProtocols'), (3, 'AssessSDoHRisk'), (4, 'DraftCarePlan'), (5, 'TriggerFollowUp'), (6, 'GetInteropTraces')) t(o, tool)) GROUP BY 1, 2""")
def _(spark, sf):
    _r, steps = playbooks.playbook_batch(*playbook_inputs(spark, sf), rules=SYL)
    return playbooks.step_counts(steps)


def _plan_text_sql() -> str:
    steps, n = [], 1
    for _, s in fixed.LABEL_PLAN:
        for x in s:
            steps.append(f"{n}. {x}")
            n += 1
    steps.append(f"{n}. {fixed.CLOSING_STEP}")
    body = " || chr(10) || ".join(f"'{s}'" for s in steps)
    return f"'Care Plan for ' || patient_id || ':' || chr(10) || chr(10) || {body} || chr(10) || chr(10) || 'Priority: Urgent if 5+ domains HIGH - escalate to supervising CHW'"


@query("u03_assess_all", "WITH " + V.CTE["patients"] + ",\n" + PLAYBOOK + f"""
SELECT patient_id, {PB_STATUS} AS status, CASE WHEN wants AND NOT decided THEN 'AWAITING_APPROVAL ' || run_id ELSE {V.score_text_sql(SYL)} || chr(10) || chr(10) || {_plan_text_sql()} || chr(10) || chr(10) || 'Follow-up: ' ||
 CASE WHEN NOT wants THEN 'not triggered' WHEN yes THEN 'Follow-up triggered for ' || patient_id || ' (priority=' || followup_priority || ') jobId=' || substring(sha256('job|' || patient_id), 1, 8)
  ELSE 'REJECTED by lead' END END AS output FROM pb""")
def _(spark, sf):
    return playbooks.assess_all(*playbook_inputs(spark, sf), rules=SYL).select("patient_id", "status", "output")
