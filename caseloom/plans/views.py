"""Operator inputs derived from the given tables.

Each view exists twice: as a DataFrame and as the SQL text of a common table
expression, so a query and its SQL counterpart read the same thing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"

# Risk and protocol rules on syllables that occur in the corpus: the same rule
# shapes as the shipped tables, in the same operators.
SYLLABLE_RULES = [
    ("economic", "Economic Stability", ["tion", "heit"], "HIGH", "LOW"),
    ("education", "Education Access", ["ment"], "HIGH", "LOW"),
    ("health_care", "Health Care Access", ["schen", "wh"], "HIGH", "MEDIUM"),
    ("neighborhood", "Neighborhood/Built Env", ["and", "eux"], "HIGH", "LOW"),
    ("social", "Social Context", ["que", "ing"], "HIGH", "LOW"),
    ("transportation", "Transportation Access", ["ver", "ado", "lich"], "HIGH", "LOW"),
]
SYLLABLE_RULES_WIDE = [
    ("economic", "Economic Stability", ["tion", "heit", "ment"], "HIGH", "LOW"),
    ("education", "Education Access", ["ment", "ung"], "HIGH", "LOW"),
    ("health_care", "Health Care Access", ["schen", "wh", "ous"], "HIGH", "MEDIUM"),
    ("neighborhood", "Neighborhood/Built Env", ["and", "eux"], "HIGH", "LOW"),
    ("social", "Social Context", ["que", "ing", "ely"], "HIGH", "LOW"),
    ("transportation", "Transportation Access", ["ver", "ado", "lich", "est"], "HIGH", "LOW"),
]
SYLLABLE_PROTOCOLS = [(["tion", "heit"], ["Protocol A1", "Protocol A2", "Protocol A3"]), (["ment"], ["Protocol B1", "Protocol B2"]),
                      (["schen", "eux"], ["Protocol C1", "Protocol C2"]), (["machinery"], ["Protocol D1", "Protocol A1"])]
SYLLABLE_DEFAULTS = ["Protocol Z1", "Protocol Z2"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    """A table whose rows are costly to process. A file with one row group is read by
    one task; ``caseloom.local.tasks``, set by the local session alone, deals its
    rows to more. A cluster leaves it unset and reads its splits as they are."""
    tasks = spark.conf.get("caseloom.local.tasks", None)
    scan = table(spark, sf, name)
    return scan.repartition(int(tasks)) if tasks else scan


def pc_id(c: str):
    s = F.col(c).cast("string")
    return F.concat(F.lit("PC-"), F.lpad(s, F.greatest(F.lit(5), F.length(s)), F.lit("0")))


PC_ID_SQL = "'PC-' || lpad(CAST({c} AS VARCHAR), CAST(greatest(5, length(CAST({c} AS VARCHAR))) AS INTEGER), '0')"

CTE: dict[str, str] = {}


def with_views(body: str, *names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names) + "\n" + body


def tickets(spark: SparkSession, sf: str, heavy: bool = False) -> DataFrame:
    d = (texts if heavy else table)(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    good = F.col("quality") == 1
    return d.select(
        pc_id("doc_id").alias("ticket_id"), F.upper("source").alias("category"), F.col("lang").alias("hospital"),
        F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.split_part("text", F.lit("\n"), F.lit(1))).alias("summary"),
        F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text")).alias("problem"),
        F.when(good, F.split_part("text", F.lit("\n"), F.lit(-1))).otherwise("").alias("solution"),
        F.when(good, "Closed").when(F.col("quality") == 0, "Open").otherwise("").alias("status"),
        F.coalesce(good, F.lit(False)).alias("has_solution"), "doc_id")


CTE["tickets"] = f"""tickets AS (
 SELECT {PC_ID_SQL.format(c='d.doc_id')} AS ticket_id, upper(d.source) AS category, d.lang AS hospital,
  CASE WHEN d.doc_id % 11 = 0 THEN '' ELSE split_part(d.text, chr(10), 1) END AS summary,
  CASE WHEN d.doc_id % 7 = 0 THEN '' ELSE d.text END AS problem,
  CASE WHEN l.quality = 1 THEN split_part(d.text, chr(10), -1) ELSE '' END AS solution,
  CASE WHEN l.quality = 1 THEN 'Closed' WHEN l.quality = 0 THEN 'Open' ELSE '' END AS status,
  coalesce(l.quality = 1, false) AS has_solution, d.doc_id
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def patients(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf)
    n_docs = docs.count()  # one number from the file footers
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.array_join(F.sort_array(F.collect_set("o_orderstatus")), "|").alias("statuses"))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = texts(spark, sf, "customer").join(nation, "c_nationkey").join(orders, "c_custkey", "left")
    c = c.withColumn("doc_id", F.col("c_custkey") % n_docs).join(docs.select("doc_id", "text"), "doc_id", "left")
    return c.select(
        F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("patient_id"), F.col("c_name").alias("name"),
        F.col("n_name").alias("demographics"), F.concat_ws("|", "c_mktsegment", "statuses").alias("conditions"),
        F.concat(F.lit("Balance = "), F.floor("c_acctbal").cast("string")).alias("observations"), F.col("text").alias("notes"),
        "c_custkey", "c_acctbal", "c_nationkey")


CTE["patients"] = """patients AS (
 SELECT 'p' || CAST(c.c_custkey AS VARCHAR) AS patient_id, c.c_name AS name, n.n_name AS demographics,
  concat_ws('|', c.c_mktsegment, o.statuses) AS conditions, 'Balance = ' || CAST(CAST(floor(c.c_acctbal) AS BIGINT) AS VARCHAR) AS observations,
  d.text AS notes, c.c_custkey, c.c_acctbal, c.c_nationkey
 FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
 LEFT JOIN (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey
 LEFT JOIN documents d ON d.doc_id = c.c_custkey % (SELECT count(*) FROM documents))"""


def summary_sql(alias: str = "patients") -> str:
    return (f"'Patient: ' || {alias}.name || ', ' || {alias}.demographics || chr(10) || "
            f"array_to_string(list_transform(string_split({alias}.conditions, '|'), lambda x: 'Condition: ' || x), chr(10)) || chr(10) || "
            f"'Observation: ' || {alias}.observations || chr(10) || 'Note: ' || coalesce({alias}.notes, '')")


def any_sql(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def level_sql(c: str, rule: tuple) -> str:
    return f"CASE WHEN {any_sql(c, rule[2])} THEN '{rule[3]}' ELSE '{rule[4]}' END"


def levels_sql(c: str, rules: list[tuple]) -> str:
    return ", ".join(f"{level_sql(c, r)} AS {r[0]}" for r in rules)


def high_sql(rules: list[tuple], prefix: str = "") -> str:
    return " + ".join(f"CASE WHEN {prefix}{r[0]} = 'HIGH' THEN 1 ELSE 0 END" for r in rules)


def priority_sql(n: str, urgent: int = 5, high: int = 3) -> str:
    return f"CASE WHEN {n} >= {urgent} THEN 'URGENT' WHEN {n} >= {high} THEN 'HIGH' ELSE 'ROUTINE' END"


def score_text_sql(rules: list[tuple], id_col: str = "patient_id") -> str:
    lines = " || ".join(f"chr(10) || '{('  ' + (r[1] + ':').ljust(25))}' || {r[0]}" for r in rules)
    return (f"'SDoH Risk Assessment for ' || {id_col} || ':' || {lines} || chr(10) || 'Overall Priority: ' || priority || ' (' || "
            f"CAST(high_count AS VARCHAR) || '/{len(rules)} domains elevated)'")


def scored_cte(rules: list[tuple], name: str = "scored", source: str = "patients", text: str = "notes") -> str:
    """Patients scored on their note under a rule set."""
    return f"""{name}_1 AS (SELECT *, {levels_sql(f"lower(coalesce({text}, ''))", rules)} FROM {source}),
{name}_2 AS (SELECT *, {high_sql(rules)} AS high_count FROM {name}_1),
{name}_3 AS (SELECT *, {priority_sql('high_count')} AS priority FROM {name}_2),
{name} AS (SELECT *, {score_text_sql(rules)} AS score_text FROM {name}_3)"""


CTE["scored"] = scored_cte(SYLLABLE_RULES)
CTE["scored_wide"] = scored_cte(SYLLABLE_RULES_WIDE, "scored_wide")


def headers(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 6).when(F.col("event_type") == "view", 2).otherwise(9)
    kind = F.when(F.col("event_type") == "signup", "service").when(F.col("event_type") == "purchase", "operation").otherwise("process")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("App.Service."), F.col("event_type")).alias("source"),
        F.concat(F.lit("App.Process.P"), (F.col("user_id") % 10).cast("string")).alias("target"),
        F.concat(F.lit("App.Message."), F.upper("event_type")).alias("body_class"), F.col("ts").alias("created"),
        F.when(status != 1, F.timestamp_add("MILLISECOND", F.floor(F.col("value") * 10).cast("int"), F.col("ts"))).alias("processed"),
        status.alias("status"), kind.alias("kind"), "user_id")


CTE["headers"] = """headers AS (
 SELECT event_id AS id, 'App.Service.' || event_type AS source, 'App.Process.P' || CAST(user_id % 10 AS VARCHAR) AS target,
  'App.Message.' || upper(event_type) AS body_class, ts AS created,
  CASE WHEN event_type <> 'signup' THEN ts + to_milliseconds(CAST(floor(value * 10) AS BIGINT)) END AS processed,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 6 WHEN 'view' THEN 2 ELSE 9 END AS status,
  CASE event_type WHEN 'signup' THEN 'service' WHEN 'purchase' THEN 'operation' ELSE 'process' END AS kind, user_id
 FROM events)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("ts"), "value",
                                             F.col("event_id").alias("sample_id"))


CTE["samples"] = "samples AS (SELECT event_type AS metric, ts, value, event_id AS sample_id FROM events)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(pc_id("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"),
                                                 F.col("label").alias("cluster"), "vec_id")


CTE["vectors"] = f"vectors AS (SELECT {PC_ID_SQL.format(c='vec_id')} AS id, CAST(embedding AS DOUBLE[]) AS vec, label AS cluster, vec_id FROM embeddings)"


def clustered(spark: SparkSession, sf: str) -> DataFrame:
    return tickets(spark, sf).join(vectors(spark, sf).select(F.col("id").alias("ticket_id"), "cluster"), "ticket_id")


CTE["clustered"] = "clustered AS (SELECT t.*, v.cluster FROM tickets t JOIN vectors v ON t.ticket_id = v.id)"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    e = lambda df, p, a, pred, q, b: df.select(F.concat(F.lit(p), F.col(a).cast("string")).alias("src"), F.lit(pred).alias("pred"),
                                               F.concat(F.lit(q), F.col(b).cast("string")).alias("dst"))
    return (e(t("nation"), "n", "n_nationkey", "IN_REGION", "r", "n_regionkey")
            .unionByName(e(t("supplier"), "s", "s_suppkey", "BASED_IN", "n", "s_nationkey"))
            .unionByName(e(t("customer"), "c", "c_custkey", "BASED_IN", "n", "c_nationkey"))
            .unionByName(e(t("orders"), "o", "o_orderkey", "PLACED_BY", "c", "o_custkey"))
            .unionByName(e(t("lineitem"), "o", "l_orderkey", "AFFECTS", "p", "l_partkey").distinct()))


CTE["edges"] = """edges AS (
 SELECT 'n' || n_nationkey AS src, 'IN_REGION' AS pred, 'r' || n_regionkey AS dst FROM nation
 UNION ALL SELECT 's' || s_suppkey, 'BASED_IN', 'n' || s_nationkey FROM supplier
 UNION ALL SELECT 'c' || c_custkey, 'BASED_IN', 'n' || c_nationkey FROM customer
 UNION ALL SELECT 'o' || o_orderkey, 'PLACED_BY', 'c' || o_custkey FROM orders
 UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'AFFECTS', 'p' || l_partkey FROM lineitem)"""
CTE["both"] = "both_ways AS (SELECT src, pred, dst FROM edges UNION ALL SELECT dst, pred, src FROM edges)"


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n, p, k, name, label: table(spark, sf, n).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.col(name).cast("string").alias("name"), F.lit(label).alias("label"))
    return (t("region", "r", "r_regionkey", "r_name", "Region").unionByName(t("nation", "n", "n_nationkey", "n_name", "Nation"))
            .unionByName(t("supplier", "s", "s_suppkey", "s_name", "Supplier")).unionByName(t("customer", "c", "c_custkey", "c_name", "Customer"))
            .unionByName(t("orders", "o", "o_orderkey", "o_orderpriority", "Order")).unionByName(t("part", "p", "p_partkey", "p_name", "Part")))


CTE["nodes"] = """nodes AS (
 SELECT 'r' || r_regionkey AS id, r_name AS name, 'Region' AS label FROM region
 UNION ALL SELECT 'n' || n_nationkey, n_name, 'Nation' FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, 'Supplier' FROM supplier
 UNION ALL SELECT 'c' || c_custkey, c_name, 'Customer' FROM customer UNION ALL SELECT 'o' || o_orderkey, o_orderpriority, 'Order' FROM orders
 UNION ALL SELECT 'p' || p_partkey, p_name, 'Part' FROM part)"""


def knowledge(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as concepts; every order line is a decision on its part and a
    contradiction of it (open while the line is open)."""
    p = table(spark, sf, "part")
    concepts = p.select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"),
                        F.col("p_type").alias("domain"), F.array("p_brand").alias("aliases"))
    li = table(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    key = F.concat_ws("_", *[F.col(c).cast("string") for c in keys])
    concept = F.concat(F.lit("part_"), F.col("l_partkey").cast("string"))
    sup = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    # made distinct as numbers, before the texts are made of them
    ruled = li.select(*keys, "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("day")).distinct()
    decisions = ruled.select(F.concat(F.lit("d"), key).alias("id"), concept.alias("concept_id"), F.col("l_returnflag").alias("rule"),
                             sup.alias("source"), F.col("l_linestatus").alias("rationale"), F.date_format("day", "yyyy-MM-dd").alias("effective_date"))
    disputed = li.select(*keys, "l_linestatus").distinct()
    contradictions = disputed.select(
        F.concat_ws("_", F.concat(F.lit("x"), key), "l_linestatus").alias("id"), concept.alias("concept_id"), F.lit("ship").alias("statement_a"), sup.alias("source_a"), F.lit("hold").alias("statement_b"),
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("source_b"), F.when(F.col("l_linestatus") == "O", "UNRESOLVED").otherwise("RESOLVED").alias("status"),
        sup.alias("owner"))
    return concepts, decisions, contradictions


CTE["concepts"] = "concepts AS (SELECT 'part_' || p_partkey AS id, p_name AS name, p_type AS domain, p_brand AS alias FROM part)"
_KEY = "l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey"
CTE["decisions"] = f"""decisions AS (SELECT DISTINCT 'd' || {_KEY} AS id, 'part_' || l_partkey AS concept_id, l_returnflag AS rule, 'S' || l_suppkey AS source,
 l_linestatus AS rationale, strftime(l_shipdate, '%Y-%m-%d') AS effective_date FROM lineitem)"""
CTE["contradictions"] = f"""contradictions AS (SELECT DISTINCT 'x' || {_KEY} || '_' || l_linestatus AS id, 'part_' || l_partkey AS concept_id, 'S' || l_suppkey AS source_a,
 'O' || l_orderkey AS source_b, CASE WHEN l_linestatus = 'O' THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status FROM lineitem)"""


def terms(spark: SparkSession, sf: str) -> DataFrame:
    """Search terms: part types, brands and the first word of part names."""
    p = table(spark, sf, "part")
    return p.select(F.explode_outer(F.array(F.col("p_type"), F.col("p_brand"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_name"))).alias("term")).distinct()


CTE["terms"] = """terms AS (SELECT DISTINCT lower(t) AS term FROM (SELECT p_type AS t FROM part UNION ALL SELECT p_brand FROM part
 UNION ALL SELECT split_part(p_name, ' ', 1) FROM part UNION ALL SELECT p_name FROM part))"""
CTE["matches"] = """matches AS (SELECT t.term, c.id FROM terms t JOIN concepts c
 ON contains(lower(c.id), t.term) OR contains(lower(c.name), t.term) OR contains(lower(c.alias), t.term))"""


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as spans. The parent is the latest earlier user turn."""
    from ..operators.ordering import last_before

    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    up = last_before(c, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "_p")
    sid = lambda t: F.concat(F.lit("s"), F.col("conv_id").cast("string"), F.lit("."), F.col(t).cast("string"))
    start = (F.col("turn") + 1) * 1_000_000_000
    name = F.when(F.col("role") == "assistant", "gen_ai.chat").when(F.col("role") == "user", "execute_tool ask").otherwise("gen_ai.agent_turn")
    return up.select(
        F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("trace_id"), sid("turn").alias("span_id"),
        F.when(F.col("_p").isNotNull(), sid("_p")).otherwise("").alias("parent_span_id"), name.alias("name"), start.alias("start_ns"),
        (start + F.length("text") * 1_000_000).alias("end_ns"), F.when(F.length("text") % 7 == 0, 2).otherwise(0).alias("status"),
        F.create_map(F.lit("session.id"), F.col("conv_id").cast("string"), F.lit("gen_ai.usage.input_tokens"), F.floor(F.length("text") / 4).cast("string"),
                     F.lit("note"), F.col("role")).alias("attributes"), "conv_id", "turn", "role", "text")


CTE["spans"] = """spans AS (
 SELECT 't' || conv_id AS trace_id, 's' || conv_id || '.' || turn AS span_id, CASE WHEN p IS NOT NULL THEN 's' || conv_id || '.' || p ELSE '' END AS parent_span_id,
  CASE role WHEN 'assistant' THEN 'gen_ai.chat' WHEN 'user' THEN 'execute_tool ask' ELSE 'gen_ai.agent_turn' END AS name,
  (turn + 1) * 1000000000 AS start_ns, (turn + 1) * 1000000000 + length(text) * 1000000 AS end_ns,
  CASE WHEN length(text) % 7 = 0 THEN 2 ELSE 0 END AS status, conv_id, turn, role, text, CAST(floor(length(text) / 4) AS BIGINT) AS tokens
 FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM conversations))"""


def run_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as run logs: one run per user and day."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.create_map(*[F.lit(v) for kv in RUN_KINDS.items() for v in kv])
    odd = (F.col("event_type") == "click") & (F.col("event_id") % 3 == 0)
    return e.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("run_id"), F.col("event_id").alias("pos"),
        F.when(odd, "approval_decided").otherwise(F.element_at(kind, F.col("event_type"))).alias("type"),
        F.concat(F.lit("tool"), (F.col("event_id") % 7).cast("string")).alias("tool"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("principal"), "ts", "value", "event_id")


RUN_KINDS = {"signup": "run_started", "view": "approval_requested", "click": "step", "error": "run_failed", "purchase": "run_succeeded"}
CTE["run_events"] = """run_events AS (
 SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS run_id, event_id AS pos,
  CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'approval_decided' ELSE CASE event_type WHEN 'signup' THEN 'run_started' WHEN 'view' THEN 'approval_requested'
   WHEN 'click' THEN 'step' WHEN 'error' THEN 'run_failed' ELSE 'run_succeeded' END END AS type,
  'tool' || (event_id % 7) AS tool, 'u' || user_id AS principal, ts, value, event_id FROM events)"""


def principals(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as principals, with a role per nation and one from their balance."""
    level = F.when(F.col("s_acctbal") < 0, "admin").when(F.col("s_acctbal") < 3000, "approver").when(F.col("s_acctbal") < 8000, "caller").otherwise("guest")
    extra = F.when(F.col("s_suppkey") % 20 == 0, F.array(F.lit("%All"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("principal"),
        F.concat(F.array(F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")), level), extra).alias("roles"))


CTE["principals"] = """principals AS (SELECT 'S' || s_suppkey AS principal, list_concat(['nation' || s_nationkey,
  CASE WHEN s_acctbal < 0 THEN 'admin' WHEN s_acctbal < 3000 THEN 'approver' WHEN s_acctbal < 8000 THEN 'caller' ELSE 'guest' END],
  CASE WHEN s_suppkey % 20 = 0 THEN ['%All'] ELSE CAST([] AS VARCHAR[]) END) AS roles FROM supplier)"""


def bundles(spark: SparkSession, sf: str) -> DataFrame:
    """FHIR bundles: per customer one with Patient and note, per order one with
    Condition and Encounter, as incremental exports deliver them."""
    p = patients(spark, sf)
    o = texts(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    ref = lambda key: F.struct(F.concat(F.lit("Patient/p"), F.col(key).cast("string")).alias("reference"))
    patient = F.to_json(F.struct(F.lit("Patient").alias("resourceType"), F.col("patient_id").alias("id"),
                                 F.when(F.col("c_acctbal") >= 0, "1970-01-01").alias("birthDate"), F.lit("unknown").alias("gender"),
                                 F.when(F.col("c_custkey") % 9 != 0, F.array(F.struct(F.lit("phone").alias("system"), F.lit("1").alias("value")))).alias("telecom")))
    note = F.to_json(F.struct(F.lit("DocumentReference").alias("resourceType"), F.concat(F.lit("doc-"), F.col("patient_id")).alias("id"), F.lit("current").alias("status"),
                              ref("c_custkey").alias("subject"), F.col("notes").alias("description")))
    system = F.when(F.col("o_orderstatus") == "F", "http://snomed.info/sct").when(F.col("o_orderstatus") == "O", "http://hl7.org/fhir/sid/icd-10").otherwise("local")
    cond = F.to_json(F.struct(F.lit("Condition").alias("resourceType"), F.concat(F.lit("cond-"), F.col("o_orderkey").cast("string")).alias("id"), ref("c_custkey").alias("subject"),
                              F.struct(F.col("o_orderstatus").alias("text"), F.array(F.struct(system.alias("system"), F.col("o_orderstatus").alias("code"))).alias("coding")).alias("code")))
    enc = F.to_json(F.struct(F.lit("Encounter").alias("resourceType"), F.concat(F.lit("enc-"), F.col("o_orderkey").cast("string")).alias("id"), ref("c_custkey").alias("subject"),
                             F.struct(F.col("d").alias("start")).alias("period")))
    wrap = lambda a, b: F.concat(F.lit('{"resourceType":"Bundle","entry":[{"resource":'), a, F.lit('},{"resource":'), b, F.lit("}]}"))
    base = p.select("patient_id", wrap(patient, note).alias("bundle"))
    # of every other order the encounter comes first, so the place in the bundle differs
    odd = F.col("o_orderkey") % 2 == 1
    extra = o.select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("patient_id"), F.when(odd, wrap(enc, cond)).otherwise(wrap(cond, enc)).alias("bundle"))
    return base.unionByName(extra)
