"""Queries over sources and sinks."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import functions as F

from ..operators import tickets as T
from ..operators.ordering import first_rows
from ..session import shared_folder
from ..sources import fhir, notes, otlp, store, tables
from . import views as V
from .registry import query
from .views import CTE, with_views


def scratch(spark, name):
    """A fresh folder below the shared one, for queries that write and read back."""
    return f"{shared_folder(spark)}/caseloom-{name}-{uuid.uuid4().hex[:12]}"


def ticket_export(spark, sf):
    """Tickets as the JSON text an export holds; the flag in three spellings."""
    t = V.tickets(spark, sf, heavy=True)
    flag = F.when(~F.col("has_solution"), F.lit("0")).when(F.col("doc_id") % 2 == 0, "1").otherwise("True")
    return t.select(F.to_json(F.struct("ticket_id", F.col("category").alias("Classification"), F.col("hospital").alias("Hospital"),
                                       F.col("summary").alias("Summary"), F.col("problem").alias("Problem"), F.col("solution").alias("Solution"),
                                       F.col("status").alias("Status"), flag.alias("has_solution"))).alias("json"))


@query("s01_read_tickets", with_views("""SELECT ticket_id, category, hospital, summary, problem, solution,
 status, has_solution, summary || ' ' || problem AS full_content FROM tickets""", "tickets"))
def _(spark, sf):
    return tables.tickets_from_json(ticket_export(spark, sf), "json")


@query("s02_load_if_absent", with_views("""SELECT 'unseen keys' AS target, ticket_id, category FROM (SELECT DISTINCT ticket_id, category FROM tickets WHERE NOT has_solution)
 UNION ALL SELECT 'empty', ticket_id, category FROM (SELECT DISTINCT ticket_id, category FROM tickets)""", "tickets"))
def _(spark, sf):
    """A filled target takes nothing, or its unseen keys if asked; an empty one takes all."""
    t = V.tickets(spark, sf).select("ticket_id", "category", "has_solution")
    solved, twice = t.filter("has_solution"), t.unionByName(t)
    cases = [("filled", solved, True), ("unseen keys", solved, False), ("empty", t.limit(0), True)]
    out = [tables.load_if_absent(twice, target, "ticket_id", skip).select(F.lit(name).alias("target"), "ticket_id", "category") for name, target, skip in cases]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("s03_unpack_multivalue", with_views("""SELECT patient_id, length(conditions) - length(replace(conditions, '|', '')) + 1 AS n, replace(conditions, '|', ';') AS items
 FROM patients""", "patients"))
def _(spark, sf):
    from ..functions.columns import unpack

    p = V.patients(spark, sf).withColumn("packed", F.concat("conditions", F.lit("||after the gap")))
    return p.select("patient_id", F.size(unpack("packed")).alias("n"), F.array_join(unpack("packed"), ";").alias("items"))


@query("s04_flatten_bundles", with_views("""SELECT 'Condition' AS kind, o_orderkey % 2 AS pos, 'cond-' || o_orderkey AS id, 'p' || o_custkey AS patient, o_orderstatus AS text,
 CASE o_orderstatus WHEN 'F' THEN 'http://snomed.info/sct' WHEN 'O' THEN 'http://hl7.org/fhir/sid/icd-10' ELSE 'local' END AS detail FROM orders
 UNION ALL SELECT 'Encounter', 1 - o_orderkey % 2, 'enc-' || o_orderkey, 'p' || o_custkey, NULL, strftime(o_orderdate, '%Y-%m-%d') FROM orders
 UNION ALL SELECT 'Patient', 0, patient_id, NULL, 'unknown', CASE WHEN c_acctbal >= 0 THEN '1970-01-01' END FROM patients
 UNION ALL SELECT 'DocumentReference', 1, 'doc-' || patient_id, patient_id, notes, 'current' FROM patients""", "patients"))
def _(spark, sf):
    """All typed tables, from one scan of the bundles."""
    kind = F.col("resource_type")
    id_ = F.coalesce(*[F.col(f"{k}.id") for k in fhir.RESOURCES])
    patient = F.coalesce(*[fhir.subject_id(f"{k}.") for k in fhir.RESOURCES if k != "Patient"])
    text = F.coalesce("Condition.code.text", "Patient.gender", "DocumentReference.description", "Observation.code.text")
    detail = F.coalesce(F.get("Condition.code.coding", F.lit(0))["system"], "Encounter.period.start", "Patient.birthDate", "DocumentReference.status")
    return fhir.typed_entries(V.bundles(spark, sf), "bundle").select(kind.alias("kind"), F.col("pos").cast("long").alias("pos"), id_.alias("id"), patient.alias("patient"), text.alias("text"), detail.alias("detail"))


@query("s05_transaction_bundles", """SELECT 'p' || c_custkey AS patient_id, 'transaction' AS type, 'PUT' AS method, 'Patient/p' || c_custkey AS url, true AS ok FROM customer
 UNION ALL SELECT 'p' || c_custkey, 'transaction', 'PUT', 'DocumentReference/doc-p' || c_custkey, true FROM customer
 UNION ALL SELECT 'p' || o_custkey, 'transaction', 'PUT', 'Condition/cond-' || o_orderkey, true FROM orders
 UNION ALL SELECT 'p' || o_custkey, 'transaction', 'PUT', 'Encounter/enc-' || o_orderkey, true FROM orders""")
def _(spark, sf):
    b = fhir.to_transaction_bundles(V.bundles(spark, sf), "bundle", "patient_id")
    made = b.select("patient_id", "ok", F.from_json("bundle_json", "struct<type:string,entry:array<struct<request:struct<method:string,url:string>>>>").alias("b"))
    both = F.explode_outer(F.array(*[F.get("b.entry", F.lit(i))["request"] for i in (0, 1)]))
    return made.select("patient_id", F.col("b.type").alias("type"), both.alias("r"), "ok").select("patient_id", "type", "r.*", "ok")


def wiki_files(spark, sf):
    d = V.texts(spark, sf)
    text = F.concat(F.lit("# Page "), F.col("source"), F.lit("\n\n"), F.when(F.col("doc_id") % 2 == 0, "_Last updated: ").otherwise("*Last updated: "),
                    F.col("lang"), F.lit("\n"), F.col("text"), F.when(F.col("doc_id") % 5 == 0, "\n## Knowledge Gaps\n").otherwise(""))
    name = F.when(F.col("doc_id") == 3, "README.md").otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")))
    return d.select(name.alias("file"), text.alias("text"))


@query("s06_read_wiki", """SELECT 'd' || doc_id || '.md' AS file, 'Page ' || source AS title, CASE WHEN doc_id % 2 = 0 THEN '_' ELSE '*' END || 'Last updated: ' || lang AS last_updated,
 doc_id % 5 = 0 OR contains(text, 'Knowledge Gap') OR contains(lower(text), 'undocumented') AS has_gaps FROM documents WHERE doc_id <> 3""")
def _(spark, sf):
    return notes.shape_wiki(wiki_files(spark, sf)).drop("text")


@query("s07_read_notes", """SELECT 'doc' || doc_id AS id, 'Note' AS type, source || ': ' || lang AS source, text AS body FROM documents""")
def _(spark, sf):
    d = V.texts(spark, sf)
    text = F.concat(F.lit("---\nid: first\nid: doc"), F.col("doc_id").cast("string"), F.lit("\ntype: Note\nsource: "), F.col("source"), F.lit(": "), F.col("lang"), F.lit("\n---\n"), F.col("text"))
    n = notes.shape_notes(d.select(F.lit("f").alias("file"), text.alias("text")))
    return n.select("id", "type", F.try_element_at("frontmatter", F.lit("source")).alias("source"), "body")


@query("s08_export_notes", with_views("""SELECT 'concept' AS kind, id, domain AS status, 6 AS n_keys FROM concepts
 UNION ALL SELECT 'decision', id, source, 5 FROM decisions
 UNION ALL SELECT 'contradiction', id, CASE WHEN status = 'UNRESOLVED' THEN 'DEFERRED' ELSE status END, CASE WHEN status = 'UNRESOLVED' THEN 8 ELSE 7 END FROM contradictions""",
       "concepts", "decisions", "contradictions"))
def _(spark, sf):
    c, d, x = V.knowledge(spark, sf)
    human = c.select("id", F.create_map(F.lit("reviewer"), F.lit("me")).alias("frontmatter")).unionByName(
        x.filter("status = 'UNRESOLVED'").select("id", F.create_map(F.lit("status"), F.lit("DEFERRED"), F.lit("reviewer"), F.lit("me")).alias("frontmatter")))
    n = notes.export_notes(c, d, x, human)
    at = lambda k: F.try_element_at("frontmatter", F.lit(k))
    return n.select("kind", "id", F.when(F.col("kind") == "concept", at("domain")).when(F.col("kind") == "decision", at("source")).otherwise(at("status")).alias("status"),
                    F.size("frontmatter").alias("n_keys"))


@query("s09_publish_article", with_views("""SELECT lower(replace(category, ' ', '_')) AS slug, 'KB-PC-' || upper(replace(category, ' ', '_')) AS article_id,
 CASE WHEN min(doc_id) % 2 = 0 THEN 'augmented' ELSE 'created' END AS action, CASE WHEN min(doc_id) % 2 = 0 THEN true ELSE false END AS gap_filled,
 count(*) || ' support tickets' AS counted, array_to_string(list_sort(list(ticket_id))[1:8], ', ') || CASE WHEN count(*) > 8 THEN '...' ELSE '' END AS sources
 FROM tickets WHERE has_solution GROUP BY category""", "tickets"))
def _(spark, sf):
    part = lambda pattern: F.regexp_extract("text", pattern, 1)
    return published(V.tickets(spark, sf)).select("slug", "article_id", "action", F.col("text").contains("Partially addressed").alias("gap_filled"),
                                                  part(r"\*\*Source:\*\* (\d+ support tickets)").alias("counted"), part(r"\*\*Source tickets:\*\* ([^\n]*)").alias("sources"))


@query("s09_article_sources", with_views("SELECT 'KB-PC-' || upper(replace(category, ' ', '_')) AS article_id, ticket_id FROM tickets WHERE has_solution", "tickets"))
def _(spark, sf):
    return notes.article_sources(V.tickets(spark, sf))


def published(t):
    """Pages of all categories; each article counts the solved tickets of its category and lists the first eight."""
    context = T.article_context(t)
    solved = t.filter("has_solution")
    counts = solved.groupBy("category").agg(F.count(F.lit(1)).alias("ticket_total"))
    shown = first_rows(solved.select("category", "ticket_id"), ["category"], ["ticket_id"], 8).groupBy("category").agg(F.sort_array(F.collect_list("ticket_id")).alias("source_tickets"))
    articles = context.join(shown, "category").join(counts, "category").select("category", F.col("context").alias("article_text"), "source_tickets", "ticket_total")
    first = t.filter("has_solution").groupBy("category").agg(F.min("doc_id").alias("m"))
    pages = first.filter("m % 2 = 0").select(T.slug_of(F.col("category")).alias("slug"),
                                            F.lit("# Old\n_These gaps will be filled automatically by the KB Mining pipeline._").alias("text"))
    return notes.publish_article(pages, articles, F.lit(V.AS_OF).cast("timestamp"))


@query("s10_read_kb_stubs", "SELECT 'd' || doc_id AS id, source AS title, lang AS category, text AS content FROM documents")
def _(spark, sf):
    d = V.texts(spark, sf)
    path = scratch(spark, "stubs")
    d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("title"), F.col("lang").alias("category"), F.col("text").alias("content")).write.json(path)
    return tables.read_kb_stubs(spark, path, lines=True).select("id", "title", "category", "content")


@query("s11_spans_from_otlp", with_views("""SELECT trace_id, span_id, parent_span_id, name, start_ns, end_ns, status, CAST(tokens AS VARCHAR) AS tokens, (end_ns - start_ns) / 1000000 AS duration_ms
 FROM spans""", "spans"))
def _(spark, sf):
    s = otlp.spans_from_otlp(otlp.otlp_from_spans(V.spans(spark, sf)), "payload")
    return s.select("trace_id", "span_id", "parent_span_id", "name", "start_ns", "end_ns", "status",
                    F.try_element_at("attributes", F.lit("gen_ai.usage.input_tokens")).alias("tokens"), "duration_ms")


@query("s12_otlp_from_spans", with_views("""SELECT trace_id, span_id, CASE WHEN parent_span_id <> '' THEN parent_span_id END AS parent, CAST(start_ns AS VARCHAR) AS start_ns,
 'caseloom' AS service FROM spans""", "spans"))
def _(spark, sf):
    p = otlp.otlp_from_spans(V.spans(spark, sf))
    at = lambda x: F.get_json_object("payload", "$.resourceSpans[0]." + x)
    return p.select("trace_id", at("scopeSpans[0].spans[0].spanId").alias("span_id"), at("scopeSpans[0].spans[0].parentSpanId").alias("parent"),
                    at("scopeSpans[0].spans[0].startTimeUnixNano").alias("start_ns"), at("resource.attributes[0].value.stringValue").alias("service"))


@query("s13_read_metric_samples", """SELECT event_type AS metric, epoch_ms(date_trunc('second', ts)) AS ts_ms, value FROM events
 WHERE event_id % 13 <> 0 AND date_trunc('second', ts) >= TIMESTAMP '2024-01-21 00:00:00'""")
def _(spark, sf):
    e = V.table(spark, sf, "events")
    key = F.when(F.col("event_id") % 13 == 0, "not a time").otherwise(F.concat(F.date_format("ts", "yyyyMMddHHmmss"), F.lit("017")))
    s = tables.read_metric_samples(e.select(F.col("event_type").alias("metric"), key.alias("key"), F.col("value").cast("string").alias("value")),
                                   F.lit(V.AS_OF).cast("timestamp"), 14400)
    return s.select("metric", F.unix_millis("ts").alias("ts_ms"), "value")


@query("s14_message_headers", with_views("SELECT id, source, target, body_class, epoch_us(created) // 1000 AS created_ms, epoch_us(processed) // 1000 AS processed_ms, status FROM headers", "headers"))
def _(spark, sf):
    path = scratch(spark, "headers")
    V.headers(spark, sf).write.parquet(path)
    h = tables.message_headers(spark, path)
    return h.select("id", "source", "target", "body_class", F.unix_millis("created").alias("created_ms"), F.unix_millis("processed").alias("processed_ms"), "status")


@query("s15_read_golden_cases", with_views("""SELECT 'case-' || patient_id AS case_id, patient_id, c_custkey % 4 = 3 AS adversarial, economic, priority, 2 AS n_tools
 FROM scored""", "patients", "scored"))
def _(spark, sf):
    from ..operators.scoring import score_domains

    p = score_domains(V.patients(spark, sf), "notes", V.SYLLABLE_RULES)
    dom = F.struct(*[F.col(r[0]) for r in V.SYLLABLE_RULES])
    exp = F.struct(dom.alias("domains"), "priority")
    case = F.struct(F.concat(F.lit("case-"), F.col("patient_id")).alias("id"), F.col("patient_id").alias("patientId"), (F.col("c_custkey") % 4 == 3).alias("adversarial"),
                    F.array(F.lit("SearchPatients"), F.lit("AssessSDoHRisk")).alias("expected_trajectory"), exp.alias("rule_expected"), exp.alias("human_label"))
    c = tables.cases_from_json(p.select(F.to_json(F.struct(F.array(case).alias("cases"))).alias("j")), "j")
    return c.select("case_id", "patient_id", "adversarial", F.col("rule_domains")["economic"].alias("economic"), F.col("human_priority").alias("priority"),
                    F.size("expected_trajectory").alias("n_tools"))


@query("s16_append_triples", with_views("""SELECT 'kb_article:KB-PC-' || category AS a, k AS p, CASE k WHEN 'article_id' THEN 'KB-PC-' || category WHEN 'category' THEN category ELSE '2024-01-31' END AS b
 FROM (SELECT DISTINCT category FROM tickets), (VALUES ('article_id'), ('category'), ('generated_at')) v(k)
 UNION ALL SELECT 'agent:kb.writer', 'AUTHORED_KB', 'kb_article:KB-PC-' || category FROM (SELECT DISTINCT category FROM tickets)
 UNION ALL SELECT 'pc_ticket:' || ticket_id, 'SOURCED_KB', 'kb_article:KB-PC-' || category FROM tickets""", "tickets"))
def _(spark, sf):
    t = V.tickets(spark, sf).withColumn("article_id", F.concat(F.lit("KB-PC-"), F.col("category")))
    arts = t.select("article_id", "category", F.lit("2024-01-31").alias("generated_at")).distinct()
    props, edges = tables.append_triples(arts, sources=t.select("article_id", "ticket_id"))
    return props.select(F.col("id").alias("a"), F.col("key").alias("p"), F.col("val").alias("b")).unionByName(
        edges.select(F.col("src").alias("a"), F.col("pred").alias("p"), F.col("dst").alias("b")))


def recorded(spark, sf):
    """Every line item as a recorded decision about its part."""
    li = V.table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("concept"), F.concat(F.lit("D"), F.col("l_quantity").cast("long").cast("string")).alias("domain"),
                    F.col("l_returnflag").alias("rule"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"), F.lit("why").alias("rationale"),
                    F.date_format("l_shipdate", "yyyy").alias("effective_date"), F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")]).alias("seq"))


@query("s17_merge_versions", """WITH upd AS (SELECT 'part_' || l_partkey AS concept_id, 'decision_part_' || l_partkey || '_' || strftime(l_shipdate, '%Y') AS id, 1 + l_orderkey % 2 AS v FROM lineitem),
 n AS (SELECT version, 'concepts' AS name, count(DISTINCT concept_id) AS n FROM upd, (VALUES (1), (2)) x(version) WHERE v <= version GROUP BY 1
 UNION ALL SELECT version, 'decisions', count(DISTINCT id) FROM upd, (VALUES (1), (2)) x(version) WHERE v <= version GROUP BY 1
 UNION ALL SELECT version, 'edges', count(DISTINCT (id, concept_id)) FROM upd, (VALUES (1), (2)) x(version) WHERE v <= version GROUP BY 1)
SELECT * FROM n""")
def _(spark, sf):
    """Two merges into one store, and what each version holds."""
    upd = recorded(spark, sf).withColumn("v", F.split_part("seq", F.lit("/"), F.lit(1)).cast("long") % 2)
    held = store.Store(spark, scratch(spark, "graph-store"))
    for half in (0, 1):
        store.merge_into(held, upd.filter(F.col("v") == half).drop("v"))
    parts = [held.read(n, v).agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("version"), F.lit(n).alias("name"), "n") for v in (1, 2) for n in ("concepts", "decisions", "edges")]
    return functools.reduce(lambda x, y: x.unionByName(y), parts)


@query("s17_merge_graph", with_views("""SELECT 'concept' AS kind, coalesce(c.id, n.id) AS id, coalesce(n.domain, c.domain) AS detail FROM concepts c FULL OUTER JOIN
  (SELECT concept_id AS id, arg_max(domain, seq) AS domain FROM upd GROUP BY 1) n ON c.id = n.id
 UNION ALL SELECT 'decision', id, rule FROM decisions
 UNION ALL SELECT 'decision', id, arg_min(rule, seq) FROM upd GROUP BY id
 UNION ALL SELECT 'conflict', id, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS r FROM upd) WHERE r > 1
 UNION ALL SELECT 'edge', id, concept_id FROM (SELECT DISTINCT id, concept_id FROM upd)""", "concepts", "decisions").replace("\nSELECT 'concept'", """,
 upd AS (SELECT 'part_' || l_partkey AS concept_id, 'decision_part_' || l_partkey || '_' || strftime(l_shipdate, '%Y') AS id, 'D' || l_quantity::BIGINT AS domain,
  l_returnflag AS rule, 'S' || l_suppkey AS source, l_orderkey::VARCHAR || '/' || l_linenumber || '/' || l_suppkey || '/' || l_partkey || '/' || l_quantity || '/' || l_extendedprice AS seq FROM lineitem)
SELECT 'concept'""", 1))
def _(spark, sf):
    c, d, _x = V.knowledge(spark, sf)
    upd = recorded(spark, sf)
    no_edges = spark.createDataFrame([], "src string, pred string, dst string")
    concepts, decisions, edges, conflicts = tables.merge_graph(c, d, no_edges, upd)
    row = lambda df, kind, detail, key="id": df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(detail).alias("detail"))
    return (row(concepts, "concept", "domain").unionByName(row(decisions, "decision", "rule")).unionByName(row(conflicts, "conflict", "source"))
            .unionByName(row(edges, "edge", "dst", "src")))


@query("s18_care_plan_resources", """SELECT 'p' || o_custkey AS patient_id, 'Patient/p' || o_custkey AS subject, '2024-01-31' AS start, '734163000' AS code,
 'SDoH follow-up care plan.' || chr(10) || 'CHW assigned: W' || (o_orderkey % 7) || chr(10) || 'SDoH flags: ' || o_orderstatus || chr(10) || 'Priority: ' || lower(substring(o_orderpriority, 3)) AS note FROM orders""")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("patient_id"),
        F.concat(F.lit("W"), (F.col("o_orderkey") % 7).cast("string")).alias("worker_id"), F.col("o_orderstatus").alias("sdoh_flags"),
        F.lower(F.substring("o_orderpriority", 3, 100)).alias("priority"), F.lit(None).cast("string").alias("requested_by"))
    c = tables.care_plan_resources(o, F.lit(V.AS_OF).cast("timestamp"))
    at = lambda p: F.get_json_object("resource_json", p)
    return c.select("patient_id", at("$.subject.reference").alias("subject"), at("$.period.start").alias("start"), at("$.category[0].coding[0].code").alias("code"), at("$.note[0].text").alias("note"))


@query("s19_vectors_from_csv", with_views("SELECT id, array_to_string(list_transform(vec, lambda x: CAST(round(x * 1000000) AS BIGINT)), ',') AS entries FROM vectors", "vectors"))
def _(spark, sf):
    v = V.vectors(spark, sf)
    parsed = tables.vectors_from_csv(tables.vectors_to_csv(v), "csv", 64)
    return parsed.select("id", F.array_join(F.transform("vec", lambda x: F.round(x * 1000000).cast("long").cast("string")), ",").alias("entries"))


@query("s20_patient_nodes", with_views("""SELECT 'patient-' || patient_id AS node_id, string_agg(line, chr(10) ORDER BY pos, kind, line) AS summary FROM (
   SELECT patient_id, 1 AS pos, 'DocumentReference' AS kind, 'Note: ' || coalesce(notes, '') AS line FROM patients
   UNION ALL SELECT 'p' || o_custkey, o_orderkey % 2, 'Condition', 'Condition: ' || o_orderstatus FROM orders) GROUP BY patient_id""", "patients"))
def _(spark, sf):
    return fhir.patient_nodes(V.bundles(spark, sf), "bundle", F.lit(V.AS_OF)).select("node_id", "summary")
