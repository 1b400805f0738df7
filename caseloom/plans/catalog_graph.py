"""Queries over the knowledge layer, graphs, vectors and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, density, documents, graph, knowledge, patterns, projections, vectors
from ..operators.ordering import first_rows
from ..sources import tables
from . import views as V
from .registry import query
from .views import with_views

# --- knowledge layer --------------------------------------------------------------------


@query("j03_knowledge_context", with_views("""SELECT t.term, concept_id, decision_id, source, concept_id IS NOT NULL AS found FROM terms t LEFT JOIN (
 SELECT term, m.id AS concept_id, d.id AS decision_id, d.source FROM matches m LEFT JOIN decisions d ON d.concept_id = m.id) x
 ON t.term = x.term""", "concepts", "decisions", "terms", "matches"))
def _(spark, sf):
    c, d, _x = V.knowledge(spark, sf)
    k = knowledge.knowledge_context(V.terms(spark, sf), c, d)
    return k.select("term", "concept_id", "decision_id", "source", "found")


GATE = """gate AS (SELECT t.term, coalesce(n, 0) AS n, listed FROM terms t LEFT JOIN (SELECT term, count(*) AS n, string_agg(id, ',' ORDER BY id) FILTER (r <= 20) AS listed FROM (
  SELECT term, x.id, row_number() OVER (PARTITION BY term ORDER BY x.id) AS r FROM matches m JOIN contradictions x ON x.concept_id = m.id AND x.status = 'UNRESOLVED') GROUP BY term) g ON g.term = t.term)"""
GATED = with_views("", "concepts", "contradictions", "terms", "matches").rstrip() + ",\n" + GATE


@query("j04_contradiction_gate", GATED + """ SELECT term, n > 0 AS blocked, n AS unresolved_count, listed, greatest(n - 20, 0) AS n_more, CASE WHEN n > 0 THEN 'BLOCKED: ' || n || ' unresolved guideline contradiction(s) found for ''' || term || '''.'
 ELSE 'NO_CONTRADICTIONS: Safe to cite protocols for ''' || term || '''.' END AS message FROM gate""")
def _(spark, sf):
    c, _d, x = V.knowledge(spark, sf)
    g = knowledge.contradiction_gate(V.terms(spark, sf), c, x)
    return g.select("term", "blocked", "unresolved_count", F.array_join(F.transform("detail", lambda r: r["ct_id"]), ",").alias("listed"), "n_more", "message")


@query("j05_gate_recommendations", GATED + """ SELECT p_partkey AS rec_id, lower(p_name) AS concept, coalesce(n, 0) = 0 AS allowed,
 CASE WHEN coalesce(n, 0) > 0 THEN 'BLOCKED: ' || n || ' unresolved guideline contradiction(s) found for ''' || term || '''.' ELSE '' END AS reason FROM part LEFT JOIN gate ON term = lower(p_name)""")
def _(spark, sf):
    c, _d, x = V.knowledge(spark, sf)
    recs = V.table(spark, sf, "part").select(F.col("p_partkey").alias("rec_id"), F.col("p_name").alias("concept"))
    return knowledge.gate_recommendations(recs, knowledge.contradiction_gate(V.terms(spark, sf), c, x))


@query("j06_related_evidence", with_views("""SELECT term, concept, relationship, related, coalesce(nullif(name, ''), related) AS name FROM (
  SELECT DISTINCT t.term, n.id AS concept, e.pred AS relationship, e.dst AS related FROM (SELECT DISTINCT term FROM terms UNION SELECT lower(n_name) FROM nation) t
  JOIN nodes n ON contains(lower(n.name), t.term) OR contains(lower(n.id), replace(t.term, ' ', '_')) JOIN both_ways e ON e.src = n.id) x
 LEFT JOIN nodes m ON m.id = x.related""", "terms", "nodes", "edges", "both"))
def _(spark, sf):
    asked = V.terms(spark, sf).unionByName(V.table(spark, sf, "nation").select(F.col("n_name").alias("term")))
    return knowledge.related_evidence(asked, V.nodes(spark, sf), V.edges(spark, sf)).drop("n_more")


@query("j07_contradiction_subgraph", with_views("SELECT x.id AS contradiction_id, x.concept_id, d.id AS decision_id FROM contradictions x JOIN concepts c ON c.id = x.concept_id JOIN decisions d ON d.concept_id = c.id",
                                                "concepts", "decisions", "contradictions"))
def _(spark, sf):
    c, d, x = V.knowledge(spark, sf)
    return knowledge.contradiction_subgraph(x, c, d)


@query("j08_provenance_trail", with_views("""SELECT 'agent:kb.writer' AS agent, 'KB-PC-' || category AS article_id, category, '2024-01-31' AS generated_at, 'pc_ticket:' || ticket_id AS ticket FROM tickets""", "tickets"))
def _(spark, sf):
    t = V.tickets(spark, sf).withColumn("article_id", F.concat(F.lit("KB-PC-"), F.col("category")))
    arts = t.select("article_id", "category", F.lit("2024-01-31").alias("generated_at")).distinct()
    props, edges = tables.append_triples(arts, sources=t.select("article_id", "ticket_id"))
    return knowledge.provenance_trail(edges, props)


_TO = "CASE l_linenumber % 4 WHEN 0 THEN status WHEN 1 THEN 'RESOLVED' WHEN 2 THEN 'DEFERRED' ELSE 'BROKEN' END"


@query("j09_note_graph_diff", f"""WITH g AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT) AS id, l_linenumber, l_suppkey,
  CASE l_returnflag WHEN 'A' THEN 'UNRESOLVED' WHEN 'N' THEN 'DEFERRED' ELSE 'RESOLVED' END AS status FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag FROM lineitem)),
 n AS (SELECT id, status AS old, {_TO} AS new, CASE WHEN l_suppkey % 3 = 0 THEN 'dec' || l_suppkey ELSE '' END AS who FROM g),
 d AS (SELECT *, new <> old AND (old, new) NOT IN (('UNRESOLVED', 'RESOLVED'), ('UNRESOLVED', 'DEFERRED'), ('DEFERRED', 'RESOLVED')) AS bad FROM n WHERE new <> old OR who <> '')
 SELECT id, CASE WHEN bad THEN 'REJECTED' ELSE 'UPDATE' END AS action, CASE WHEN NOT bad THEN new END AS new_status, CASE WHEN NOT bad THEN who END AS new_resolved_by,
  CASE WHEN bad THEN 'Invalid transition ' || old || ' → ' || new END AS reason FROM d""")
def _(spark, sf):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = V.table(spark, sf, "lineitem").select(*key, "l_quantity", "l_returnflag").distinct()
    status = F.when(F.col("l_returnflag") == "A", "UNRESOLVED").when(F.col("l_returnflag") == "N", "DEFERRED").otherwise("RESOLVED")
    rows = li.select(F.concat_ws("-", *[F.col(k).cast("string") for k in key], F.col("l_quantity").cast("long").cast("string")).alias("id"), status.alias("status"), "l_linenumber", "l_suppkey")
    m = F.col("l_linenumber") % 4
    to = F.when(m == 0, F.col("status")).when(m == 1, "RESOLVED").when(m == 2, "DEFERRED").otherwise("BROKEN")
    notes = rows.select("id", to.alias("status"), F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("dec"), F.col("l_suppkey").cast("string"))).otherwise("").alias("resolved_by"),
                        F.lit("").alias("resolution_rationale"))
    g = rows.select("id", "status", F.lit(None).cast("string").alias("resolved_by"), F.lit("").alias("resolution_rationale"))
    return knowledge.note_graph_diff(notes, g).select("id", "action", "new_status", "new_resolved_by", "reason")


# --- access ------------------------------------------------------------------------------


@query("j11_entitlements", with_views("""SELECT r.principal, r.tool, (need = '' OR list_contains(roles, '%All') OR list_contains(roles, need)) AND r.tool NOT IN ('T5', 'T6') AS can_list,
 (need = '' OR list_contains(roles, '%All') OR list_contains(roles, need)) AND r.tool NOT IN ('T5', 'T6') AS can_execute,
 CASE WHEN r.tool IN ('T5', 'T6') THEN 'denied' WHEN NOT (need = '' OR list_contains(roles, '%All') OR list_contains(roles, need)) THEN 'role required: ' || need ELSE '' END AS reason
 FROM (SELECT DISTINCT 'S' || l_suppkey AS principal, 'T' || l_partkey AS tool FROM lineitem) r JOIN principals p ON p.principal = r.principal
 JOIN (SELECT 'T' || p_partkey AS tool, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'nation' || (p_partkey % 25) END AS need FROM part) t ON t.tool = r.tool""", "principals"))
def _(spark, sf):
    req = V.table(spark, sf, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("principal"), F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("tool")).distinct()
    tools = V.table(spark, sf, "part").select(F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("tool"),
                                              F.when(F.col("p_partkey") % 6 == 0, "").otherwise(F.concat(F.lit("nation"), (F.col("p_partkey") % 25).cast("string"))).alias("required_role"))
    return access.entitlements(req, V.principals(spark, sf), tools, deny=["T5", "T6"])


@query("j12_roles_from_scopes", """SELECT 'c' || c_custkey AS subject, role FROM customer, (VALUES ('SampleReader'), ('SampleWriter'), ('SampleAdmin')) r(role)
 WHERE (role = 'SampleReader' AND c_custkey % 2 = 0) OR (role = 'SampleWriter' AND c_custkey % 3 = 0) OR (role = 'SampleAdmin' AND c_custkey % 5 = 0)""")
def _(spark, sf):
    k = F.col("c_custkey")
    scope = F.concat_ws(" ", F.when(k % 2 == 0, "mcp.read"), F.when(k % 3 == 0, "mcp.write"), F.when(k % 5 == 0, "mcp.admin"), F.lit("mcp.read.denied no.mcp.admin"))
    claims = V.table(spark, sf, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("subject"), scope.alias("scope"))
    return access.roles_from_scopes(claims)


_HAS = lambda *r: "(" + " OR ".join(f"list_contains(roles, '{x}')" for x in r) + ")"
_ANY, _UP = _HAS("caller", "approver", "admin"), _HAS("approver", "admin")


@query("j13_action_permissions", with_views(f"""SELECT principal, action, CASE WHEN action IN ('approve', 'invoke_write_tools') THEN {_UP} ELSE {_ANY} END AS allowed FROM principals,
 (VALUES ('list'), ('run_agents'), ('invoke_read_tools'), ('invoke_write_tools'), ('approve')) a(action)""", "principals"))
def _(spark, sf):
    return access.action_permissions(V.principals(spark, sf))


# --- graph -----------------------------------------------------------------------------


@query("g01_graph_walk", with_views("""SELECT src AS start, src, pred, dst, 1 AS depth, src || '>' || dst AS path FROM edges
 UNION ALL SELECT a.src, b.src, b.pred, b.dst, 2, min(a.src || '>' || a.dst || '>' || b.dst) FROM edges a JOIN edges b ON a.dst = b.src GROUP BY a.src, b.src, b.pred, b.dst""", "edges"))
def _(spark, sf):
    starts = V.nodes(spark, sf).select(F.col("id").alias("start"))
    return graph.graph_walk(V.edges(spark, sf), starts, 2)


@query("g02_expand_neighborhood", with_views("""SELECT DISTINCT src, pred, dst, 1 AS depth FROM both_ways WHERE src[1] = 's'
 UNION ALL SELECT DISTINCT src, pred, dst, 2 FROM both_ways WHERE src IN (SELECT dst FROM both_ways WHERE src[1] = 's') AND src[1] <> 's'""", "edges", "both"))
def _(spark, sf):
    n = V.nodes(spark, sf).filter("label = 'Supplier'").select(F.col("id").alias("node"))
    return graph.expand_neighborhood(V.edges(spark, sf), n, 2)


@query("g03_patient_neighborhood", with_views("""SELECT patient_id, source, rel, target, coalesce(name, target) AS name FROM (
  SELECT 's' || s_suppkey AS patient_id, h.* FROM supplier JOIN (
   SELECT DISTINCT source, rel, target FROM (SELECT src AS source, pred AS rel, dst AS target FROM both_ways WHERE src[1] = 'n'
    UNION ALL SELECT a.src, a.pred, b.dst FROM both_ways a JOIN both_ways b ON a.dst = b.src WHERE a.src[1] = 'n') WHERE source <> target) h ON h.source = 'n' || s_nationkey) x
 LEFT JOIN nodes ON nodes.id = target""", "edges", "both", "nodes"))
def _(spark, sf):
    anchors = V.table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("patient_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("node"))
    return graph.patient_neighborhood(anchors, V.edges(spark, sf), V.nodes(spark, sf), 2)


def pagerank_sql(links: str, seeds: str, iters: int, k: int, alpha: float = 0.85) -> str:
    """Power iteration written out as a chain of table expressions."""
    parts = [f"links AS (SELECT src, dst, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY src) AS w FROM ({links}) GROUP BY src, dst)",
             f"seeds AS (SELECT DISTINCT seed_set, node FROM ({seeds}))",
             "r0 AS (SELECT seed_set, node, 1.0::DOUBLE / count(*) OVER (PARTITION BY seed_set) AS score FROM seeds)"]
    for i in range(1, iters + 1):
        parts.append(f"r{i} AS MATERIALIZED (SELECT seed_set, node, sum(score) AS score FROM (SELECT r.seed_set, l.dst AS node, r.score * l.w * {alpha}::DOUBLE AS score FROM r{i - 1} r JOIN links l ON l.src = r.node "
                     f"UNION ALL SELECT seed_set, node, score * (1 - {alpha}::DOUBLE) FROM r0) GROUP BY 1, 2)")
    parts.append(f"norm AS (SELECT seed_set, node, score / sum(score) OVER (PARTITION BY seed_set) AS score FROM r{iters})")
    parts.append(f"top AS (SELECT *, row_number() OVER (PARTITION BY seed_set ORDER BY round(score, 9) DESC, node) AS rank FROM norm QUALIFY rank <= {k})")
    return ", ".join(parts)


@query("g04_personalized_pagerank", with_views("", "edges", "both").rstrip() + ", " + pagerank_sql(
    "SELECT src, dst FROM both_ways", "SELECT 'r' || n_regionkey AS seed_set, 'n' || n_nationkey AS node FROM nation", 20, 20) +
       " SELECT seed_set, node, round(score, 7) AS score, rank FROM top")
def _(spark, sf):
    seeds = V.table(spark, sf, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("seed_set"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    top = graph.personalized_pagerank(V.edges(spark, sf), seeds, 20, directed=False)
    return top.select("seed_set", "node", F.round("score", 7).alias("score"), "rank")


@query("g05_clinical_pathway", with_views("", "edges", "both").rstrip() + ", " + pagerank_sql(
    "SELECT src, dst FROM both_ways", "SELECT 'n' || n_nationkey AS seed_set, 'n' || n_nationkey AS node FROM nation", 10, 10) +
       """ SELECT 'p' || c_custkey AS patient_id, CASE WHEN c_custkey % 50 <> 0 THEN 1 ELSE 0 END AS n_anchors, rank, node, round(score, 7) AS score,
 CASE WHEN c_custkey % 50 = 0 THEN 'No coded conditions found or no bridge mappings loaded.' END AS message FROM customer LEFT JOIN top ON seed_set = 'n' || c_nationkey AND c_custkey % 50 <> 0""")
def _(spark, sf):
    cond = V.table(spark, sf, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("patient_id"), F.when(F.col("c_custkey") % 50 != 0, F.col("c_nationkey")).otherwise(99).alias("code"))
    bridge = V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return graph.clinical_pathway(cond, bridge, V.edges(spark, sf), 10).withColumn("score", F.round("score", 7))


@query("g06_pattern_match", with_views("""SELECT a.src AS n0, a.dst AS n1, b.dst AS n2, c.dst AS n3 FROM edges a JOIN edges b ON a.pred = 'PLACED_BY' AND b.pred = 'BASED_IN' AND b.src = a.dst
 JOIN edges c ON c.pred = 'IN_REGION' AND c.src = b.dst""", "edges"))
def _(spark, sf):
    return graph.pattern_match(V.edges(spark, sf), [("PLACED_BY", "out"), ("BASED_IN", "out"), ("IN_REGION", "out")])


@query("a21_graph_stats", with_views("""SELECT 'count' AS kind, 'nodes' AS key, count(*) AS n FROM nodes UNION ALL SELECT 'count', 'edges', count(*) FROM edges
 UNION ALL SELECT 'count', 'embedded', count(*) FROM nodes WHERE id IN (SELECT 'p' || vec_id FROM embeddings)
 UNION ALL SELECT 'label', label, count(*) FROM nodes GROUP BY label UNION ALL SELECT 'predicate', pred, count(*) FROM edges GROUP BY pred""", "nodes", "edges"))
def _(spark, sf):
    vecs = V.table(spark, sf, "embeddings").select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("id"))
    return graph.graph_stats(V.nodes(spark, sf), V.edges(spark, sf), vecs)


@query("a22_most_affected", with_views("SELECT dst AS module, count(DISTINCT src) AS ticket_count FROM edges WHERE pred = 'AFFECTS' GROUP BY dst ORDER BY 2 DESC, 1 LIMIT 8", "edges"))
def _(spark, sf):
    return graph.most_affected(V.edges(spark, sf))


HITS = """hits AS (SELECT 'c' || o_custkey AS query_id, 'o' || o_orderkey AS id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 5)"""


@query("j14_discovery_expand", with_views("", "edges").rstrip() + ", " + HITS + """, ent AS (SELECT DISTINCT h.query_id, e.dst AS entity FROM hits h JOIN edges e ON e.src = h.id AND e.pred = 'AFFECTS')
 SELECT DISTINCT n.query_id, entity, pred, src AS ticket_id FROM ent n JOIN edges e ON e.dst = n.entity WHERE src[1] = 'o' AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = n.query_id AND h.id = e.src)""")
def _(spark, sf):
    hits = first_rows(V.table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], 5).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("query_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), "rank")
    return graph.discovery_expand(hits, V.edges(spark, sf)).select("query_id", "entity", "pred", "ticket_id")


@query("g06_labelled_triangle", """WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem), op AS (SELECT DISTINCT l_orderkey, l_partkey FROM l), sp AS (SELECT DISTINCT l_suppkey, l_partkey FROM l), os AS (SELECT DISTINCT l_orderkey, l_suppkey FROM l)
SELECT 'o' || op.l_orderkey AS o, 'p' || op.l_partkey AS p, 's' || sp.l_suppkey AS s FROM op JOIN sp ON sp.l_partkey = op.l_partkey JOIN os ON os.l_orderkey = op.l_orderkey AND os.l_suppkey = sp.l_suppkey JOIN supplier ON s_suppkey = sp.l_suppkey WHERE s_acctbal > 0""")
def _(spark, sf):
    """Orders with a part and a supplier of that part who serves the order, whoever sent it."""
    li, kind = V.table(spark, sf, "lineitem"), lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edge = lambda a, ca, pred, b, cb: li.select(kind(a, ca).alias("src"), F.lit(pred).alias("pred"), kind(b, cb).alias("dst"))
    edges = edge("o", "l_orderkey", "AFFECTS", "p", "l_partkey").unionByName(edge("s", "l_suppkey", "SUPPLIES", "p", "l_partkey")).unionByName(edge("o", "l_orderkey", "SERVED_BY", "s", "l_suppkey"))
    nodes = V.table(spark, sf, "supplier").select(kind("s", "s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 0, "Solvent").otherwise("Other").alias("label"))
    return patterns.match_pattern(edges, [("o", "AFFECTS", "p"), ("s", "SUPPLIES", "p"), ("o", "SERVED_BY", "s")], {"s": "Solvent"}, nodes)


# --- vectors -----------------------------------------------------------------------------


def first_vector(spark, sf):
    return V.vectors(spark, sf).orderBy("id").first()["vec"]


Q = "(SELECT vec FROM vectors ORDER BY id LIMIT 1)"


@query("v01_embed_texts", with_views(r"""SELECT ticket_id, coalesce(string_agg(b || ':' || CAST(round(c / n * 1000000) AS BIGINT), ',' ORDER BY b), '') AS entries FROM tickets LEFT JOIN (
 SELECT *, sqrt(sum(c * c) OVER (PARTITION BY id)) AS n FROM (SELECT ticket_id AS id, ('0x' || substring(md5(w), 1, 8))::BIGINT % 384 AS b, count(*)::DOUBLE AS c FROM (
  SELECT ticket_id, unnest(regexp_split_to_array(lower(summary || ' ' || problem), '\s+')) AS w FROM tickets) WHERE w <> '' GROUP BY 1, 2)) ON id = ticket_id GROUP BY ticket_id""".replace("\\\\s", "\\s"), "tickets"))
def _(spark, sf):
    t = V.tickets(spark, sf, heavy=True).withColumn("full_content", F.concat_ws(" ", "summary", "problem"))
    e = vectors.embed_texts(t)
    cells = F.filter(F.transform("vec", lambda v, i: F.when(v > 0, F.concat_ws(":", i.cast("string"), F.round(v * 1000000).cast("long").cast("string")))), lambda c: c.isNotNull())
    return e.select("ticket_id", F.array_join(cells, ",").alias("entries"))


@query("v02_knn", with_views(f"""SELECT row_number() OVER (ORDER BY round(s, 9) DESC, id) AS rank, id, round(s, 3) AS sim FROM (SELECT id, list_cosine_similarity(vec, {Q}) AS s FROM vectors) ORDER BY round(s, 9) DESC, id LIMIT 8""", "vectors"))
def _(spark, sf):
    return vectors.knn(V.vectors(spark, sf), first_vector(spark, sf), 8)


@query("v02_find_similar", with_views(f"""SELECT 'vector' AS method, rank, v.id AS ticket_id, category FROM (SELECT row_number() OVER (ORDER BY round(s, 9) DESC, id) AS rank, id FROM (SELECT id, list_cosine_similarity(vec, {Q}) AS s FROM vectors)) v
  LEFT JOIN tickets ON ticket_id = v.id WHERE rank <= 8
 UNION ALL SELECT 'keyword', row_number() OVER (ORDER BY has_solution DESC, ticket_id) AS rank, ticket_id, category FROM tickets WHERE contains(lower(summary), 'tion') OR contains(lower(problem), 'tion') OR category = 'TION'
  QUALIFY rank <= 8""", "tickets", "vectors"))
def _(spark, sf):
    """With stored vectors, and with none."""
    t, v = V.tickets(spark, sf), V.vectors(spark, sf)
    ask = lambda vecs: vectors.find_similar(t, vecs, "tion", first_vector(spark, sf)).select("method", "rank", "ticket_id", "category")
    return ask(v).unionByName(ask(v.limit(0)))


@query("v03_knn_join", with_views("""SELECT query_id, rank, id, round(s, 4) AS sim FROM (SELECT q.vec_id AS query_id, c.id, list_cosine_similarity(q.vec, c.vec) AS s FROM vectors q, vectors c)
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank <= 5""".replace(
    "SELECT query_id, rank, id,", "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank, id,").replace(
    "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank <= 5", "QUALIFY rank <= 5"), "vectors"))
def _(spark, sf):
    v = V.vectors(spark, sf)
    j = vectors.knn_join(v.select(F.col("vec_id").alias("query_id"), "vec"), v, 5, block=1024)
    return j.select("query_id", "rank", "id", F.round("sim", 4).alias("sim"))


@query("v03_knn_projected")
def _(spark, sf):
    """The same join by buckets of random projections; its recall is measured in the tests."""
    v = V.vectors(spark, sf)
    return projections.knn_projected(v.select(F.col("vec_id").alias("query_id"), "vec"), v.select("id", "vec"), 5).withColumn("sim", F.round("sim", 4))


@query("v04_hybrid_search", with_views("", "edges", "both", "vectors").rstrip() + f""", sims AS (SELECT 'p' || vec_id AS id, list_cosine_similarity(vec, {Q}) AS s FROM vectors), hits AS (SELECT id, s FROM sims ORDER BY round(s, 9) DESC, id LIMIT 10),
 e1 AS (SELECT dst AS id, max(s) * 0.5::DOUBLE AS s FROM hits JOIN both_ways ON src = id GROUP BY 1)
 SELECT id, round(max(s), 4) AS combined_score, min(h) > 0 AS in_graph_expansion FROM (SELECT id, s, 0 AS h FROM hits UNION ALL SELECT id, s, 1 FROM e1) GROUP BY id""")
def _(spark, sf):
    v = V.vectors(spark, sf).withColumn("id", F.concat(F.lit("p"), F.col("vec_id").cast("string")))
    return vectors.hybrid_search(v, V.edges(spark, sf), first_vector(spark, sf), 10, 1)


@query("v05_density_cut", "WITH RECURSIVE " + V.CTE["vectors"] + """,
 d AS (SELECT a.id AS a, b.id AS b, list_distance(a.vec, b.vec) AS d FROM vectors a JOIN vectors b ON a.id <> b.id),
 core AS (SELECT a, d AS core FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY d) = 10),
 e AS (SELECT d.a, d.b FROM d JOIN core x ON x.a = d.a JOIN core y ON y.a = d.b WHERE greatest(d.d, x.core, y.core) <= 1.205),
 r AS (SELECT id AS a, id AS root FROM vectors UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a),
 c AS (SELECT a AS id, min(root) AS root FROM r GROUP BY 1), big AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM c GROUP BY root HAVING count(*) >= 10)
 SELECT id, coalesce(cluster, -1) AS cluster FROM c LEFT JOIN big USING (root)""")
def _(spark, sf):
    """Components of the spanning tree at one length, noise included."""
    return density.density_cut(V.vectors(spark, sf).select("id", "vec"), 1.205, 10)


@query("v05_density_clusters")
def _(spark, sf):
    """Clusters of all ticket texts by their embedding."""
    t = V.tickets(spark, sf, heavy=True).withColumn("full_content", F.concat_ws(" ", "summary", "problem"))
    return density.density_clusters(vectors.embed_texts(t).select(F.col("ticket_id").alias("id"), "vec"), 10)


@query("v06_suggest_from_similar", with_views("""SELECT q.ticket_id, row_number() OVER (PARTITION BY q.ticket_id ORDER BY round(s, 9) DESC, q.id) AS rank, q.id AS resolved_id, round(s, 3) AS sim, q.solution FROM (
 SELECT a.ticket_id, b.ticket_id AS id, b.solution, list_cosine_similarity(va.vec, vb.vec) AS s FROM tickets a JOIN vectors va ON va.id = a.ticket_id, tickets b JOIN vectors vb ON vb.id = b.ticket_id
 WHERE NOT a.has_solution AND b.has_solution) q QUALIFY rank <= 3""", "tickets", "vectors"))
def _(spark, sf):
    return vectors.suggest_from_similar(V.tickets(spark, sf), V.vectors(spark, sf))


@query("w02_anchor_resolutions", with_views("""SELECT cluster, anchor, ticket_id, round(s, 3) AS sim, solution, row_number() OVER (PARTITION BY cluster ORDER BY round(s, 9) DESC, ticket_id) AS rank FROM (
 SELECT o.cluster, a.ticket_id AS anchor, a.solution, o.ticket_id, list_cosine_similarity(vo.vec, va.vec) AS s FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY ticket_id) AS r FROM clustered WHERE NOT has_solution) o
 JOIN (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY ticket_id) AS r FROM clustered WHERE has_solution) a ON a.cluster = o.cluster AND a.r = 1
 JOIN vectors vo ON vo.id = o.ticket_id JOIN vectors va ON va.id = a.ticket_id) QUALIFY rank <= 4""", "tickets", "vectors", "clustered"))
def _(spark, sf):
    return vectors.anchor_resolutions(V.tickets(spark, sf), V.vectors(spark, sf))


# --- texts --------------------------------------------------------------------------------


@query("t01_context_info", "SELECT doc_id, length(text) AS chars, length(text) // 4 AS tokens, length(text) - length(replace(text, chr(10), '')) AS lines FROM documents")
def _(spark, sf):
    return documents.context_info(V.texts(spark, sf))


@query("t02_filter_text", """SELECT doc_id, array_to_string(m[1:20], '|') AS matches, greatest(len(m) - 20, 0) AS n_more FROM (SELECT doc_id, regexp_extract_all(text, '(?im)^[a-z]+tion') AS m FROM documents) WHERE len(m) > 0""")
def _(spark, sf):
    f = documents.filter_text(V.texts(spark, sf), "^[a-z]+tion")
    return f.select("doc_id", F.array_join("matches", "|").alias("matches"), "n_more")


CHUNKS = """chunks AS (SELECT doc_id, c AS chunk, c * 1000 AS start, least(c * 1000 + 1000, length(text)) AS stop, substring(text, c * 1000 + 1, 1000) AS text FROM documents, unnest(range(0, (length(text) + 999) // 1000)) u(c))"""


@query("t03_chunk_text", "WITH " + CHUNKS + " SELECT * FROM chunks")
def _(spark, sf):
    return documents.chunk_text(V.texts(spark, sf))


_WORDS = ["the", "tion", "and", "heit", "que"]
_SC = " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in _WORDS)


@query("t04_search_chunks", "WITH " + CHUNKS + f""" SELECT doc_id, chunk, score, text AS excerpt, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk DESC) AS rank
 FROM (SELECT *, {_SC} AS score FROM chunks) WHERE score > 0 QUALIFY rank <= 5""")
def _(spark, sf):
    return documents.search_chunks(V.texts(spark, sf), " ".join(_WORDS), 5)


def explored(spark, sf):
    d = V.texts(spark, sf)
    q = F.when(F.col("doc_id") % 4 == 0, "tion ment and que heit").when(F.col("doc_id") % 4 == 1, "zzz qqq and xyzzy").otherwise("The and und")
    return documents.explore(d.withColumn("query", q))


EXPLORE = f"""{CHUNKS}, tasks(doc_id, part, task, words) AS (
  SELECT doc_id, 0, 'a', ['tion', 'ment'] FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 1, 'b', ['que', 'heit'] FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 0, 'c', ['zzz', 'qqq'] FROM documents WHERE doc_id % 4 = 1 UNION ALL SELECT doc_id, 1, 'd', ['xyzzy'] FROM documents WHERE doc_id % 4 = 1
  UNION ALL SELECT doc_id, 0, 'e', ['the'] FROM documents WHERE doc_id % 4 > 1 UNION ALL SELECT doc_id, 1, 'f', ['und'] FROM documents WHERE doc_id % 4 > 1),
 sc AS (SELECT t.doc_id, part, chunk, len(list_filter(words, lambda w: contains(lower(text), w))) AS score, text AS ex FROM tasks t JOIN chunks c ON c.doc_id = t.doc_id),
 rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY score DESC, chunk DESC) AS r FROM sc WHERE score > 0),
 pt AS (SELECT t.doc_id, t.part, coalesce(string_agg('[Chunk ' || chunk || ', score=' || score || ']' || chr(10) || ex || '...', chr(10) || chr(10) ORDER BY r), 'No relevant sections found') AS t
  FROM tasks t LEFT JOIN rk ON rk.doc_id = t.doc_id AND rk.part = t.part GROUP BY 1, 2),
 mg AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY part) AS t FROM pt GROUP BY 1),
 an AS (SELECT doc_id, array_to_string(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> ''), chr(10)) AS a FROM mg),
 cf AS (SELECT *, CASE WHEN a = '' THEN 0.0::DOUBLE WHEN contains(a, 'No relevant sections') THEN 0.2::DOUBLE WHEN length(a) < 60 THEN 0.4::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM an)"""


@query("t05_explore", "WITH " + EXPLORE + f""" SELECT doc_id, CASE WHEN confidence < 0.35 THEN 'next_step_plan' ELSE 'answer' END AS decision, CASE WHEN confidence < 0.35 THEN '{documents.PLAN}' ELSE a END AS answer, confidence FROM cf""")
def _(spark, sf):
    return explored(spark, sf)[0].select("doc_id", "decision", "answer", "confidence")


@query("t05_explore_traces", "WITH " + EXPLORE + f""" SELECT doc_id, seq, stage, CASE seq WHEN 1 THEN 'subtasks=2' WHEN 2 THEN 'searched context' WHEN 3 THEN 'created summary' ELSE CASE WHEN confidence < 0.35 THEN '{documents.PLAN}' ELSE 'final answer ready' END END AS detail
 FROM cf, (VALUES (1, 'decompose'), (2, 'explore'), (3, 'summarize'), (4, 'finalize')) s(seq, stage)""")
def _(spark, sf):
    return explored(spark, sf)[1]


def cited(spark, sf):
    """Documents as answers that cite their own lines; some quotes are altered."""
    d = V.texts(spark, sf)
    first, last = F.split_part("text", F.lit("\n"), F.lit(1)), F.split_part("text", F.lit("\n"), F.lit(-1))
    dec = lambda s, rule, quote: F.struct(s.alias("source"), rule.alias("rule"), F.col("lang").alias("rationale"), quote.alias("quote"))
    none = F.lit(None).cast("string")
    ds = F.array(dec(F.col("source"), first, F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("never said "), first))), dec(F.col("lang"), last, none),
                 dec(F.lit("elsewhere"), F.lit("Something else entirely, not in the answer at all"), F.lit("entirely, not in")))
    return d.select(F.col("doc_id").alias("answer_id"), F.col("text").alias("answer"), ds.alias("decisions"))


@query("a25_ground_claims", """WITH b AS (SELECT doc_id, text, source, lang, split_part(text, chr(10), 1) AS f, split_part(text, chr(10), -1) AS l FROM documents),
 c AS (SELECT *, f <> '' AS u1, l <> '' AS u2, doc_id % 3 <> 0 AND contains(rtrim(ltrim(f || '. ' || lang, '. '), '. ') || '.', f) AS k1, contains(rtrim(ltrim(l || '. ' || lang, '. '), '. ') || '.', l) AS k2 FROM b),
 d AS (SELECT *, CASE WHEN u1 AND k1 THEN 1 ELSE 0 END + CASE WHEN u2 AND k2 THEN 1 ELSE 0 END + 1 AS v, CASE WHEN u1 THEN 1 ELSE 0 END + CASE WHEN u2 THEN 1 ELSE 0 END + 1 AS n FROM c),
 e AS (SELECT *, CASE WHEN u1 AND k1 AND position(substring(f, 1, 30) IN text) > 0 AND NOT contains(text, ' [SOURCE: ' || source || ']')
   THEN substring(text, 1, position(substring(f, 1, 30) IN text) - 1) || substring(f, 1, 30) || ' [SOURCE: ' || source || ']' || substring(text, position(substring(f, 1, 30) IN text) + length(substring(f, 1, 30))) ELSE text END AS t1 FROM d),
 g AS (SELECT *, CASE WHEN u2 AND k2 AND position(substring(l, 1, 30) IN t1) > 0 AND NOT contains(t1, ' [SOURCE: ' || lang || ']')
   THEN substring(t1, 1, position(substring(l, 1, 30) IN t1) - 1) || substring(l, 1, 30) || ' [SOURCE: ' || lang || ']' || substring(t1, position(substring(l, 1, 30) IN t1) + length(substring(l, 1, 30))) ELSE t1 END AS t2 FROM e)
 SELECT doc_id AS answer_id, v AS verified, n - v AS unverified, round(v / n, 3) AS confidence, t2 || CASE WHEN NOT contains(t2, '[SOURCE:') THEN chr(10) || chr(10) || '*Grounded by: ' ||
  concat_ws(', ', CASE WHEN u1 AND k1 THEN source END, CASE WHEN u2 AND k2 THEN lang END, 'elsewhere') || '*' ELSE '' END AS grounded_text FROM g""")
def _(spark, sf):
    return documents.ground_claims(cited(spark, sf))


@query("a26_answer_quality", r"""WITH c AS (SELECT conv_id, turn, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS query FROM conversations),
 w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(query, '')), '\s+'), lambda x: length(x) > 3)) AS q, list_filter(regexp_split_to_array(lower(answer), '\s+'), lambda x: x <> '') AS a FROM c),
 s AS (SELECT *, CASE WHEN trim(answer) = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE + CASE WHEN length(answer) >= 40 THEN 1 ELSE 0 END + CASE WHEN len(q) > 0 THEN least(2.0::DOUBLE, 2.0::DOUBLE * len(list_intersect(q, a)) / len(q)) ELSE 0 END
  + CASE WHEN coalesce(query, '') <> '' THEN 1 ELSE 0 END END AS score FROM w)
 SELECT conv_id || '.' || turn AS id, round(score, 6) AS score, score >= 4.0 AS passed FROM s""")
def _(spark, sf):
    from ..operators.ordering import last_before

    c = V.table(spark, sf, "conversations")
    p = last_before(c, ["conv_id"], ["turn"], F.col("text"), "query")
    rows = p.select(F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "query", F.col("text").alias("answer"), F.col("query").alias("context"))
    return documents.answer_quality(rows).withColumn("score", F.round("score", 6))


@query("u08_rows_as_text", "SELECT o_orderkey, 'o_custkey: ' || o_custkey || chr(10) || 'o_orderstatus: ' || o_orderstatus || chr(10) || 'o_orderpriority: ' || o_orderpriority AS text FROM orders")
def _(spark, sf):
    return documents.rows_as_text(V.table(spark, sf, "orders"), "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"])
