"""Readers and writers of tickets, metrics, headers, vectors and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cut, filled, hex_id, text
from ..session import written

RAW_TICKET = ("ticket_id string, Classification string, Hospital string, Summary string, Problem string, "
              "Solution string, Status string, has_solution string")


def shape_tickets(raw: DataFrame, summary: int | None = None, problem: int | None = None, solution: int | None = None, full: int | None = None) -> DataFrame:
    """Export fields to ticket columns, whole; a store with column lengths names them."""
    flag = F.col("has_solution").isin("1") | (F.upper("has_solution") == "TRUE")
    out = raw.filter(filled("ticket_id")).select(
        "ticket_id", F.col("Classification").alias("category"), F.col("Hospital").alias("hospital"),
        cut(text("Summary"), summary).alias("summary"), cut(text("Problem"), problem).alias("problem"),
        cut(text("Solution"), solution).alias("solution"), text("Status").alias("status"),
        F.coalesce(flag, F.lit(False)).alias("has_solution"))
    return out.withColumn("full_content", cut(F.concat_ws(" ", "summary", "problem"), full))


def read_tickets(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON export: one array per file, or one object per line (splittable)."""
    return shape_tickets(spark.read.schema(RAW_TICKET).option("multiLine", not lines).json(path))


def tickets_from_json(df: DataFrame, json_col: str) -> DataFrame:
    return shape_tickets(df.select(F.from_json(json_col, RAW_TICKET).alias("r")).select("r.*"))


def load_if_absent(df: DataFrame, existing: DataFrame, key: str, skip_if_any: bool = True) -> DataFrame:
    """Rows to append: one per unseen key (repeats do not fail). A target that
    already has a row takes nothing; without ``skip_if_any`` it takes unseen keys."""
    if skip_if_any and not existing.isEmpty():
        return df.limit(0)
    rest = [c for c in df.columns if c != key]
    fresh = df.join(existing.select(key).distinct(), key, "left_anti")
    one = fresh.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*rest)).alias("_r")) if rest else fresh.select(key).distinct()
    return one.select(key, "_r.*").select(*df.columns) if rest else one


def read_metric_samples(df: DataFrame, as_of: Column, minutes: int = 60) -> DataFrame:
    """``(metric, key, value)`` text rows; the first 14 key characters are the
    time. Unparsable rows and rows older than the look-back are dropped."""
    ts = F.try_to_timestamp(F.substring("key", 1, 14), F.lit("yyyyMMddHHmmss"))
    rows = df.select("metric", ts.alias("ts"), F.col("value").try_cast("double").alias("value"))
    return rows.filter(F.col("ts").isNotNull() & F.col("value").isNotNull() & (F.col("ts") >= as_of - F.expr(f"INTERVAL {int(minutes)} MINUTES")))


def message_headers(spark: SparkSession, path: str) -> DataFrame:
    """Canonical header table, typed, with plain timestamps."""
    h = spark.read.parquet(path)
    return h.select("id", "source", "target", "body_class", F.col("created").cast("timestamp").alias("created"),
                    F.col("processed").cast("timestamp").alias("processed"), F.col("status").cast("int").alias("status"))


def vectors_from_csv(df: DataFrame, csv_col: str, dim: int, id_col: str = "id") -> DataFrame:
    """``v1,v2,…`` text to ``array<double>``; another dimension fails the job."""
    vec = F.transform(F.split(F.col(csv_col), ","), lambda x: x.try_cast("double"))
    bad = F.concat(F.lit(f"vector dimension is not {dim}: "), F.col(id_col).cast("string"))
    return df.select(id_col, F.when(F.size(vec) == dim, vec).otherwise(F.raise_error(bad).cast("array<double>")).alias("vec"))


def vectors_to_csv(df: DataFrame, vec_col: str = "vec", id_col: str = "id") -> DataFrame:
    return df.select(id_col, F.array_join(F.transform(vec_col, lambda x: F.format_string("%.6f", x)), ",").alias("csv"))


CASES = ("struct<cases:array<struct<id:string,patientId:string,prompt:string,search_query:string,expect_followup:boolean,"
         "priority:string,adversarial:boolean,agent_summary:string,expected_trajectory:array<string>,"
         "rule_expected:struct<domains:map<string,string>,priority:string>,"
         "human_label:struct<domains:map<string,string>,priority:string>,tags:array<string>>>>")


def cases_from_json(df: DataFrame, json_col: str) -> DataFrame:
    c = df.select(F.explode_outer(F.from_json(json_col, CASES)["cases"]).alias("c")).filter("c is not null").select("c.*")
    return c.select(
        F.col("id").alias("case_id"), F.col("patientId").alias("patient_id"), "prompt", "search_query", "expect_followup", "priority",
        F.coalesce("adversarial", F.lit(False)).alias("adversarial"), "agent_summary", "expected_trajectory",
        F.col("rule_expected.domains").alias("rule_domains"), F.col("rule_expected.priority").alias("rule_priority"),
        F.col("human_label.domains").alias("human_domains"), F.col("human_label.priority").alias("human_priority"), "tags")


def read_golden_cases(spark: SparkSession, path: str) -> DataFrame:
    return cases_from_json(spark.read.text(path, wholetext=True), "value")


def read_kb_stubs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.schema("id string, title string, category string, crisis_level string, content string, source string, product string").option(
        "multiLine", not lines).json(path)


def append_triples(articles: DataFrame, agent: str = "kb.writer", sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Published articles to three properties, one AUTHORED_KB edge and one
    SOURCED_KB edge per listed ticket. ``articles(article_id, category,
    generated_at, source_tickets)``; the list ends at its first empty entry. Lists
    that grow with the data come as ``sources(article_id, ticket_id)``, one row per
    ticket, instead of ``source_tickets``."""
    node = F.concat(F.lit("kb_article:"), F.col("article_id"))
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("val")) for k in ("article_id", "category", "generated_at")])
    props = articles.select(node.alias("id"), F.explode_outer(entries).alias("e")).select("id", "e.*")
    authored = articles.select(F.lit(f"agent:{agent}").alias("src"), F.lit("AUTHORED_KB").alias("pred"), node.alias("dst"))
    if sources is not None:
        listed = sources.select(F.concat(F.lit("pc_ticket:"), F.trim("ticket_id")).alias("src"), F.lit("SOURCED_KB").alias("pred"),
                                F.concat(F.lit("kb_article:"), F.col("article_id")).alias("dst")).filter("src <> 'pc_ticket:'")
        return props, authored.unionByName(listed)
    pieces = F.split(text("source_tickets"), ",", -1)
    gap = F.array_position(pieces, F.lit("")).cast("int")
    listed = F.when(gap == 0, pieces).otherwise(F.slice(pieces, F.lit(1), F.greatest(gap - 1, F.lit(0))))
    sourced = articles.select(F.explode_outer(listed).alias("t"), node.alias("dst")).filter("t is not null").select(
        F.concat(F.lit("pc_ticket:"), F.trim("t")).alias("src"), F.lit("SOURCED_KB").alias("pred"), "dst")
    return props, authored.unionByName(sourced)


def merge_graph(concepts: DataFrame, decisions: DataFrame, edges: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Upsert recorded decisions. A new concept gets name, domain and no aliases,
    a known one only its domain. A decision is created once; a second one with
    the same id is left out and reported. Edges are unique.
    ``updates(concept, domain, rule, source, rationale, effective_date, seq)``.
    Returns (concepts, decisions, edges, conflicts). The updates are grouped once, by
    concept and date; all but the conflicts comes from the groups, which are written."""
    def named(rows: DataFrame) -> DataFrame:
        cid = F.lower(F.replace("concept", F.lit(" "), F.lit("_")))
        return rows.withColumn("concept_id", cid).withColumn("id", F.concat(F.lit("decision_"), cid, F.lit("_"), F.col("effective_date")))

    fields = ["concept_id", "rule", "source", "rationale", "effective_date"]
    groups = named(written(updates.groupBy("concept", "effective_date").agg(
        F.min_by(F.struct(*fields[1:4]), "seq").alias("_r"), F.min("seq").alias("seq"), F.max_by("domain", "seq").alias("_domain"), F.max("seq").alias("_last")), "updates"))
    newest = groups.groupBy(F.col("concept_id").alias("id")).agg(F.min_by("concept", "seq").alias("_name"), F.max_by("_domain", "_last").alias("_domain"))
    merged = concepts.join(newest, "id", "full_outer").select(
        "id", F.coalesce("name", "_name").alias("name"), F.coalesce("_domain", "domain").alias("domain"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    first = groups.groupBy("id").agg(F.min_by(F.struct("concept_id", *[F.col(f"_r.{c}").alias(c) for c in fields[1:4]], "effective_date"), "seq").alias("_r"), F.min("seq").alias("seq")).select("id", "_r.*", "seq")
    created = first.join(decisions.select("id"), "id", "left_anti")
    all_decisions = decisions.select("id", *fields).unionByName(created.select("id", *fields))
    conflicts = named(updates).join(created.select("id", "seq"), ["id", "seq"], "left_anti").select("id", "concept_id", "rule", "source", "seq")
    governs = groups.select(F.col("id").alias("src"), F.lit("GOVERNS").alias("pred"), F.col("concept_id").alias("dst"))
    return merged, all_decisions, edges.select("src", "pred", "dst").unionByName(governs).distinct(), conflicts


def care_plan_resources(followups: DataFrame, as_of: Column, author: str = "care-team") -> DataFrame:
    """Follow-up rows to CarePlan resource JSON."""
    note = F.concat(F.lit("SDoH follow-up care plan.\nCHW assigned: "), text("worker_id"), F.lit("\nSDoH flags: "), text("sdoh_flags"),
                    F.lit("\nPriority: "), text("priority"))
    coding = F.struct(F.lit("http://snomed.info/sct").alias("system"), F.lit("734163000").alias("code"), F.lit("Care plan").alias("display"))
    plan = F.struct(
        F.lit("CarePlan").alias("resourceType"), F.lit("active").alias("status"), F.lit("plan").alias("intent"),
        F.array(F.struct(F.array(coding).alias("coding"))).alias("category"),
        F.struct(F.concat(F.lit("Patient/"), F.col("patient_id")).alias("reference")).alias("subject"),
        F.struct(F.date_format(as_of, "yyyy-MM-dd").alias("start")).alias("period"),
        F.struct(F.coalesce("requested_by", F.lit(author)).alias("display")).alias("author"),
        F.array(F.struct(note.alias("text"))).alias("note"))
    return followups.select("patient_id", hex_id(12, "request_id").alias("resource_id"), F.to_json(plan).alias("resource_json"))
