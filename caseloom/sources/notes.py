"""Markdown pages and notes: reading, exporting, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import filled, text
from ..operators.tickets import slug_of


def shape_wiki(files: DataFrame) -> DataFrame:
    """``files(file, text)`` to title, last-updated line and a gap flag."""
    lines = F.split("text", "\n")
    first = lambda cond: F.try_element_at(F.filter(lines, cond), F.lit(1))
    gap = F.exists(lines, lambda x: x.contains("Knowledge Gap") | F.lower(x).contains("undocumented"))
    return files.filter(F.col("file") != "README.md").select(
        "file", text(F.regexp_replace(first(lambda x: x.startswith("# ")), "^# ", "")).alias("title"),
        text(first(lambda x: x.startswith("*Last updated") | x.startswith("_Last updated"))).alias("last_updated"), gap.alias("has_gaps"), "text")


def read_wiki(spark: SparkSession, path: str) -> DataFrame:
    pages = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return shape_wiki(pages.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")))


def parse_note(c: Column) -> tuple[Column, Column]:
    """Frontmatter map (a repeated key keeps its last value) and body."""
    head = F.regexp_extract(c, r"(?s)^---\n(.*?)\n---\n", 1)
    has = c.rlike(r"(?s)^---\n.*?\n---\n")
    pairs = F.transform(F.filter(F.split(head, "\n"), lambda x: x.contains(":")),
                        lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"),
                                           F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    body = F.when(has, F.regexp_replace(c, r"(?s)^---\n.*?\n---\n", "")).otherwise(c)
    return F.map_from_entries(last), body


def shape_notes(files: DataFrame) -> DataFrame:
    fm, body = parse_note(F.col("text"))
    return files.select("file", fm.alias("frontmatter"), body.alias("body")).select(
        "file", F.try_element_at("frontmatter", F.lit("id")).alias("id"), F.try_element_at("frontmatter", F.lit("type")).alias("type"), "frontmatter", "body")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    notes = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(path, wholetext=True)
    return shape_notes(notes.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")))


def _note(kind: str, rows: DataFrame, existing: DataFrame, fields: list[tuple[str, Column]], body: list[Column]) -> DataFrame:
    """Join existing frontmatter, keep human keys, render one note per row."""
    old = existing.select(F.col("id").alias("_old_id"), F.col("frontmatter").alias("_old"))
    joined = rows.join(old, F.col("id") == F.col("_old_id"), "left")
    ours = F.create_map(*[x for k, v in fields for x in (F.lit(k), text(v))])
    kept = F.map_filter(F.coalesce("_old", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*[k for k, _ in fields]))
    out = joined.withColumn("frontmatter", F.map_concat(ours, kept))
    lines = F.array_join(F.transform(F.map_entries("frontmatter"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.withColumn("_head", F.concat(F.lit("---\n"), lines, F.lit("\n---\n"))).select(
        F.lit(kind).alias("kind"), "id", "frontmatter", F.concat("_head", *body).alias("text"))


def export_notes(concepts: DataFrame, decisions: DataFrame, contradictions: DataFrame, existing: DataFrame) -> DataFrame:
    """Render knowledge rows as notes. Keys a human added stay; a human's
    ``resolved_by``, rationale and differing status win over the graph's."""
    L = F.lit
    names = concepts.select(F.col("id").alias("concept_id"), F.col("name").alias("concept_name"))
    aliases = F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), ", ")
    c = _note("concept", concepts, existing,
              [("id", F.col("id")), ("type", L("SDoHConcept")), ("name", F.col("name")), ("domain", F.col("domain")), ("aliases", aliases)],
              [L("\n## "), text("name"), L("\n\n**Domain:** "), text("domain"), L("\n\n"),
               F.when(aliases != "", F.concat(L("**Also known as:** "), aliases, L("\n\n"))).otherwise(""),
               L("## Related Decisions\n\nSee [[Decisions/decision_"), F.col("id"), L("_*]] for governing protocol decisions.\n\n## Notes\n\n")])
    d = _note("decision", decisions.join(names, "concept_id", "left"), existing,
              [("id", F.col("id")), ("type", L("SDoHDecision")), ("concept", F.col("concept_id")), ("source", F.col("source")),
               ("effective_date", F.col("effective_date"))],
              [L("\n## "), text("source"), L("\n\n**Concept:** [[Concepts/"), F.col("concept_id"), L("|"), F.coalesce("concept_name", "concept_id"),
               L("]]\n\n**Effective:** "), text("effective_date"), L("\n\n### Rule\n\n"), text("rule"), L("\n\n### Rationale\n\n"), text("rationale"), L("\n\n")])
    human = lambda k: text(F.try_element_at("_old", L(k)))
    status = F.when((human("status") != "") & (human("status") != F.col("status")), human("status")).otherwise(F.col("status"))
    x = _note("contradiction", contradictions.join(names, "concept_id", "left"), existing,
              [("id", F.col("id")), ("type", L("Contradiction")), ("concept", F.col("concept_id")), ("status", status), ("owner", F.col("owner")),
               ("resolved_by", human("resolved_by")), ("resolution_rationale", human("resolution_rationale"))],
              [L("\n## "), F.col("id"), L("\n\n**Concept:** [[Concepts/"), F.col("concept_id"), L("|"), F.coalesce("concept_name", "concept_id"),
               L("]]\n\n**Owner:** "), text("owner"), L("\n\n## Conflicting Statements\n\n**A:** "), text("statement_a"), L("\n*Source: "), text("source_a"),
               L("*\n\n**B:** "), text("statement_b"), L("\n*Source: "), text("source_b"), L("*\n\n## Resolution\n\n"),
               F.when(F.element_at("frontmatter", L("resolved_by")) != "", F.concat(
                   L("Resolved by decision: [[Decisions/"), F.element_at("frontmatter", L("resolved_by")), L("]]\n\n"),
                   F.when(F.element_at("frontmatter", L("resolution_rationale")) != "",
                          F.concat(L("**Rationale:** "), F.element_at("frontmatter", L("resolution_rationale")), L("\n\n"))).otherwise("")))
               .otherwise("_Fill in `resolved_by` (decision ID) and `resolution_rationale` in the frontmatter above, then change `status` to `RESOLVED`._\n\n"),
               L("## Notes\n\n")])
    return c.unionByName(d).unionByName(x)


def publish_article(pages: DataFrame, articles: DataFrame, as_of: Column, agent: str = "kb.writer", shown: int | None = None) -> DataFrame:
    """Create or extend the page of each article's category. ``pages(slug,
    text)``, ``articles(category, article_text, source_tickets array)`` with one
    article per category and run; the first ``shown`` tickets are listed, or all. Where
    ``articles`` has a column ``ticket_total``, that is how many tickets there are, and the list
    need only hold the first. The result is written to a new version path, never over the
    pages being read."""
    L = F.lit
    art = articles.withColumn("slug", slug_of(F.col("category"))).withColumn("article_id", F.concat(L("KB-PC-"), F.upper("slug")))
    tickets = F.coalesce("source_tickets", F.array().cast("array<string>"))
    total = F.coalesce("ticket_total", F.size(tickets)) if "ticket_total" in articles.columns else F.size(tickets)
    first = F.slice(tickets, 1, shown) if shown is not None else tickets
    listed = F.concat(F.array_join(first, ", "), F.when(total > F.size(first), "...").otherwise(""))
    section = F.concat(
        L("\n---\n\n## "), F.col("article_id"), L(" *(AI-Generated — "), F.date_format(as_of, "yyyy-MM-dd HH:mm"), L(")*\n\n> **Source:** "),
        total.cast("string"), L(f" support tickets clustered automatically\n> **Agent:** {agent}\n> *Review before publishing — AI-generated content may require expert validation*\n\n"),
        F.col("article_text"), L("\n\n**Source tickets:** "), listed, L("\n\n---\n"))
    old = pages.select("slug", F.col("text").alias("_old"))
    cleaned = F.col("_old")
    for p in fixed.GAP_PLACEHOLDERS:
        for mark in ("*", "_"):
            cleaned = F.replace(cleaned, L(mark + p + mark), L(fixed.GAP_REPLACEMENT))
    fresh = F.concat(L("# "), F.col("category"), L(" — Knowledge Base\n\n*Created by KB Mining pipeline*\n"), section)
    joined = art.join(old, "slug", "full_outer")
    return joined.select(
        "slug", "article_id",
        F.when(F.col("article_id").isNull(), "kept").when(F.col("_old").isNull(), "created").otherwise("augmented").alias("action"),
        F.when(F.col("article_id").isNull(), F.col("_old")).when(F.col("_old").isNull(), fresh).otherwise(F.concat(cleaned, section)).alias("text"))


def article_sources(tickets: DataFrame) -> DataFrame:
    """article_id, ticket_id: every solved ticket beside the article of its category,
    one row each, whatever the size of the category."""
    return tickets.filter("has_solution").select(F.concat(F.lit("KB-PC-"), F.upper(slug_of(F.col("category")))).alias("article_id"), "ticket_id")


def write_texts(df: DataFrame, path: str, name_col: str = "id", text_col: str = "text") -> None:
    """Text sink: one JSON line per note, partitioned by kind where present."""
    out = df.select(*[c for c in ("kind",) if c in df.columns], F.col(name_col).alias("name"), F.col(text_col).alias("text"))
    writer = out.write.mode("errorifexists")
    (writer.partitionBy("kind") if "kind" in df.columns else writer).json(path)
