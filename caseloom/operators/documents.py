"""Exploring long texts: measures, filters, chunks, keyword search, grounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cut, filled, text
from .ordering import first_rows


def context_info(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    n = F.length(text_col)
    return docs.select(id_col, n.alias("chars"), F.floor(n / 4).cast("int").alias("tokens"),
                       F.regexp_count(F.col(text_col), F.lit("\n")).alias("lines"))


def filter_text(docs: DataFrame, pattern: str, cap: int = 20, text_col: str = "text", id_col: str = "doc_id", group: int = 0) -> DataFrame:
    """Case-insensitive, line-aware matches per document: the first ``cap`` and
    how many more there are. A pattern with a group returns that group."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"(?im){pattern}"), F.lit(group))
    return docs.select(id_col, found.alias("_m")).filter(F.size("_m") > 0).select(
        id_col, F.slice("_m", 1, cap).alias("matches"), F.greatest(F.size("_m") - cap, F.lit(0)).alias("n_more"))


def chunk_text(docs: DataFrame, size: int = 1000, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fixed-size chunks of the whole text with their character range."""
    size = max(1, size)
    total = F.length(text_col)
    starts = F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)), F.lit(size))
    rows = docs.filter(total > 0).select(id_col, text_col, F.posexplode_outer(starts).alias("chunk", "start"))
    return rows.select(id_col, "chunk", "start", F.least(F.col("start") + size, F.length(text_col)).alias("stop"),
                       F.substring(F.col(text_col), F.col("start") + 1, F.lit(size)).alias("text"))


def word_score(chunk: Column, words: Sequence[str]) -> Column:
    low = F.lower(chunk)
    return sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))


def search_chunks(docs: DataFrame, query: str, k: int = 5, size: int = 1000, excerpt_cut: int | None = None, text_col: str = "text",
                  id_col: str = "doc_id") -> DataFrame:
    """Chunks by number of contained query words; ties go to the later chunk."""
    chunks = chunk_text(docs, size, text_col, id_col)
    scored = chunks.withColumn("score", word_score(F.col("text"), query.lower().split())).filter(F.col("score") > 0)
    slim = scored.select(id_col, "chunk", "score", cut("text", excerpt_cut).alias("excerpt"))
    return first_rows(slim, [id_col], [F.desc("score"), F.desc("chunk")], k)


PLAN = "PLAN: refine query and continue staged exploration"
NOTHING = "No relevant sections found"


def explore(docs: DataFrame, query_col: str = "query", text_col: str = "text", id_col: str = "doc_id", k: int | None = None,
            size: int = 1000, excerpt_cut: int | None = None, max_lines: int | None = None, max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Staged answer per (document, query): split the query on " and ", search
    each part, join the non-blank lines of the chunks found, rate the confidence
    and plan again below 0.35. Returns answers and traces. A caller may ask for
    the best ``k`` chunks of each part, and limit excerpts, lines and the answer;
    ``n_more_chunks`` and ``n_more_lines`` count what a limit left out. What meets
    in one group is at most the document once per part."""
    parts = F.filter(F.transform(F.split(F.col(query_col), " and "), lambda p: F.trim(p)), lambda p: p != "")
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.col(query_col)))
    base = docs.select(id_col, text_col, parts.alias("_parts"))
    tasks = base.select(id_col, text_col, F.posexplode_outer("_parts").alias("part", "task"))
    tasks = tasks.withColumn("_w", F.filter(F.split(F.lower("task"), r"\s+"), lambda w: w != ""))
    total = F.length(text_col)
    chunks = tasks.filter(total > 0).select(
        id_col, "part", "_w", text_col, F.posexplode_outer(F.sequence(F.lit(0), total - 1, F.lit(size))).alias("chunk", "start"))
    body = F.substring(F.col(text_col), F.col("start") + 1, F.lit(size))
    scored = chunks.select(id_col, "part", "chunk", "_w", body.alias("_t")).withColumn("_low", F.lower("_t")).withColumn(
        "score", F.size(F.filter("_w", lambda w: F.col("_low").contains(w)))).filter(F.col("score") > 0)
    slim = scored.select(id_col, "part", "chunk", "score", cut("_t", excerpt_cut).alias("excerpt"))
    order = F.struct((-F.col("score")).alias("s"), (-F.col("chunk")).alias("c"))
    shown = F.concat(F.lit("[Chunk "), F.col("chunk").cast("string"), F.lit(", score="), F.col("score").cast("string"), F.lit("]\n"), F.col("excerpt"), F.lit("..."))
    if k:
        kept = first_rows(slim, [id_col, "part"], [F.desc("score"), F.desc("chunk")], k).drop("rank")
        all_of = slim.groupBy(id_col, "part").agg(F.count(F.lit(1)).alias("_n"))
        slim = kept.join(all_of, [id_col, "part"])
    else:
        slim = slim.withColumn("_n", F.lit(None).cast("long"))
    per_part = slim.groupBy(id_col, "part").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), shown.alias("t")))).alias("_s"), F.max("_n").alias("_n"))
    found = tasks.select(id_col, "part").join(per_part, [id_col, "part"], "left").withColumn(
        "_t", F.coalesce(F.array_join(F.transform("_s", lambda r: r["t"]), "\n\n"), F.lit(NOTHING)))
    more = F.sum(F.coalesce(F.col("_n") - F.size("_s"), F.lit(0))).alias("n_more_chunks")
    merged = found.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("part", "_t"))).alias("_f"), more).select(
        id_col, F.size("_f").alias("n_parts"), "n_more_chunks", F.array_join(F.transform("_f", lambda r: r["_t"]), "\n\n").alias("_all"))
    merged = merged.withColumn("_lines", F.filter(F.split("_all", "\n"), lambda x: F.trim(x) != ""))
    shown_lines = F.slice("_lines", 1, max_lines) if max_lines else F.col("_lines")
    out = merged.withColumn("_a", cut(F.array_join(shown_lines, "\n"), max_chars)).withColumn("n_more_lines", F.size("_lines") - F.size(shown_lines))
    confidence = (F.when(F.col("_a") == "", 0.0).when(F.col("_a").contains("No relevant sections"), 0.2)
                  .when(F.length("_a") < 60, 0.4).otherwise(0.75))
    out = out.withColumn("confidence", confidence).withColumn(
        "decision", F.when(F.col("confidence") < 0.35, "next_step_plan").otherwise("answer"))
    answers = out.select(id_col, "decision", F.when(F.col("decision") == "answer", F.col("_a")).otherwise(PLAN).alias("answer"), "confidence", "n_parts", "n_more_chunks", "n_more_lines")
    stage = lambda seq, name, detail: F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("stage"), detail.alias("detail"))
    stages = F.array(
        stage(1, "decompose", F.concat(F.lit("subtasks="), F.col("n_parts").cast("string"))), stage(2, "explore", F.lit("searched context")),
        stage(3, "summarize", F.lit("created summary")),
        stage(4, "finalize", F.when(F.col("decision") == "answer", "final answer ready").otherwise(PLAN)))
    return answers, answers.select(id_col, F.explode_outer(stages).alias("t")).select(id_col, "t.seq", "t.stage", "t.detail")


def answer_quality(df: DataFrame, query: str = "query", answer: str = "answer", context: str = "context", threshold: float = 4.0,
                   id_col: str = "id", parity: str | None = None) -> DataFrame:
    """0 to 5: non-empty 1, at least 40 characters 1, overlap with query words
    longer than three characters up to 2, context present 1."""
    words = lambda c: F.filter(F.split(F.lower(text(c)), r"\s+"), lambda w: w != "")
    q = F.array_distinct(F.filter(words(query), lambda w: F.length(w) > 3))
    shared = F.size(F.array_intersect(q, F.array_distinct(words(answer))))
    overlap = F.when(F.size(q) > 0, F.least(F.lit(2.0), 2.0 * shared / F.size(q))).otherwise(0.0)
    points = (F.lit(1.0) + F.when(F.length(text(answer)) >= 40, 1.0).otherwise(0.0) + overlap + F.when(filled(context), 1.0).otherwise(0.0))
    score = F.when(F.trim(text(answer)) == "", 0.0).otherwise(F.least(F.lit(5.0), points))
    passed = score >= threshold
    return df.select(id_col, score.alias("score"), (passed & F.col(parity) if parity else passed).alias("passed"))


def ground_claims(answers: DataFrame, answer_col: str = "answer", decisions_col: str = "decisions", id_col: str = "answer_id") -> DataFrame:
    """Verify each cited decision: its quote (or its rule) must occur verbatim in
    the source text "rule. rationale". Verified rules found in the answer by
    their first 30 characters get `` [SOURCE: x]``; without any such place a
    "Grounded by" line is added. ``decisions`` is an array of structs (source,
    rule, rationale, quote) on the answer's own row: a projection, no shuffle."""
    usable = F.filter(F.col(decisions_col), lambda d: filled(d["source"]) & filled(d["rule"]))
    doc = lambda d: F.concat(F.regexp_replace(F.concat(d["rule"], F.lit(". "), text(d["rationale"])), r"^[. ]+|[. ]+$", ""), F.lit("."))
    quote = lambda d: F.when(filled(d["quote"]), d["quote"]).otherwise(d["rule"])
    out = answers.withColumn("_use", usable)
    out = out.withColumn("_ok", F.filter("_use", lambda d: doc(d).contains(quote(d))))

    def cite(acc: Column, d: Column) -> Column:
        head, mark = F.substring(d["rule"], 1, 30), F.concat(F.lit(" [SOURCE: "), d["source"], F.lit("]"))
        at = F.position(head, acc)
        put = F.concat(F.substring(acc, F.lit(1), at - 1), head, mark, F.substring(acc, at + F.length(head), F.length(acc)))
        return F.when((at > 0) & ~acc.contains(mark), put).otherwise(acc)

    out = out.withColumn("_cited", F.aggregate("_ok", text(answer_col), cite))
    names = F.array_join(F.array_distinct(F.transform("_ok", lambda d: d["source"])), ", ")
    tail = F.when((F.size("_ok") > 0) & ~F.col("_cited").contains("[SOURCE:"), F.concat(F.lit("\n\n*Grounded by: "), names, F.lit("*"))).otherwise("")
    n = F.size("_use")
    return out.select(id_col, F.size("_ok").alias("verified"), (n - F.size("_ok")).alias("unverified"),
                      F.round(F.when(n > 0, F.size("_ok") / n).otherwise(0.0), 3).alias("confidence"),
                      F.concat(F.col("_cited"), tail).alias("grounded_text"))


def rows_as_text(df: DataFrame, key: str, columns: Sequence[str], fmt: str = "text") -> DataFrame:
    """One text per row: ``k: v`` lines or JSON."""
    if fmt == "json":
        return df.select(key, F.to_json(F.struct(*columns)).alias("text"))
    if fmt != "text":
        raise ValueError(f"unknown format {fmt!r} (want text or json)")
    lines = [F.concat(F.lit(f"{c}: "), text(c)) for c in columns]
    return df.select(key, F.concat_ws("\n", *lines).alias("text"))
