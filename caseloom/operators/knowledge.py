"""Knowledge layer: governing decisions, conflicting guidelines, note review."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import fixed
from ..functions.columns import filled, text
from ..session import written
from .graph import undirected
from .ordering import first_rows

#: Characters of the terms of one automaton, and of all terms that go to every task.
SHARD_CHARS, MOST_CHARS = 1 << 20, 1 << 24


def _grams(c: str, sizes: Sequence[int]) -> Column:
    """Distinct character grams of the given sizes."""
    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(c) - (n - 1))
        return F.when(F.length(c) >= n, F.transform(starts, lambda i: F.substring(F.col(c), i, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of_size(n) for n in sizes]))


def substring_join(terms: DataFrame, texts: DataFrame, gram: int = 3, shard_chars: int = SHARD_CHARS, most_chars: int = MOST_CHARS) -> DataFrame:
    """Exact pairs (term, id) where ``term`` occurs in ``text``, without comparing
    everything with everything. ``terms(term)``, ``texts(id, text)``.

    The distinct terms go into automata (Aho-Corasick) of up to ``shard_chars``
    characters, and every text runs through each of them once, in Arrow batches where
    it is read; no text is shuffled, and a term in a third of them costs no more than
    its pairs. Terms of more than ``most_chars`` characters in all are not sent to
    every task; they are found by a join on their rarest gram (``gram_join``)."""
    words = written(terms.select("term").filter(F.length("term") > 0).distinct(), "terms")
    size = words.agg(F.sum(F.length("term")).alias("n")).first()["n"] or 0
    if not size:
        return terms.select("term").join(texts.select("id"), F.lit(False))
    if size > most_chars:
        return gram_join(words, texts, gram)
    shards: list[list[str]] = [[]]
    held = 0
    for term in sorted(r["term"] for r in words.collect()):  # at most most_chars characters
        if held + len(term) > shard_chars and shards[-1]:
            shards.append([])
            held = 0
        shards[-1].append(term)
        held += len(term)
    found = [_occurrences(texts.select("id", "text"), shard) for shard in shards]
    return functools.reduce(DataFrame.unionByName, found).distinct()


def _occurrences(texts: DataFrame, terms: list[str]) -> DataFrame:
    """(term, id) of the terms in each text, once per text."""
    held = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, term in enumerate(held.value):
            automaton.add_word(term, i)
        automaton.make_automaton()
        names = pa.array(held.value, pa.string())
        for batch in batches:
            rows, which = [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    hits = {i for _, i in automaton.iter(t)}
                    rows += [r] * len(hits)
                    which += hits
            if rows:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(which)), batch.column(0).take(pa.array(rows))], ["term", "id"])

    return texts.mapInArrow(run, StructType([StructField("term", StringType()), texts.schema["id"]]))


def gram_join(terms: DataFrame, texts: DataFrame, gram: int = 3) -> DataFrame:
    """The pairs of ``substring_join`` for any number of terms.

    Every term must contain all its character grams, so it is enough to look it
    up by its *rarest* gram: an equi-join on that gram, then ``contains``. The
    texts are unnested to grams twice, once to count and once to match. The grams
    of the terms are written first, so the optimizer knows their bytes and decides
    between a broadcast and a shuffle."""
    words = terms.select("term").filter(F.length("term") > 0).distinct()
    words = words.withColumn("_n", F.least(F.length("term"), F.lit(gram)))
    sizes = [r["_n"] for r in words.groupBy("_n").agg(F.count(F.lit(1))).collect()]  # at most `gram` rows
    if not sizes:
        return terms.select("term").join(texts.select("id"), F.lit(False))
    options = written(words.select("term", "_n", F.explode_outer(_grams("term", sorted(sizes))).alias("g")).filter(F.length("g") == F.col("_n")), "term-grams")
    index = texts.select("id", "text", F.explode_outer(_grams("text", sorted(sizes))).alias("g"))
    freq = index.select("g").join(options.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.count(F.lit(1)).alias("_f"))
    rarest = written(options.join(freq, "g", "left").groupBy("term").agg(
        F.min_by("g", F.struct(F.coalesce("_f", F.lit(0)).alias("f"), F.col("g").alias("x"))).alias("g")), "rarest-grams")
    pairs = index.join(rarest, "g").filter(F.col("text").contains(F.col("term"))).select("term", "id")
    return pairs.distinct()


def concept_matches(terms: DataFrame, concepts: DataFrame) -> DataFrame:
    """(term, concept id) pairs on id, name or any alias, case-insensitive."""
    strings = concepts.select("id", F.explode_outer(F.concat(F.array("id", "name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("t"))
    return substring_join(terms.select(F.lower("term").alias("term")), strings.select("id", F.lower("t").alias("text")))


def knowledge_context(terms: DataFrame, concepts: DataFrame, decisions: DataFrame, limit: int | None = None) -> DataFrame:
    """Governing decisions of every concept a term names; a term that names none
    gives one row with ``found`` false. With a ``limit`` the first rows per term,
    and how many more there are; each concept's decisions are cut before the join.
    The rows found are not shuffled by term."""
    hits = written(concept_matches(terms, concepts).withColumnRenamed("id", "concept_id"), "matches")  # read twice
    facts = decisions.select("concept_id", F.col("id").alias("decision_id"), "rule", "source", "rationale", "effective_date")
    asked = terms.select(F.lower("term").alias("term")).distinct()
    if limit is None:
        rows = hits.join(facts, "concept_id", "left").withColumn("n_more", F.lit(0).cast("long"))
    else:
        per = decisions.groupBy("concept_id").agg(F.count(F.lit(1)).alias("_d"))
        all_of = hits.join(per, "concept_id", "left").groupBy("term").agg(F.sum(F.coalesce("_d", F.lit(1))).alias("_n"))
        rows = hits.join(first_rows(facts, ["concept_id"], ["decision_id"], limit).drop("rank"), "concept_id", "left")
        rows = first_rows(rows, ["term"], ["concept_id", F.asc_nulls_first("decision_id")], limit).drop("rank")
        rows = rows.join(all_of, "term").withColumn("n_more", F.greatest(F.col("_n") - limit, F.lit(0))).drop("_n")
    # rows carry asked terms alone, so they are not moved to meet them; only terms without a hit are added
    missed = asked.join(hits.select("term").distinct(), "term", "left_anti")
    rows = rows.select("term", *[c for c in rows.columns if c != "term"])
    return rows.unionByName(missed, allowMissingColumns=True).withColumn("found", F.col("concept_id").isNotNull())


def contradiction_gate(terms: DataFrame, concepts: DataFrame, contradictions: DataFrame, limit: int = 20) -> DataFrame:
    """Is a term blocked by unresolved contradictions? Counts all of them, lists
    the first ``limit`` and says how many more there are. Counts are taken per concept,
    below the join with the terms that name it. The first rows of a term lie in the
    ``limit`` concepts whose own first rows come first, so only those are opened."""
    open_ = contradictions.filter(F.col("status") == "UNRESOLVED").select(
        "concept_id", F.col("id").alias("ct_id"), "statement_a", "source_a", "statement_b", "source_b", "owner")
    matches = written(concept_matches(terms, concepts).withColumnRenamed("id", "concept_id"), "matches")  # read twice
    per = open_.groupBy("concept_id").agg(F.count(F.lit(1)).alias("_n"))
    counts = matches.join(per, "concept_id").groupBy("term").agg(F.sum("_n").alias("unresolved_count"))
    first = matches.join(open_.groupBy("concept_id").agg(F.min(F.struct("ct_id")).alias("_first")), "concept_id")
    near = written(first_rows(first, ["term"], ["_first", "concept_id"], limit).select("term", "concept_id"), "first-concepts")
    few = first_rows(open_.join(near.select("concept_id").distinct(), "concept_id", "left_semi"), ["concept_id"], ["ct_id"], limit).drop("rank")
    shown = first_rows(near.join(few, "concept_id"), ["term"], ["ct_id"], limit).groupBy("term").agg(
        F.sort_array(F.collect_list(F.struct("ct_id", "statement_a", "source_a", "statement_b", "source_b", "owner"))).alias("detail"))
    asked = terms.select(F.lower("term").alias("term")).distinct()
    out = asked.join(counts, "term", "left").join(shown, "term", "left")
    n = F.coalesce("unresolved_count", F.lit(0))
    message = F.when(n > 0, F.concat(F.lit("BLOCKED: "), n.cast("string"), F.lit(" unresolved guideline contradiction(s) found for '"),
                                     F.col("term"), F.lit("'."))).otherwise(
        F.concat(F.lit("NO_CONTRADICTIONS: Safe to cite protocols for '"), F.col("term"), F.lit("'.")))
    return out.select("term", (n > 0).alias("blocked"), n.alias("unresolved_count"), "detail", F.greatest(n - limit, F.lit(0)).alias("n_more"), message.alias("message"))


def gate_recommendations(recs: DataFrame, gate: DataFrame) -> DataFrame:
    """Withhold recommendations whose concept is blocked; keep the reason."""
    g = gate.select(F.col("term").alias("concept"), "blocked", "message")
    out = recs.withColumn("concept", F.lower("concept")).join(g, "concept", "left")
    blocked = F.coalesce("blocked", F.lit(False))
    return out.select("rec_id", "concept", (~blocked).alias("allowed"), F.when(blocked, F.col("message")).otherwise("").alias("reason"))


def related_evidence(terms: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Nodes named by a term (id with underscores, or name) and their one-hop
    undirected neighbours; with a ``limit`` the first rows per term, and how many
    more there are. One substring join serves ids and names. The first rows of a
    term are among the first rows of its nodes, so edge lists are cut before the join."""
    asked = terms.select(F.lower("term").alias("term")).distinct()
    probes = asked.select("term", F.explode_outer(F.array(
        F.struct(F.lit("name").alias("kind"), F.col("term").alias("probe")),
        F.struct(F.lit("id").alias("kind"), F.replace("term", F.lit(" "), F.lit("_")).alias("probe")))).alias("p")).select("term", "p.*")
    strings = nodes.select(F.explode_outer(F.array(
        F.struct(F.struct(F.lit("name").alias("kind"), "id").alias("id"), F.lower(text("name")).alias("text")),
        F.struct(F.struct(F.lit("id").alias("kind"), "id").alias("id"), F.lower("id").alias("text")))).alias("s")).select("s.*")
    found = substring_join(probes.select(F.col("probe").alias("term")), strings).select(F.col("term").alias("probe"), "id.kind", F.col("id.id").alias("id"))
    hits = written(found.join(probes, ["probe", "kind"]).select("term", "id").distinct(), "hits")
    links = undirected(edges).select(F.col("src").alias("id"), F.col("pred").alias("relationship"), F.col("dst").alias("related")).distinct()
    if limit is None:
        # a link gets its name before it meets the terms, which make several rows of it
        called = links.join(hits.select("id").distinct(), "id", "left_semi").join(nodes.select(F.col("id").alias("related"), "name"), "related", "left")
        named = hits.join(called, "id").withColumn("n_more", F.lit(0).cast("long")).withColumnRenamed("id", "concept")
    else:
        degree = links.groupBy("id").agg(F.count(F.lit(1)).alias("_d"))
        all_of = hits.join(degree, "id").groupBy("term").agg(F.sum("_d").alias("_n"))
        few = first_rows(links, ["id"], ["relationship", "related"], limit).drop("rank")
        top = first_rows(hits.join(few, "id"), ["term"], ["id", "relationship", "related"], limit).drop("rank").join(all_of, "term")
        top = top.withColumn("n_more", F.greatest(F.col("_n") - limit, F.lit(0)))
        named = top.withColumnRenamed("id", "concept").join(nodes.select(F.col("id").alias("related"), "name"), "related", "left")
    return named.select("term", "concept", "relationship", "related", F.when(filled("name"), F.col("name")).otherwise(F.col("related")).alias("name"), "n_more")


def contradiction_subgraph(contradictions: DataFrame, concepts: DataFrame, decisions: DataFrame) -> DataFrame:
    """contradiction → concept ← decision."""
    c = concepts.select(F.col("id").alias("concept_id"))
    return (contradictions.select(F.col("id").alias("contradiction_id"), "concept_id").join(c, "concept_id")
            .join(decisions.select("concept_id", F.col("id").alias("decision_id")), "concept_id")
            .select("contradiction_id", "concept_id", "decision_id"))


def provenance_trail(edges: DataFrame, props: DataFrame) -> DataFrame:
    """agent −AUTHORED_KB→ article ←SOURCED_KB− ticket, with article properties."""
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("val"))).alias(k)
    facts = props.filter(F.col("key").isin("article_id", "category", "generated_at")).groupBy(F.col("id").alias("article")).agg(
        value("article_id"), value("category"), value("generated_at"))
    authored = edges.filter(F.col("pred") == "AUTHORED_KB").select(F.col("src").alias("agent"), F.col("dst").alias("article"))
    sourced = edges.filter(F.col("pred") == "SOURCED_KB").select(F.col("dst").alias("article"), F.col("src").alias("ticket"))
    return authored.join(facts, "article", "left").join(sourced, "article", "left").select(
        "agent", "article_id", "category", "generated_at", "ticket")


def note_graph_diff(notes: DataFrame, graph: DataFrame, transitions: Sequence[tuple[str, str]] = tuple(fixed.STATUS_TRANSITIONS)) -> DataFrame:
    """Human edits against the graph: unchanged notes are skipped, a status
    change outside the allowed transitions is REJECTED, the rest are UPDATEs."""
    g = graph.select("id", F.col("status").alias("g_status"), text("resolved_by").alias("g_by"),
                     text("resolution_rationale").alias("g_why"))
    rows = notes.filter(filled("id")).join(g, "id", "left")
    n_status, g_status = F.coalesce("status", F.lit("UNRESOLVED")), F.coalesce("g_status", F.lit("UNRESOLVED"))
    by, why = F.trim(text("resolved_by")), F.trim(text("resolution_rationale"))
    g_by, g_why = F.trim(text("g_by")), F.trim(text("g_why"))
    moved = n_status != g_status
    changed = moved | ((by != "") & (by != g_by)) | ((why != "") & (why != g_why))
    allowed = F.concat_ws(">", g_status, n_status).isin(*[f"{a}>{b}" for a, b in transitions])
    rejected = moved & ~allowed
    keep = lambda a, b: F.when(~rejected, F.when(a != "", a).otherwise(b))
    return rows.filter(changed).select(
        "id", F.when(rejected, "REJECTED").otherwise("UPDATE").alias("action"), F.when(~rejected, n_status).alias("new_status"),
        keep(by, g_by).alias("new_resolved_by"), keep(why, g_why).alias("new_rationale"),
        F.when(rejected, F.concat(F.lit("Invalid transition "), g_status, F.lit(" → "), n_status)).alias("reason"))
