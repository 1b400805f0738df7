"""Support-ticket mining: completeness, coverage, anchors, gates, article context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cut, filled, text
from .ordering import first_rows


def completeness(score_of: dict[str, int] | None = None) -> Column:
    """0-100 score: summary 20, problem 30, solution 35, category 10, status 5."""
    weights = score_of or {"summary": 20, "problem": 30, "solution": 35, "category": 10, "status": 5}
    return sum((F.when(filled(c), w).otherwise(0) for c, w in weights.items()), F.lit(0))


def tier_of(score: Column) -> Column:
    return F.when(score >= 80, "HIGH").when(score >= 50, "MEDIUM").otherwise("LOW")


def completeness_score(tickets: DataFrame) -> DataFrame:
    return tickets.select("ticket_id", completeness().alias("score"), "category", "status").withColumn(
        "tier", tier_of(F.col("score")))


def search_tickets_keyword(tickets: DataFrame, query: str, k: int = 8, summary_cut: int | None = None) -> DataFrame:
    """First query word in summary or problem, or the whole query as category;
    solved first, then id."""
    word = query.split(" ")[0].lower()
    hit = (F.lower("summary").contains(word) | F.lower("problem").contains(word)
           | (F.upper("category") == query.upper()))
    top = (tickets.filter(hit)
           .select("ticket_id", "category", "has_solution", cut("summary", summary_cut).alias("summary"))
           .orderBy(F.desc("has_solution"), "ticket_id").limit(k))
    return first_rows(top, [F.lit(1)], [F.desc("has_solution"), "ticket_id"], k)


def category_coverage(tickets: DataFrame) -> DataFrame:
    solved = F.sum(F.col("has_solution").cast("long"))
    return (tickets.groupBy("category")
            .agg(F.count(F.lit(1)).alias("total"), solved.alias("resolved"))
            .withColumn("pct", F.round(F.col("resolved") / F.col("total") * 100, 0))
            .orderBy(F.desc("total"), "category"))


def gap_report(tickets: DataFrame) -> DataFrame:
    """Unresolved share per category plus a TOTAL row, from one rollup."""
    return (tickets.rollup("category")
            .agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("has_solution").cast("long")).alias("solved"),
                 F.grouping("category").alias("_g"))
            .select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("category")).alias("category"), "total", "solved",
                    F.round((1 - F.col("solved") / F.col("total")) * 100, 0).alias("gap_pct"),
                    (F.col("_g") == 1).alias("is_total")))


def top_n_per_category(tickets: DataFrame, n_solved: int = 4, n_open: int = 3, key: str = "category") -> DataFrame:
    """First solved and first open tickets of each key, by id."""
    ranked = first_rows(tickets.withColumn("kind", F.when(F.col("has_solution"), "solved").otherwise("open")),
                        [key, "kind"], ["ticket_id"], max(n_solved, n_open))
    return ranked.filter(F.col("rank") <= F.when(F.col("kind") == "solved", n_solved).otherwise(n_open))


def cluster_summary(tickets: DataFrame, key: str = "category", n_solved: int = 4, n_open: int = 3, anchor_cut: int | None = None,
                    open_cut: int | None = None, fix_cut: int | None = None) -> DataFrame:
    """Counts plus the first resolved anchors and open candidates per key; how many
    more there are follows from the counts."""
    totals = tickets.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("has_solution").cast("long")).alias("resolved"))
    few = top_n_per_category(tickets, n_solved, n_open, key)
    line = F.struct("rank", "ticket_id",
                    cut("summary", anchor_cut).alias("anchor"), cut("summary", open_cut).alias("open"),
                    cut("solution", fix_cut).alias("fix"))
    picked = few.groupBy(key).agg(  # n_solved + n_open rows per key
        F.sort_array(F.collect_list(F.when(F.col("kind") == "solved", line))).alias("_a"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "open", line))).alias("_o"))
    anchors = F.transform("_a", lambda r: F.struct(r["ticket_id"].alias("ticket_id"), r["anchor"].alias("summary"),
                                                   r["fix"].alias("fix")))
    unresolved = F.transform("_o", lambda r: F.struct(r["ticket_id"].alias("ticket_id"), r["open"].alias("summary")))
    return (totals.join(picked, key, "left")
            .select(key, "total", "resolved", F.round(F.col("resolved") / F.col("total") * 100, 0).alias("pct"),
                    anchors.alias("anchors"), unresolved.alias("unresolved")))


def article_context(tickets: DataFrame, n: int = 5, n_open: int = 0, solved_cut: int | None = None, open_cut: int | None = None) -> DataFrame:
    """Prompt text per category from its first solved (and open) tickets."""
    few = top_n_per_category(tickets, n, n_open)
    solved = F.concat(F.lit("Ticket "), F.col("ticket_id"), F.lit(":\nProblem: "), cut(text("problem"), solved_cut),
                      F.lit("\nResolution: "), cut(text("solution"), solved_cut))
    still = F.concat(F.lit("Ticket "), F.col("ticket_id"), F.lit(" (unresolved):\nProblem: "),
                     cut(text("problem"), open_cut))
    block = F.when(F.col("kind") == "solved", solved).otherwise(still)
    return (few.select("category", "kind", "rank", block.alias("block"))
            .groupBy("category")
            .agg(F.sum(F.when(F.col("kind") == "solved", 1).otherwise(0)).alias("n_sources"),
                 F.sort_array(F.collect_list(F.struct((F.col("kind") == "open").alias("o"), "rank", "block"))).alias("_b"))
            .filter(F.col("n_sources") > 0)
            .select("category", "n_sources",
                    F.array_join(F.transform("_b", lambda r: r["block"]), "\n\n").alias("context")))


def cluster_profile(df: DataFrame, top: int = 3) -> DataFrame:
    """Size, dominant categories and solved count per cluster; -1 is noise."""
    counts = df.groupBy("cluster", "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("has_solution").cast("long")).alias("s"))
    totals = counts.groupBy("cluster").agg(F.sum("n").alias("size"), F.sum("s").alias("n_solved"))
    leaders = (first_rows(counts, ["cluster"], [F.desc("n"), "category"], top)
               .groupBy("cluster")
               .agg(F.min_by("category", "rank").alias("dominant"),
                    F.sort_array(F.collect_list(F.struct("rank", "category", "n"))).alias("_t")))
    top3 = F.array_join(F.transform("_t", lambda r: F.concat(r["category"], F.lit("="), r["n"].cast("string"))), ",")
    profile = totals.join(leaders, "cluster").select(
        "cluster", "size", "dominant", "n_solved", top3.alias("top3"), (F.col("cluster") == -1).alias("is_noise"))
    # one row per cluster from here on; only the three largest carry a rank
    largest = first_rows(profile.filter(~F.col("is_noise")), [F.lit(1)], [F.desc("size"), "cluster"], 3, "size_rank")
    return profile.join(largest.select("cluster", "size_rank"), "cluster", "left")


def cluster_gate(df: DataFrame, sample: int | None = None, largest: int | None = None) -> DataFrame:
    """Completeness gate: all tickets of all clusters but noise are scored, and the
    best ready cluster by mean score is marked. A caller may ask for the first
    ``sample`` tickets by id, or for the ``largest`` clusters only."""
    rows = df.filter(F.col("cluster") != -1)
    scored = first_rows(rows, ["cluster"], ["ticket_id"], sample) if sample else rows
    scored = scored.withColumn("score", completeness()).withColumn("tier", tier_of(F.col("score")))
    high = F.avg((F.col("tier") == "HIGH").cast("int"))
    some = F.avg(F.col("tier").isin("HIGH", "MEDIUM").cast("int"))
    gate = scored.groupBy("cluster").agg(F.avg("score").alias("avg_score"), high.alias("_h"), some.alias("_m"), F.count(F.lit(1)).alias("size"))
    if sample:
        gate = gate.drop("size").join(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster")
    if largest:
        gate = gate.orderBy(F.desc("size"), "cluster").limit(largest)
    gate = gate.withColumn("tier", F.when(F.col("_h") > 0.5, "HIGH").when(F.col("_m") > 0.4, "MEDIUM").otherwise("LOW"))
    gate = gate.withColumn("ready", F.col("tier").isin("HIGH", "MEDIUM"))
    # the best of all by one combined maximum, joined back
    place = F.struct("ready", "avg_score", "size", (-F.col("cluster")).alias("c"))
    best = gate.agg(F.max_by("cluster", place).alias("_best"))
    return gate.select("cluster", "avg_score", "tier", "ready", ((F.col("cluster") == best.scalar()) & F.col("ready")).alias("is_best"))


def enrich_hits(hits: DataFrame, tickets: DataFrame, prefix: str = "pc_ticket:", summary_cut: int | None = None) -> DataFrame:
    """Category and summary for ranked ids; "?" where the ticket is unknown."""
    ids = hits.withColumn("id", F.when(F.col("id").startswith(prefix), F.substring("id", F.lit(len(prefix) + 1), F.length("id")))
                          .otherwise(F.col("id")))
    facts = tickets.select(F.col("ticket_id").alias("id"), "category", cut(text("summary"), summary_cut).alias("summary"))
    return ids.join(facts, "id", "left").withColumn(
        "category", F.coalesce(F.nullif("category", F.lit("")), F.lit("?"))).withColumn("summary", text("summary"))


def slug_of(category: Column) -> Column:
    return F.lower(F.replace(category, F.lit(" "), F.lit("_")))


def coverage_gaps(tickets: DataFrame, wiki: DataFrame) -> DataFrame:
    """Categories that have no page, with their resolution rate."""
    pages = wiki.select(F.regexp_replace("file", r"\.md$", "").alias("_slug")).distinct()
    cover = category_coverage(tickets)
    return cover.join(pages, slug_of(F.col("category")) == F.col("_slug"), "left_anti")


def top_k(df: DataFrame, order: list, n: int) -> DataFrame:
    """``TOP n`` with a total order: TakeOrderedAndProject, no full sort."""
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int, id_col: str, by: list[str] | None = None) -> DataFrame:
    """Reproducible sample of ``n`` rows (per key): smallest hash of (id, seed)."""
    draw = F.sha2(F.concat_ws("#", F.col(id_col).cast("string"), F.lit(str(seed))), 256)
    if by:
        return first_rows(df.withColumn("_draw", draw), by, ["_draw", id_col], n).drop("_draw", "rank")
    return df.withColumn("_draw", draw).orderBy("_draw", id_col).limit(n).drop("_draw")


def set_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).subtract(b.select(*keys))


def set_intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def union_unique(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows of both; where a key is in both, the row of ``a`` stays."""
    both = a.withColumn("_o", F.lit(0)).unionByName(b.withColumn("_o", F.lit(1)))
    rest = [c for c in a.columns if c not in keys]
    if not rest:
        return both.select(*keys).distinct()
    return both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_o", *rest)).alias("_r")).select(*keys, "_r.*")
