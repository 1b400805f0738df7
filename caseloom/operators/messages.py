"""Message-queue analytics and metric monitoring."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import filled, hex_id, last_piece
from ..session import written
from .ordering import running_index


def status_name(c: Column) -> Column:
    """The nine message status codes by name; anything else as ``Status:n``."""
    names = F.create_map(*[F.lit(v) for kv in fixed.MESSAGE_STATUS.items() for v in kv])
    return F.coalesce(F.try_element_at(names, c), F.concat(F.lit("Status:"), c.cast("string")))


def message_trace(headers: DataFrame, n: int = 20, source: str | None = None, target: str | None = None) -> DataFrame:
    """Newest ``n`` messages with a source, status decoded, last name pieces."""
    rows = headers.filter(filled("source"))
    if source:
        rows = rows.filter(F.col("source") == source)
    if target:
        rows = rows.filter(F.col("target") == target)
    return rows.orderBy(F.desc("id")).limit(n).select(
        "id", "created", last_piece("source").alias("src"), last_piece("target").alias("tgt"),
        last_piece("body_class").alias("cls"), status_name(F.col("status")).alias("status"))


def queue_depth(headers: DataFrame, queued: int = 1) -> DataFrame:
    return (headers.filter(F.col("status") == queued).groupBy(F.col("target").alias("component"))
            .agg(F.count(F.lit(1)).alias("depth")).orderBy(F.desc("depth"), "component"))


def _recent(headers: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    return headers.filter((F.col("created") > as_of - F.expr(f"INTERVAL {int(minutes)} MINUTES")) & (F.col("created") <= as_of))


def error_rate(headers: DataFrame, as_of: Column, minutes: int = 60, error_statuses: Iterable[int] = (6,)) -> DataFrame:
    bad = F.sum(F.col("status").isin(*error_statuses).cast("long"))
    return (_recent(headers, as_of, minutes).groupBy(F.col("target").alias("component"))
            .agg(bad.alias("errors"), F.count(F.lit(1)).alias("total"))
            .withColumn("rate", F.round(F.col("errors") / F.col("total") * 100, 1))
            .orderBy(F.desc("errors"), "component"))


def latency_stats(headers: DataFrame, as_of: Column, minutes: int = 60) -> DataFrame:
    ms = F.timestamp_diff("MILLISECOND", F.col("created"), F.col("processed"))
    return (_recent(headers, as_of, minutes).filter(F.col("processed").isNotNull())
            .groupBy(F.col("target").alias("component")).agg(F.avg(ms).alias("avg_ms"), F.max(ms).alias("max_ms"))
            .orderBy(F.desc("avg_ms"), "component"))


def bottleneck(depth: DataFrame, errors: DataFrame, queue_limit: int = 20, rate_limit: float = 10.0) -> DataFrame:
    """One verdict row. Both inputs go through one aggregation (no join)."""
    both = depth.select(F.lit("d").alias("k"), "component", F.col("depth").alias("a"), F.lit(0.0).alias("rate"),
                        F.lit(0).cast("long").alias("total")).unionByName(
        errors.select(F.lit("e").alias("k"), "component", F.col("errors").alias("a"), "rate", "total"))
    is_d, is_e = F.col("k") == "d", F.col("k") == "e"
    # deepest queue, and most errors, ties by smallest name: order by (-a, name)
    key = F.struct((-F.col("a")).alias("n"), F.col("component"))
    facts = both.agg(
        F.coalesce(F.sum(F.when(is_d, F.col("a"))), F.lit(0)).alias("queued"),
        F.min_by(F.struct("component", "a"), F.when(is_d, key)).alias("d"),
        F.min_by(F.struct("component", "a", "rate", "total"), F.when(is_e, key)).alias("e"))
    full = F.col("queued") > queue_limit
    failing = ~full & F.coalesce(F.col("e.rate") > rate_limit, F.lit(False))
    backlog = F.concat(F.lit("Message backlog detected — "), F.coalesce("d.component", F.lit("?")), F.lit(" queue depth "),
                       F.coalesce("d.a", F.lit(0)).cast("string"), F.lit("."))
    failed = F.concat(F.col("e.component"), F.lit(" error rate "), F.col("e.rate").cast("string"), F.lit("% ("),
                      F.col("e.a").cast("string"), F.lit("/"), F.col("e.total").cast("string"),
                      F.lit(" messages in the window)."))
    return facts.select(
        full.alias("pool_exhausted"), F.when(full, F.col("d.component")).when(failing, F.col("e.component")).alias("component"),
        F.when(full, "backlog").when(failing, "errors").otherwise("none").alias("kind"),
        F.when(full, backlog).when(failing, failed).otherwise("").alias("message"))


def message_spans(headers: DataFrame, system: str = "interop") -> DataFrame:
    """Header rows to receive/process/send spans by component kind
    (``kind`` column: service, process, operation)."""
    table = F.create_map(*[x for k, (p, o, s) in fixed.MESSAGE_SPAN_KINDS.items()
                           for x in (F.lit(k), F.struct(F.lit(p).alias("prefix"), F.lit(o).alias("op"), F.lit(s).alias("span_kind")))])
    info = F.try_element_at(table, F.col("kind"))
    start = F.unix_micros(F.col("created")) * 1000
    end = F.coalesce(F.unix_micros(F.col("processed")), F.unix_micros(F.col("created"))) * 1000
    attrs = F.create_map(F.lit("messaging.system"), F.lit(system), F.lit("messaging.destination"), F.col("target"),
                         F.lit("messaging.operation"), info["op"])
    return headers.filter(info.isNotNull()).select(
        hex_id(32, F.lit("trace"), "id").alias("trace_id"), hex_id(16, F.lit("span"), "id").alias("span_id"),
        F.concat(info["prefix"], last_piece("target")).alias("name"), info["span_kind"].alias("span_kind"),
        start.alias("start_ns"), end.alias("end_ns"),
        F.when(F.col("status").isin(4, 6), "Error").otherwise("Ok").alias("status"), attrs.alias("attributes"))


# --- metric samples --------------------------------------------------------------------


def zscore_anomalies(samples: DataFrame, z: float = 2.5, high: float = 3.5, min_n: int = 5) -> DataFrame:
    """Samples more than ``z`` sample deviations from their metric's mean.
    Statistics come from a map-side combined aggregate joined back (one row per
    metric), not from a window that would sort a hot metric in one task. Counted
    short, they are broadcast, so the samples themselves never shuffle."""
    stats = samples.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    stats = written(stats.filter((F.col("n") >= min_n) & (F.col("sd") > 0)), "metric-stats")
    score = F.abs((F.col("value") - F.col("mean")) / F.col("sd"))
    return (samples.join(stats, "metric").withColumn("_z", score).filter(F.col("_z") > z)
            .select("metric", "ts", "value", F.round("_z", 2).alias("z_score"),
                    F.when(F.col("_z") > high, "HIGH").otherwise("MEDIUM").alias("severity"), F.round("mean", 2).alias("mean")))


def linear_trends(samples: DataFrame, min_n: int = 10, tie: str = "sample_id", flat: float = 0.05) -> DataFrame:
    """Least-squares slope over the sample position of each metric; reported
    when it exceeds ``flat`` of the mean. ``threshold_periods`` keeps the
    described formula (half the mean over 60 slopes)."""
    indexed = running_index(samples, ["metric"], ["ts", tie])
    fit = indexed.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(F.col("value"), F.col("idx").cast("double")).alias("slope"),
        F.avg("value").alias("mean"))
    s, m = F.col("slope"), F.col("mean")
    periods = F.when((s > 0) & (m > 0), m * 0.5 / (s * 60))
    out = fit.filter((F.col("n") >= min_n) & (F.abs(s) > flat * m)).withColumn("_p", periods)
    return out.select(
        "metric", F.when(s > 0, "increasing").otherwise("decreasing").alias("direction"), F.round(s, 4).alias("slope"),
        F.round(m, 2).alias("mean"), F.round(s * 60, 2).alias("delta60"), F.round("_p", 1).alias("threshold_periods"),
        F.when(F.col("_p") < 7, "HIGH").when(F.col("_p") < 30, "MEDIUM").otherwise("LOW").alias("severity"))
