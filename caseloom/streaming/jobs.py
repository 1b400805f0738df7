"""Structured Streaming forms and their batch twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.patients import readiness_rule
from ..operators.runs import RUN_ENDS


def incremental_patients(patients: DataFrame, since: Column | None = None, as_of: Column | None = None, first_hours: int = 24,
                         ts: str = "updated") -> DataFrame:
    """Batch twin of a poll: rows changed after the last poll; the first poll
    looks back ``first_hours``. Latest version per patient."""
    start = since if since is not None else as_of - F.expr(f"INTERVAL {int(first_hours)} HOURS")
    rest = [c for c in patients.columns if c != "patient_id"]
    fresh = patients.filter(F.col(ts) > start)
    return fresh.groupBy("patient_id").agg(F.max_by(F.struct(*rest), ts).alias("_r")).select("patient_id", "_r.*")


def changed_patients(stream: DataFrame, delay: str = "1 hour", ts: str = "updated") -> DataFrame:
    """Streaming poll: the source's checkpoint remembers what was read, repeats
    of one version within the watermark are dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["patient_id", ts])


def route_ready(batch: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Ready rows for ingestion, and the remediation queue with issues."""
    checked = readiness_rule(batch)
    return checked.filter("ready").drop("issues", "ready"), checked.filter("not ready").select("patient_id", "issues", as_of.alias("queued_at"))


def route_writer(ready_path: str, queue_path: str, as_of: Column | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body. Each batch writes its own numbered folder, so a
    batch that is run again replaces its own output and nothing is doubled. The
    batch is kept for its two writes."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        ready, queue = route_ready(batch, as_of if as_of is not None else F.current_timestamp())
        ready.write.mode("overwrite").parquet(f"{ready_path}/epoch={epoch}")
        queue.write.mode("overwrite").parquet(f"{queue_path}/epoch={epoch}")
        batch.unpersist()

    return write


def ops_monitor(headers: DataFrame, window: str = "60 minutes", slide: str = "5 minutes", watermark: str | None = "10 minutes",
                queued: int = 1, error: int = 6) -> DataFrame:
    """Queue depth, errors, rate and latency per component in sliding event-time
    windows. A batch table is summed to buckets of one slide first, and only the
    buckets are copied to the windows they belong to; a stream has one stateful step."""
    ms = F.timestamp_diff("MILLISECOND", F.col("created"), F.col("processed"))
    first = [F.count(F.lit(1)).alias("total"), F.sum((F.col("status") == queued).cast("long")).alias("depth"),
             F.sum((F.col("status") == error).cast("long")).alias("errors"), F.sum(ms).alias("sum_ms"), F.count(ms).alias("n_ms"), F.max(ms).alias("max_ms")]
    component = F.col("target").alias("component")
    if headers.isStreaming:
        rows = headers.withWatermark("created", watermark) if watermark else headers
        out = rows.groupBy(F.window("created", window, slide).alias("w"), component).agg(*first)
    else:
        buckets = headers.groupBy(F.window("created", slide)["start"].alias("_at"), component).agg(*first)
        out = buckets.groupBy(F.window("_at", window, slide).alias("w"), "component").agg(
            *[F.sum(c).alias(c) for c in ("total", "depth", "errors", "sum_ms", "n_ms")], F.max("max_ms").alias("max_ms"))
    avg = F.when(F.col("n_ms") > 0, F.col("sum_ms") / F.col("n_ms"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "component", "total", "depth", "errors",
                      F.round(F.col("errors") / F.col("total") * 100, 1).alias("rate"), avg.alias("avg_ms"), "max_ms")


def window_bottlenecks(monitor: DataFrame, queue_limit: int = 20, rate_limit: float = 10.0) -> DataFrame:
    """Per window of ``ops_monitor``: the deepest component if all queues together
    hold more than ``queue_limit``, else the one of the worst error rate if that is
    above ``rate_limit`` per cent. The first component by name wins a tie."""
    worst = lambda c: F.min_by(F.struct("component", c), F.struct((-F.col(c)).alias("v"), "component"))
    per = monitor.groupBy("start").agg(F.sum("depth").alias("queued"), worst("depth").alias("d"), worst("rate").alias("r"))
    full = F.col("queued") > queue_limit
    errors = ~full & (F.col("r.rate") > rate_limit)
    return per.select("start", "queued", F.when(full, "backlog").when(errors, "errors").alias("kind"), F.when(full, F.col("d.component")).when(errors, F.col("r.component")).alias("component"))


def metric_windows(samples: DataFrame, window: str = "60 minutes", slide: str = "5 minutes", watermark: str | None = "10 minutes", min_n: int = 5) -> DataFrame:
    """Statistics of each metric per sliding window, from which samples are
    judged: mean, deviation, count, extreme z."""
    rows = samples.withWatermark("ts", watermark) if watermark and samples.isStreaming else samples
    out = rows.groupBy(F.window("ts", window, slide).alias("w"), "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    z = F.greatest(F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo")) / F.col("sd")
    return out.filter((F.col("n") >= min_n) & (F.col("sd") > 0)).select(
        F.col("w.start").alias("start"), "metric", "n", "mean", "sd", z.alias("max_z"))


def trend_windows(samples: DataFrame, window: str = "60 minutes", slide: str = "5 minutes", watermark: str = "10 minutes", min_n: int = 5, flat: float = 0.05, origin: str = "2024-01-01") -> DataFrame:
    """Level and trend of each metric per sliding window: n, mean, sd, the extreme z,
    and the least-squares slope per hour with its direction, which is "flat" up to
    ``flat`` of the mean. ``window`` must be a multiple of ``slide``.

    Samples are summed once, to panes of one slide, as n, sums of x, y, xx, xy, yy and
    the extremes, x in hours since ``origin`` (a time near the data, for the digits).
    Such sums add up, so a window is the sum of its panes and no sample is copied to
    the windows. On a stream both steps drop what the watermark has passed: state is
    one row per metric and open pane or window; use append mode."""
    rows = samples.withWatermark("ts", watermark) if samples.isStreaming else samples
    y = F.col("value").cast("double")
    x = (F.unix_micros("ts") - F.unix_micros(F.lit(origin).cast("timestamp"))) / 3.6e9
    moments = {"n": F.count(F.lit(1)), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "sxy": F.sum(x * y), "syy": F.sum(y * y), "hi": F.max(y), "lo": F.min(y)}
    rows = rows.filter(F.col("value").isNotNull())
    panes = rows.groupBy(F.window("ts", slide).alias("pane"), "metric").agg(*[m.alias(c) for c, m in moments.items()])
    out = panes.groupBy(F.window("pane", window, slide).alias("w"), "metric").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy")], F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    n, mean = F.col("n"), F.col("sy") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("syy") - F.col("sy") * mean, F.lit(0.0)) / (n - 1))
    spread = n * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(spread > 0, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / spread)
    out = out.filter(n >= max(min_n, 2)).select(F.col("w.start").alias("start"), "metric", "n", mean.alias("mean"), sd.alias("sd"), slope.alias("slope"), "hi", "lo").filter("sd > 0")
    trend = F.when(F.abs("slope") <= flat * F.abs("mean"), "flat").when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing")
    z = F.greatest(F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo")) / F.col("sd")
    return out.select("start", "metric", "n", "mean", "sd", z.alias("max_z"), "slope", F.coalesce(trend, F.lit("flat")).alias("trend"))


def assemble_traces_stream(spans: DataFrame, gap: str = "5 minutes", watermark: str = "5 minutes") -> DataFrame:
    """Trace rows from spans that arrive singly: a trace closes after ``gap``
    without a new span. ``spans`` needs an event time ``ts``."""
    root = F.when(F.coalesce("parent_span_id", F.lit("")) == "", F.struct("start_ns", "span_id"))
    return (spans.withWatermark("ts", watermark).groupBy("trace_id", F.session_window("ts", gap).alias("w")).agg(
        F.min_by("name", root).alias("root"), F.count(F.lit(1)).alias("n_spans"),
        ((F.max("end_ns") - F.min("start_ns")) / 1_000_000).alias("duration_ms"), F.max(F.col("status") == 2).alias("has_error"))
        .select("trace_id", "root", "n_spans", "duration_ms", "has_error"))


def expire_sessions_stream(calls: DataFrame, ttl: str = "24 hours", watermark: str = "0 seconds") -> DataFrame:
    """Sessions whose idle gap passed ``ttl`` in event time."""
    return (calls.withWatermark("ts", watermark).groupBy("session_id", F.session_window("ts", ttl).alias("w"))
            .agg(F.max("ts").alias("updated")).select("session_id", "updated"))


def replayed(log: Column) -> Column:
    """status, awaiting, decided_by, illegal after the (pos, type, tool, principal) of a run, as a struct."""
    none = F.lit(None).cast("string")
    state = lambda status, awaiting, by, illegal: F.struct(status.alias("status"), awaiting.alias("awaiting"), by.alias("decided_by"), illegal.alias("illegal"))
    ends = F.create_map(*[F.lit(v) for kv in RUN_ENDS.items() for v in kv])

    def step(s: Column, e: Column) -> Column:
        live = ~s["status"].isin(*RUN_ENDS.values())
        waiting = s["status"] == "awaiting_approval"
        decided = F.when(waiting, state(F.lit("running"), none, e["principal"], s["illegal"])).otherwise(state(s["status"], s["awaiting"], s["decided_by"], s["illegal"] + 1))
        return (F.when(e["type"] == "approval_decided", decided)
                .when(live & (e["type"] == "approval_requested"), state(F.lit("awaiting_approval"), e["tool"], s["decided_by"], s["illegal"]))
                .when(live & e["type"].isin(*RUN_ENDS), state(F.element_at(ends, e["type"]), none, s["decided_by"], s["illegal"])).otherwise(s))

    return F.aggregate(F.array_sort(log), state(F.lit("running"), none, none, F.lit(0).cast("long")), step)


def run_state_stream(events: DataFrame) -> DataFrame:
    """Current state of every run, updated as events arrive; use with update mode.

    A run's state is its requests, decisions and ends so far: a late event with a
    lower ``pos`` takes its place among them, so the result is that of the batch
    form whatever the order of arrival. Plain steps only make the run known; they
    are read batch by batch and not stored. Waiting runs have no time-out. State is an
    aggregate of Spark's, so a run costs a row and not a call of Python."""
    gate = F.col("type").isin("approval_requested", "approval_decided", *RUN_ENDS)
    event = F.struct(F.col("pos").cast("long").alias("pos"), "type", "tool", "principal")
    log = events.groupBy("run_id").agg(F.collect_list(F.when(gate, event)).alias("log"))
    return log.select("run_id", replayed(F.col("log")).alias("s")).select("run_id", "s.*")
