"""Runs, approvals, audit and sessions from event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import text
from .access import action_permissions
from .ordering import last_before

RUN_ENDS = {"run_succeeded": "succeeded", "run_failed": "failed", "run_cancelled": "cancelled"}


def run_state(events: DataFrame) -> DataFrame:
    """Current state of every run. ``events(run_id, pos, type, tool, principal)``,
    ``pos`` ascending and unique per run. The first ending event is final. A
    decision counts only while a request is open: the latest earlier request or
    decision must be a request. Others are counted as ``illegal``."""
    is_end = F.col("type").isin(*RUN_ENDS)
    ends = events.filter(is_end).groupBy("run_id").agg(F.min("pos").alias("_end"), F.min_by("type", "pos").alias("_how"))
    gates = events.filter(F.col("type").isin("approval_requested", "approval_decided")).join(ends, "run_id", "left")
    live = F.col("_end").isNull() | (F.col("pos") < F.col("_end"))
    late = gates.filter(~live).groupBy("run_id").agg(F.sum((F.col("type") == "approval_decided").cast("long")).alias("_late"))
    seen = last_before(gates.filter(live).drop("_end", "_how"), ["run_id"], ["pos"], F.col("type"), "_prev")
    legal = (F.col("type") == "approval_decided") & F.coalesce(F.col("_prev") == "approval_requested", F.lit(False))
    wrong = (F.col("type") == "approval_decided") & ~legal
    state = seen.groupBy("run_id").agg(
        F.max_by("type", "pos").alias("_last"), F.max_by("tool", F.when(F.col("type") == "approval_requested", F.col("pos"))).alias("_tool"),
        F.max(F.when(F.col("type") == "approval_requested", F.col("pos"))).alias("_asked"),
        F.max_by("principal", F.when(legal, F.col("pos"))).alias("decided_by"), F.sum(wrong.cast("long")).alias("_bad"))
    runs = events.groupBy("run_id").agg(F.min_by("principal", "pos").alias("requester"), F.count(F.lit(1)).alias("n_events"),
                                        F.sum((F.col("type") == "step").cast("long")).alias("n_steps"))
    out = runs.join(ends, "run_id", "left").join(state, "run_id", "left").join(late, "run_id", "left")
    how = F.create_map(*[F.lit(v) for kv in RUN_ENDS.items() for v in kv])
    waiting = F.col("_how").isNull() & F.coalesce(F.col("_last") == "approval_requested", F.lit(False))
    status = F.when(F.col("_how").isNotNull(), F.element_at(how, F.col("_how"))).when(waiting, "awaiting_approval").otherwise("running")
    return out.select("run_id", "requester", status.alias("status"), F.when(waiting, F.col("_tool")).alias("awaiting"),
                      F.when(waiting, F.col("_asked")).alias("asked_pos"), "decided_by",
                      (F.coalesce("_bad", F.lit(0)) + F.coalesce("_late", F.lit(0))).alias("illegal"), "n_events", "n_steps")


def approval_queue(states: DataFrame, principals: DataFrame, as_of_pos: Column | None = None, allow_self: bool = False) -> DataFrame:
    """Runs waiting for a decision and how many others may decide. The requester
    may not approve their own run, so the count is taken, not every pair."""
    can = action_permissions(principals).filter((F.col("action") == "approve") & F.col("allowed")).select("principal")
    total = can.count()
    mine = can.select(F.col("principal").alias("requester"), F.lit(1).alias("_self"))
    rows = states.filter(F.col("status") == "awaiting_approval").join(mine, "requester", "left")
    eligible = F.lit(total) - (F.lit(0) if allow_self else F.coalesce("_self", F.lit(0)))
    out = rows.select("run_id", F.col("awaiting").alias("tool"), "requester", "asked_pos", eligible.alias("eligible_approvers"))
    return out.withColumn("age", as_of_pos - F.col("asked_pos")) if as_of_pos is not None else out


def retain_latest(df: DataFrame, limit: int, order: list[str], state: str | None = None) -> DataFrame:
    """Newest ``limit`` rows. With a ``state`` column only rows in a terminal
    state may be evicted: open rows always stay and the newest terminal rows
    fill what is left."""
    newest = [F.desc(c) for c in order]
    if state is None:
        return df.orderBy(*newest).limit(limit)
    ended = F.coalesce(F.col(state).isin(*fixed.TERMINAL_STATES), F.lit(False))
    open_ = df.filter(~ended)
    room = max(0, limit - open_.count())
    return open_.unionByName(df.filter(ended).orderBy(*newest).limit(room))


def session_usage(calls: DataFrame) -> DataFrame:
    """Calls, estimated tokens, sub-calls and last update per session.
    ``calls(session_id, ts, output, is_subcall)``."""
    est = F.greatest(F.lit(1), F.floor(F.length(text("output")) / 4))
    return calls.groupBy("session_id").agg(
        F.sum((~F.col("is_subcall")).cast("long")).alias("iterations"), F.sum(est).alias("tokens"),
        F.sum(F.col("is_subcall").cast("long")).alias("subcalls"), F.max("ts").alias("updated"))


def expire_sessions(sessions: DataFrame, as_of: Column, ttl: int = 86400) -> DataFrame:
    """Sessions idle for longer than ``ttl`` seconds. ``sessions(session_id, ts)``."""
    last = sessions.groupBy("session_id").agg(F.max("ts").alias("updated"))
    idle = F.unix_micros(as_of) - F.unix_micros(F.col("updated"))
    return last.select("session_id", "updated", (idle > ttl * 1_000_000).alias("expired"))


def audit_rollup(audit: DataFrame) -> DataFrame:
    """Calls, ok rate and mean milliseconds by principal, tool and backend."""
    return audit.groupBy("principal", "tool", "backend").agg(
        F.count(F.lit(1)).alias("calls"), F.avg(F.col("ok").cast("double")).alias("ok_rate"), F.avg("elapsed_ms").alias("avg_ms"))


def audit_cube(audit: DataFrame) -> DataFrame:
    """The same measures for every combination of principal, tool and backend;
    ``level`` tells a total's NULL from a value's: one bit per column summed over."""
    return audit.cube("principal", "tool", "backend").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("calls"), F.avg(F.col("ok").cast("double")).alias("ok_rate"), F.avg("elapsed_ms").alias("avg_ms"))


def run_summary(states: DataFrame) -> DataFrame:
    """Requester, status, number of steps and decider of each run."""
    return states.select("run_id", "requester", "status", "n_steps", text("decided_by").alias("decider"))
