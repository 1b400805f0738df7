"""Trace spans: building, linking and ordering them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

from ..functions import fixed
from ..functions.columns import cut, filled, hex_id, text
from ..session import written
from .ordering import last_before

#: Spans up to which a trace is worked out in one task.
LARGE_TRACE = 20_000


def _attributes(pairs: dict[str, Column]) -> Column:
    """Attribute map without the entries whose value is missing."""
    full = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(full, lambda k, v: v.isNotNull() & (v != ""))


def tool_spans(calls: DataFrame, system: str = "caseloom", output_cut: int | None = None, error_cut: int | None = None) -> DataFrame:
    """Tool calls to spans: ``calls(call_id, trace_id, parent_span_id, session_id,
    tool, input, output, error, denied, end_ns, duration_ms)``. Only status 2
    means error; a denied call has no duration."""
    bad = filled("error") | F.col("denied")
    start = F.col("end_ns") - F.when(F.col("denied"), 0).otherwise(F.col("duration_ms") * 1_000_000)
    attrs = _attributes({
        "gen_ai.operation.name": F.lit("tool_call"), "gen_ai.tool.name": F.col("tool"), "gen_ai.system": F.lit(system),
        "gen_ai.tool.call_id": F.col("call_id"), "session.id": F.col("session_id"), "gen_ai.tool.input": F.col("input"),
        "gen_ai.tool.output": F.when(~F.col("denied"), cut(text("output"), output_cut)),
        "gen_ai.tool.error": cut(text("error"), error_cut), "gen_ai.tool.denied": F.when(F.col("denied"), "true")})
    return calls.select(
        "trace_id", hex_id(16, F.lit("tool"), "trace_id", "call_id").alias("span_id"), "parent_span_id",
        F.concat(F.lit("execute_tool "), F.col("tool")).alias("name"), start.alias("start_ns"), "end_ns",
        F.when(bad, 2).otherwise(0).alias("status"), attrs.alias("attributes"))


def chat_spans(calls: DataFrame, capture: bool = False, system: str = "caseloom") -> DataFrame:
    """Model calls to ``gen_ai.chat`` spans: ``calls(call_id, trace_id,
    parent_span_id, session_id, model, input_tokens, output_tokens, completion,
    start_ns, end_ns)``. Content becomes an event only when capture is on."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    attrs = _attributes({
        "gen_ai.operation.name": F.lit("chat"), "gen_ai.system": F.lit(system),
        "gen_ai.usage.input_tokens": positive("input_tokens"), "gen_ai.usage.output_tokens": positive("output_tokens"),
        "gen_ai.request.model": F.col("model"), "session.id": F.col("session_id")})
    event = F.array(F.struct(F.lit("gen_ai.completion").alias("name"), F.col("completion").alias("content")))
    none = F.array().cast("array<struct<name:string,content:string>>")
    return calls.select(
        "trace_id", hex_id(16, F.lit("chat"), "trace_id", "call_id").alias("span_id"), "parent_span_id",
        F.lit("gen_ai.chat").alias("name"), "start_ns", "end_ns", F.lit(0).alias("status"), attrs.alias("attributes"),
        F.when(F.lit(capture) & filled("completion"), event).otherwise(none).alias("events"))


def turn_spans(turns: DataFrame, capture: bool = False, query_cut: int | None = None) -> DataFrame:
    """Root ``gen_ai.agent_turn`` spans: ``turns(turn_id, trace_id, query, start_ns, end_ns)``."""
    attrs = _attributes({"gen_ai.operation.name": F.lit("agent_turn"),
                         "gen_ai.input.query": F.when(F.lit(capture), cut(text("query"), query_cut))})
    return turns.select("trace_id", hex_id(16, F.lit("turn"), "trace_id", "turn_id").alias("span_id"),
                        F.lit(None).cast("string").alias("parent_span_id"), F.lit("gen_ai.agent_turn").alias("name"),
                        "start_ns", "end_ns", F.lit(0).alias("status"), attrs.alias("attributes"))


def link_parents(spans: DataFrame) -> DataFrame:
    """Tool spans take the latest earlier chat span of their trace as parent."""
    chat = F.when(F.col("name") == "gen_ai.chat", F.col("span_id"))
    linked = last_before(spans, ["trace_id"], ["start_ns", "span_id"], chat, "_chat")
    is_tool = F.col("name").startswith("execute_tool")
    return linked.withColumn("parent_span_id", F.when(is_tool, F.coalesce("_chat", "parent_span_id")).otherwise(F.col("parent_span_id"))).drop("_chat")


def _forest(trace: pa.Array, span: pa.Array, parent: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parent rows (-1 for roots), depth, place in depth-first order and cycle marks
    of whole traces, whose rows come in order of (trace, start, span)."""
    ids = pc.binary_join_element_wise(trace, span, "\0")
    up = pc.fill_null(pc.index_in(pc.binary_join_element_wise(trace, parent, "\0"), value_set=ids), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(up)
    at = up.copy()
    for _ in range(n.bit_length()):  # after n steps only what hangs on a circle still has a way to go, and it ends on the circle
        at = np.where(at >= 0, at[at], -1)
    cycle = np.zeros(n, bool)
    cycle[at[at >= 0]] = True
    up[cycle] = -1
    depth, at = (up >= 0).astype(np.int64), up.copy()
    while (at >= 0).any():
        depth += np.where(at >= 0, depth[at], 0)
        at = np.where(at >= 0, at[at], -1)
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.cumsum(np.bincount(depth))[:-1]) if n else []
    size = np.ones(n, np.int64)
    for rows in reversed(levels[1:]):
        np.add.at(size, up[rows], size[rows])
    traces = np.cumsum(np.concatenate([[0], pc.not_equal(trace[1:], trace[:-1]).to_numpy(zero_copy_only=False)])) if n else up
    family = np.where(up >= 0, up, n + traces)  # the roots of a trace are siblings
    order = np.argsort(family, kind="stable")
    total = np.cumsum(size[order]) - size[order]
    first = np.concatenate([[True], family[order][1:] != family[order][:-1]]) if n else np.zeros(0, bool)
    before = np.empty(n, np.int64)
    before[order] = total - np.maximum.accumulate(np.where(first, total, 0)) if n else total
    seq = before.copy()
    for rows in levels[1:]:
        seq[rows] += seq[up[rows]] + 1
    return up, depth, seq, cycle


def _label(start: str = "start_ns", span: str = "span_id") -> Column:
    return F.concat(F.lpad(F.col(start).cast("string"), 20, "0"), F.lit(":"), F.col(span))


def _small_traces(spans: DataFrame, paths: bool) -> DataFrame:
    """Whole traces in Arrow batches: one shuffle by trace, and no group of its own for each."""
    rows = spans.withColumn("_label", _label()) if paths else spans
    rows = rows.repartition("trace_id").sortWithinPartitions("trace_id", "start_ns", "span_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            column = lambda c: (table.column(c).chunk(0) if table.num_rows else pa.array([], pa.string())).cast(pa.string())
            up, depth, seq, cycle = _forest(column("trace_id"), column("span_id"), column("parent_span_id"))
            table = table.append_column("depth", pa.array(depth, pa.int32())).append_column("seq", pa.array(seq, pa.int64())).append_column("cycle", pa.array(cycle))
            if paths:
                path = column("_label").to_pylist()
                for i in np.argsort(depth, kind="stable").tolist():
                    if up[i] >= 0:
                        path[i] = f"{path[up[i]]}/{path[i]}"
                table = table.drop_columns("_label").append_column("path", pa.array(path, pa.string()))
            yield from table.to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = batch.column("trace_id")[batch.num_rows - 1]
            if batch.column("trace_id")[0].equals(last):
                continue  # the trace goes on
            cut = pc.index(batch.column("trace_id"), last).as_py()
            yield from done(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        if held:
            yield from done(pa.Table.from_batches(held))

    schema = StructType([f for f in rows.schema.fields if f.name != "_label"]).add("depth", IntegerType()).add("seq", LongType()).add("cycle", BooleanType())
    return rows.mapInArrow(run, schema.add("path", StringType()) if paths else schema)


def _ranks(events: DataFrame) -> DataFrame:
    """event, seq, depth, open: sums along the lists that ``prev`` links, by doubling.
    Whatever is still linked after as many steps as there are events is on a circle (``open``)."""
    rows = written(events.select("event", "prev", (F.col("event") % 2 == 0).cast("long").alias("seq"), F.when(F.col("event") % 2 == 0, 1).otherwise(-1).cast("long").alias("depth")), "ranks")
    for _ in range(rows.count().bit_length()):
        linked = rows.filter("prev is not null")
        if not linked.limit(1).count():
            break
        back = rows.select(F.col("event").alias("prev"), F.col("prev").alias("_p"), F.col("seq").alias("_s"), F.col("depth").alias("_d"))
        moved = linked.join(back, "prev").select("event", F.col("_p").alias("prev"), (F.col("seq") + F.col("_s")).alias("seq"), (F.col("depth") + F.col("_d")).alias("depth"))
        rows = written(rows.filter("prev is null").unionByName(moved), "ranks")
    return rows.select("event", "seq", "depth", F.col("prev").isNotNull().alias("open"))


def _tour(rows: DataFrame) -> DataFrame:
    """event, prev for rows (v, trace_id, up, start_ns, span_id): the Euler tour of each
    trace. Event 2v enters span v, 2v + 1 leaves it. A span is entered from the one
    beside it before, or from its parent; it is left from its last child, or from itself."""
    order = F.struct("start_ns", "span_id", "v")
    family = rows.withColumn("_up", F.coalesce("up", F.lit(-1).cast("long")))
    beside = last_before(family, ["trace_id", "_up"], ["start_ns", "span_id", "v"], F.col("v"), "_beside")
    enter = beside.select((2 * F.col("v")).alias("event"), F.coalesce(2 * F.col("_beside") + 1, 2 * F.col("up")).alias("prev"))
    child = rows.filter("up is not null").groupBy(F.col("up").alias("v")).agg(F.max_by("v", order).alias("_last"))
    leave = rows.join(child, "v", "left").select((2 * F.col("v") + 1).alias("event"), F.coalesce(2 * F.col("_last") + 1, 2 * F.col("v")).alias("prev"))
    return written(enter.unionByName(leave), "tour")


def _circles(rows: DataFrame) -> DataFrame:
    """The spans v on a circle of parents, for spans (v, up)."""
    at = written(rows.select("v", "up"), "ways")
    for _ in range(at.count().bit_length()):
        then = at.select(F.col("v").alias("up"), F.col("up").alias("_up"))
        at = written(at.join(then, "up", "left").select("v", F.col("_up").alias("up")), "ways")
    return at.filter("up is not null").select(F.col("up").alias("v")).distinct()


def _paths(rows: DataFrame) -> DataFrame:
    """v, path: labels from the root to each span of (v, up, label), by doubling; their length grows with the depth."""
    at = written(rows.select("v", "up", F.col("label").alias("path")), "paths")
    while at.filter("up is not null").limit(1).count():
        then = at.select(F.col("v").alias("up"), F.col("up").alias("_u"), F.col("path").alias("_p"))
        at = written(at.join(then, "up", "left").select("v", F.col("_u").alias("up"), F.concat_ws("/", "_p", "path").alias("path")), "paths")
    return at.select("v", "path")


def _large_traces(spans: DataFrame, paths: bool) -> DataFrame:
    """Traces of any size by list ranking of their Euler tours: integers only, log2 of
    the longest tour rounds, and no task that holds a trace."""
    rows = written(spans.withColumn("v", F.monotonically_increasing_id()), "large-traces")
    first = rows.groupBy("trace_id", F.col("span_id").alias("parent_span_id")).agg(F.min_by("v", F.struct("start_ns", "v")).alias("up"))
    tree = written(rows.select("v", "trace_id", "span_id", "parent_span_id", "start_ns").join(first, ["trace_id", "parent_span_id"], "left"), "large-trees")
    ranks = _ranks(_tour(tree))
    stuck = tree.join(ranks.filter("open").select((F.shiftright("event", 1)).alias("v")).distinct(), "v", "left_semi")
    circles = None
    if stuck.limit(1).count():
        circles = written(_circles(stuck), "circles").withColumn("cycle", F.lit(True))
        tree = written(tree.join(circles, "v", "left").withColumn("up", F.when(F.col("cycle").isNull(), F.col("up"))).drop("cycle"), "large-trees")
        ranks = _ranks(_tour(tree))
    at = ranks.filter("event % 2 = 0").select((F.shiftright("event", 1)).alias("v"), (F.col("depth") - 1).cast("int").alias("depth"), (F.col("seq") - 1).alias("seq"))
    out = rows.join(at, "v")
    out = out.withColumn("cycle", F.lit(False)) if circles is None else out.join(circles, "v", "left").withColumn("cycle", F.coalesce("cycle", F.lit(False)))
    if paths:
        out = out.join(_paths(tree.withColumn("label", _label())), "v")
    return out.drop("v")


def trace_tree(spans: DataFrame, value_cut: int | None = None, paths: bool = False, large: int = LARGE_TRACE) -> DataFrame:
    """Depth-first order of every trace: missing or orphan parents are roots,
    children follow by start time, then by id. Spans on a cycle of parents, one that
    is its own parent included, become roots with ``cycle`` set. Of spans with one id
    in a trace the earliest is the parent. With ``paths`` the starts and ids from the
    root are joined to a string, whose length grows with the depth.

    Traces up to ``large`` spans are worked out in Arrow batches of many traces; larger
    ones by list ranking, so neither a wide nor a deep trace lands in one task."""
    short = lambda v: F.when(F.length(v) > value_cut, F.concat(F.substring(v, 1, value_cut - 3), F.lit("..."))).otherwise(v) if value_cut else v
    shown = F.transform_values(F.map_filter("attributes", lambda k, v: k.isin(*fixed.TREE_ATTRIBUTES)), lambda k, v: short(v))
    facts = spans.select("trace_id", "span_id", "parent_span_id", "start_ns", "name", "status",
                         ((F.col("end_ns") - F.col("start_ns")) / 1_000_000).alias("duration_ms"), shown.alias("attrs"))
    big = written(spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).select("trace_id"), "large")
    if not big.limit(1).count():
        return _small_traces(facts, paths).drop("start_ns")
    small = _small_traces(facts.join(big, "trace_id", "left_anti"), paths)
    return small.unionByName(_large_traces(facts.join(big, "trace_id", "left_semi"), paths)).drop("start_ns")


def assemble_traces(spans: DataFrame) -> DataFrame:
    """One row per trace: root, span count, duration, error flag. The aggregate
    is map-side combined; the streaming form is in ``caseloom.streaming``."""
    root = F.when(~filled("parent_span_id"), F.struct("start_ns", "span_id"))
    return spans.groupBy("trace_id").agg(
        F.min_by("name", root).alias("root"), F.count(F.lit(1)).alias("n_spans"),
        ((F.max("end_ns") - F.min("start_ns")) / 1_000_000).alias("duration_ms"), F.max(F.col("status") == 2).alias("has_error"))
