"""OTLP trace payloads as JSON text, both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import filled, text

VALUE = "struct<stringValue:string,intValue:string,boolValue:boolean>"
ATTRS = f"array<struct<key:string,value:{VALUE}>>"
SPAN = (f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,"
        f"attributes:{ATTRS},status:struct<code:int>,events:array<struct<name:string,attributes:{ATTRS}>>>")
PAYLOAD = f"struct<resourceSpans:array<struct<scopeSpans:array<struct<spans:array<{SPAN}>>>>>>"


def spans_from_otlp(df: DataFrame, json_col: str) -> DataFrame:
    """Explode payloads to spans. An attribute takes its string, else its
    integer, else its boolean value; typed, so 0 and "" are kept."""
    rs = df.select(F.explode_outer(F.from_json(json_col, PAYLOAD)["resourceSpans"]).alias("r"))
    ss = rs.select(F.explode_outer("r.scopeSpans").alias("s"))
    s = ss.select(F.explode_outer("s.spans").alias("x")).filter("x is not null").select("x.*")
    value = lambda a: F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["boolValue"].cast("string"))
    pairs = F.transform(F.coalesce("attributes", F.array().cast(ATTRS)), lambda a: F.struct(a["key"].alias("k"), value(a).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    start, end = F.coalesce(F.col("startTimeUnixNano").cast("long"), F.lit(0)), F.coalesce(F.col("endTimeUnixNano").cast("long"), F.lit(0))
    return s.select(
        text("traceId").alias("trace_id"), text("spanId").alias("span_id"), text("parentSpanId").alias("parent_span_id"), text("name").alias("name"),
        start.alias("start_ns"), end.alias("end_ns"), F.coalesce("status.code", F.lit(0)).alias("status"), F.map_from_entries(last).alias("attributes"),
        F.coalesce(F.size("events"), F.lit(0)).alias("n_events"), ((end - start) / 1_000_000).alias("duration_ms"))


def otlp_from_spans(spans: DataFrame, service: str = "caseloom", system: str = "caseloom", scope: str = "caseloom") -> DataFrame:
    """One envelope per span, as an exporter posts them: a projection that needs
    no grouping, so a trace of any size is never collected."""
    s_attr = lambda k, v: F.struct(k.alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    attrs = F.transform(F.map_entries("attributes"), lambda e: s_attr(e["key"], e["value"]))
    fields = [F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.when(filled("parent_span_id"), F.col("parent_span_id")).alias("parentSpanId"),
              F.col("name"), F.lit(3).alias("kind"), F.col("start_ns").cast("string").alias("startTimeUnixNano"),
              F.col("end_ns").cast("string").alias("endTimeUnixNano"), attrs.alias("attributes"), F.struct(F.col("status").alias("code")).alias("status")]
    if "events" in spans.columns:
        shown = F.transform("events", lambda e: F.struct(e["name"].alias("name"), F.array(s_attr(e["name"], e["content"])).alias("attributes")))
        fields.append(F.when(F.size("events") > 0, shown).alias("events"))
    resource = F.struct(F.array(s_attr(F.lit("service.name"), F.lit(service)), s_attr(F.lit("gen_ai.system"), F.lit(system))).alias("attributes"))
    scoped = F.struct(F.struct(F.lit(scope).alias("name")).alias("scope"), F.array(F.struct(*fields)).alias("spans"))
    payload = F.struct(F.array(F.struct(resource.alias("resource"), F.array(scoped).alias("scopeSpans"))).alias("resourceSpans"))
    return spans.select("trace_id", F.to_json(payload).alias("payload"))
