"""FHIR bundles as JSON text: flattening, transactions, patient nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cut, filled, text
from ..operators.ordering import first_rows

# nested objects stay raw JSON text until a resource type is chosen
ENTRIES = "struct<resourceType:string,entry:array<struct<fullUrl:string,resource:string,request:string>>,_corrupt_record:string>"
CODED = "struct<text:string,coding:array<struct<system:string,code:string,display:string>>>"
REF = "struct<reference:string>"
RESOURCES = {
    "Patient": "struct<id:string,birthDate:string,gender:string,telecom:array<struct<system:string,value:string>>>",
    "Condition": f"struct<id:string,subject:{REF},code:{CODED},clinicalStatus:{CODED}>",
    "Observation": f"struct<id:string,subject:{REF},code:{CODED}>",
    "Encounter": f"struct<id:string,subject:{REF},status:string,period:struct<start:string>>",
    "DocumentReference": f"struct<id:string,subject:{REF},status:string,date:string,description:string>",
}


def bundle_entries(df: DataFrame, json_col: str, keep: list[str] | None = None) -> DataFrame:
    """One row per resource: kept columns, position, type and raw resource JSON."""
    parsed = df.select(*(keep or []), F.from_json(json_col, ENTRIES)["entry"].alias("_e"))
    rows = parsed.select(*(keep or []), F.posexplode_outer("_e").alias("pos", "e")).filter("e is not null")
    raw = F.col("e.resource")
    return rows.select(*(keep or []), "pos", F.get_json_object(raw, "$.resourceType").alias("resource_type"), raw.alias("resource"))


def typed_entries(df: DataFrame, json_col: str, keep: list[str] | None = None) -> DataFrame:
    """One row per resource of a known type, from one scan: kept columns, position, type and
    a struct column per type, of which that of the row's own type is filled."""
    rows = bundle_entries(df, json_col, keep).filter(F.col("resource_type").isin(*RESOURCES))
    typed = [F.when(F.col("resource_type") == kind, F.from_json("resource", schema)).alias(kind) for kind, schema in RESOURCES.items()]
    return rows.select(*(keep or []), "pos", "resource_type", *typed)


def flatten_bundles(df: DataFrame, json_col: str, keep: list[str] | None = None) -> dict[str, DataFrame]:
    """One typed table per resource type; each is a filter over the same scan. Who reads
    them all takes ``typed_entries``, which scans once."""
    rows = typed_entries(df, json_col, keep)
    return {kind: rows.filter(F.col("resource_type") == kind).select(*(keep or []), "pos", f"{kind}.*") for kind in RESOURCES}


def subject_id(of: str = "") -> Column:
    return F.regexp_replace(F.col(f"{of}subject.reference"), r"^Patient/", "")


def to_transaction_bundles(df: DataFrame, json_col: str, file_col: str = "file") -> DataFrame:
    """Set type ``transaction`` and give entries without a request a PUT (id
    present) or POST. Text that is not a bundle is reported with ``ok`` false."""
    parsed = df.select(file_col, F.from_json(json_col, ENTRIES, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("b"))
    # type and id are read once per resource, which may be long
    named = lambda e: F.struct(e["fullUrl"].alias("fullUrl"), e["resource"].alias("resource"), e["request"].alias("request"), F.from_json(e["resource"], "struct<resourceType:string,id:string>").alias("is"))
    kind = lambda e: F.coalesce(e["is"]["resourceType"], F.lit("Resource"))
    rid = lambda e: text(e["is"]["id"])
    made = lambda e: F.when(rid(e) != "", F.concat(F.lit('{"method":"PUT","url":"'), kind(e), F.lit("/"), rid(e), F.lit('"}'))).otherwise(
        F.concat(F.lit('{"method":"POST","url":"'), kind(e), F.lit('"}')))
    url = lambda e: F.when(filled(e["fullUrl"]), F.concat(F.lit('"fullUrl":'), F.to_json(F.array(e["fullUrl"])).substr(F.lit(2), F.length(F.to_json(F.array(e["fullUrl"]))) - 2), F.lit(","))).otherwise("")
    line = lambda e: F.concat(F.lit("{"), url(e), F.lit('"resource":'), F.coalesce(e["resource"], F.lit("{}")), F.lit(',"request":'), F.coalesce(e["request"], made(e)), F.lit("}"))
    entries = F.coalesce(F.col("b.entry"), F.array().cast("array<struct<fullUrl:string,resource:string,request:string>>"))
    ok = F.col("b").isNotNull() & F.col("b._corrupt_record").isNull() & (F.col("b.resourceType").isNotNull() | F.col("b.entry").isNotNull())
    body = F.concat(F.lit('{"resourceType":"Bundle","type":"transaction","entry":['), F.array_join(F.transform(F.transform(entries, named), line), ","), F.lit("]}"))
    return parsed.select(file_col, F.coalesce(ok, F.lit(False)).alias("ok"), F.size(entries).alias("n_entries"), F.when(ok, body).alias("bundle_json"))


def load_counts(bundles: DataFrame) -> DataFrame:
    return bundles.agg(F.sum(F.col("ok").cast("long")).alias("ok"), F.sum((~F.col("ok")).cast("long")).alias("failed"))


def patient_nodes(bundles: DataFrame, json_col: str, as_of: Column, id_col: str = "patient_id", limit: int | None = None, note_cut: int | None = None) -> DataFrame:
    """Graph node per patient with its condition, observation and note lines in
    order of the bundle, or the first ``limit`` of them; ``n_more`` counts the rest.
    The lines of one patient meet in one group."""
    rows = bundle_entries(bundles, json_col, [id_col])
    code = text(F.get_json_object("resource", "$.code.text"))
    line = (F.when(F.col("resource_type") == "Condition", F.concat(F.lit("Condition: "), code))
            .when(F.col("resource_type") == "Observation", F.concat(F.lit("Obs: "), code))
            .when(F.col("resource_type") == "DocumentReference",
                  F.concat(F.lit("Note: "), cut(text(F.get_json_object("resource", "$.description")), note_cut))))
    lines = rows.select(id_col, "pos", "resource_type", line.alias("line")).filter("line is not null")
    if limit:
        n = lines.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
        lines = first_rows(lines, [id_col], ["pos", "resource_type", "line"], limit).drop("rank").join(n, id_col)
    # a patient without lines has one row that says nothing, so that bundles are unpacked once and nothing is joined
    every = lines.unionByName(bundles.select(id_col).distinct(), allowMissingColumns=True)
    out = every.groupBy(id_col).agg(F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("pos", "resource_type", "line")))).alias("_l"),
                                    (F.max("_n") if limit else F.lit(None).cast("long")).alias("_n"))
    return out.select(F.concat(F.lit("patient-"), F.col(id_col).cast("string")).alias("node_id"),
                      F.coalesce(F.array_join(F.transform("_l", lambda r: r["line"]), "\n"), F.lit("")).alias("summary"), as_of.alias("ingested_at"),
                      F.coalesce(F.col("_n") - F.size("_l"), F.lit(0)).alias("n_more"))
