"""Personal health information: scan, redact, route; payload handling."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import contains_any, filled, string_array, text

ENTITY = "array<struct<type:string,start:int,end:int,score:double,text:string>>"


def ascii_text(c: Column | str) -> Column:
    """Replace non-ASCII characters by blanks, so word borders mean the same in
    every regular-expression engine."""
    return F.regexp_replace(text(c), r"[^\x00-\x7F]", " ")


def field_policy(sources: Sequence[tuple] = tuple(fixed.PHI_SOURCES),
                 blocked: Sequence[str] = tuple(fixed.PHI_BLOCKED_FIELDS),
                 threshold: float = fixed.PHI_GLOBAL_THRESHOLD) -> Column:
    """Policy table as a map column: source -> struct(threshold, blocked)."""
    pairs: list[Column] = []
    for name, limit, extra in sources:
        pairs += [F.lit(name), F.struct(F.lit(limit).alias("threshold"),
                                        string_array(list(dict.fromkeys([*blocked, *extra]))).alias("blocked"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,struct<threshold:double,blocked:array<string>>>")


def policy_for(df: DataFrame, source_col: str, policy: Column | None = None) -> DataFrame:
    """Add ``threshold``, ``blocked`` and ``safe`` for the source of each row;
    an unknown source gets the global values."""
    found = F.try_element_at(policy if policy is not None else field_policy(), F.col(source_col))
    return (df.withColumn("threshold", F.coalesce(found["threshold"], F.lit(fixed.PHI_GLOBAL_THRESHOLD)))
            .withColumn("blocked", F.coalesce(found["blocked"], string_array(fixed.PHI_BLOCKED_FIELDS)))
            .withColumn("safe", string_array(fixed.PHI_SAFE_FIELDS)))


def may_match(c: Column, name: str) -> Column:
    """Cheap necessary condition of a rule, so that most texts skip the costly
    expression. True for rules without known marks."""
    if name in fixed.PHI_MARK_WORDS:
        return contains_any(F.lower(c), fixed.PHI_MARK_WORDS[name])
    if name in fixed.PHI_MARK_PATTERNS:
        return c.rlike(fixed.PHI_MARK_PATTERNS[name])
    return F.lit(True)


def entity_counts(c: Column, rules: Sequence[tuple[str, str]] = tuple(fixed.PHI_PATTERNS)) -> Column:
    """Matches per rule as an array of (type, n); stays inside the JVM."""
    n = lambda name, rx: F.when(may_match(c, name), F.regexp_count(c, F.lit(rx))).otherwise(0)
    return F.array(*[F.struct(F.lit(name).alias("type"), n(name, rx).alias("n")) for name, rx in rules])


def _positions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    compiled = [(name, re.compile(rx, re.ASCII)) for name, rx in fixed.PHI_PATTERNS]
    for texts in batches:
        yield texts.map(lambda t: [
            {"type": name, "start": m.start(), "end": m.end(), "score": fixed.PHI_PATTERN_SCORE, "text": m.group(0)}
            for name, rx in compiled for m in rx.finditer(t or "")])


def phi_entities(df: DataFrame, text_col: str, id_col: str = "id") -> DataFrame:
    """One row per entity with its character positions (Arrow batches)."""
    positions = F.pandas_udf(_positions, ENTITY)
    return df.select(id_col, F.explode_outer(positions(ascii_text(text_col))).alias("e")).filter("e is not null").select(id_col, "e.*")


def _scanned(field: str, rules: Sequence[tuple[str, str]]) -> Column:
    """Entities of one field under the row's policy columns."""
    value = ascii_text(field)
    none = F.array().cast("array<struct<type:string,n:int>>")
    found = F.filter(entity_counts(value, rules), lambda e: e["n"] > 0)
    skip = F.array_contains("safe", F.lit(field)) | (value == "") | (F.col("threshold") > fixed.PHI_PATTERN_SCORE)
    blocked = F.array(F.struct(F.lit("BLOCKED_FIELD").alias("type"), F.lit(1).alias("n")))
    return F.when(F.array_contains("blocked", F.lit(field)), blocked).when(skip, none).otherwise(found)


def _scan_rows(df: DataFrame, fields: Sequence[str], id_col: str, source_col: str | None, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(id, array of (field, entities)): a projection, one row per record."""
    src = policy_for(df.withColumn("_src", F.col(source_col) if source_col else F.lit("default")), "_src")
    cells = [F.struct(F.lit(f).alias("field"), _scanned(f, rules).alias("entities")) for f in fields]
    return src.select(id_col, F.array(*cells).alias("_f"))


def scan_phi(df: DataFrame, fields: Sequence[str], id_col: str = "id", source_col: str | None = None,
             rules: Sequence[tuple[str, str]] = tuple(fixed.PHI_PATTERNS)) -> DataFrame:
    """One row per (record, field): blocked fields are sensitive, safe or empty
    ones are not, others are scanned. ``provider`` is where the field may go.
    Fields are unpivoted from an array of structs, so there is no shuffle."""
    out = _scan_rows(df, fields, id_col, source_col, rules).select(id_col, F.explode_outer("_f").alias("f")).select(id_col, "f.*")
    out = out.withColumn("is_sensitive", F.size("entities") > 0)
    return out.withColumn("provider", F.when(F.col("is_sensitive"), "local").otherwise("cloud"))


def redact_phi(df: DataFrame, text_col: str, id_col: str = "id",
               rules: Sequence[tuple[str, str]] = tuple(fixed.PHI_PATTERNS), placeholders: dict[str, str] | None = None) -> DataFrame:
    """Replace every match by ``<TYPE>`` (or a given placeholder), rule by rule.
    Each rule is a projection step of its own, so no step repeats another."""
    out = df.select(id_col, ascii_text(text_col).alias("_t"))
    out = out.withColumn("_n", entity_counts(F.col("_t"), rules)).withColumn("redacted", F.col("_t"))
    for name, rx in rules:
        to = (placeholders or {}).get(name, f"<{name}>")
        cut = F.regexp_replace("redacted", rx, to)
        out = out.withColumn("redacted", F.when(may_match(F.col("redacted"), name), cut).otherwise(F.col("redacted")))
    return out.select(id_col, "redacted", F.aggregate("_n", F.lit(0), lambda a, e: a + e["n"]).alias("n_entities"))


def routing_audit(df: DataFrame, fields: Sequence[str], id_col: str = "id", source_col: str | None = None,
                  rules: Sequence[tuple[str, str]] = tuple(fixed.PHI_PATTERNS)) -> DataFrame:
    """Field to provider per record, with counts; a projection like the scan."""
    rows = _scan_rows(df, fields, id_col, source_col, rules)
    to = F.transform("_f", lambda f: F.struct(f["field"], F.when(F.size(f["entities"]) > 0, "local").otherwise("cloud").alias("provider")))
    rows = rows.select(id_col, to.alias("_to"))
    n = lambda p: F.size(F.filter("_to", lambda f: f["provider"] == p))
    return rows.select(id_col, F.map_from_entries("_to").alias("field_routings"), n("local").alias("n_local"), n("cloud").alias("n_cloud"))


# --- payloads ---------------------------------------------------------------------


def deidentify_payload(df: DataFrame, text_col: str, is_healthcare: bool | None = None) -> DataFrame:
    """Mask names and identifiers in health payloads. A failing row is closed:
    its text is withheld and ``remediation`` is set; other rows go on."""
    raw = text(text_col)
    health = contains_any(F.lower(raw), fixed.HEALTH_WORDS) if is_healthcare is None else F.lit(is_healthcare)
    masked = raw
    for rx, to in fixed.DEIDENTIFY_PATTERNS:
        masked = F.regexp_replace(masked, rx, to)
    out = df.withColumn("is_healthcare", health)
    out = out.withColumn("failed", F.col("is_healthcare") & raw.contains(fixed.DEIDENTIFY_FAIL_MARK))
    out = out.withColumn("clean", F.when(F.col("failed"), F.lit(None).cast("string"))
                         .when(F.col("is_healthcare"), masked).otherwise(raw))
    return out.withColumn("remediation", F.when(F.col("failed"), fixed.DEIDENTIFY_REMEDIATION))


def tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def payload_class(df: DataFrame, text_col: str, id_col: str = "id") -> DataFrame:
    n = F.length(text(text_col))
    return df.select(id_col, n.alias("n_chars"), tokens(text(text_col)).alias("tokens"),
                     F.when(n < 1000, "small").when(n < 10000, "medium").otherwise("large").alias("size_class"))


def intercept_large(df: DataFrame, text_col: str, id_col: str = "id", chars: int = 4000, max_tokens: int = 1000,
                    name: str = "result", preview: int = 200) -> tuple[DataFrame, DataFrame]:
    """Keep payloads of up to ``chars`` and ``max_tokens`` inline; replace larger
    ones by a reference with a preview. The second table holds the large texts in full."""
    body = text(text_col)
    keep = (F.length(body) <= chars) & (tokens(body) <= max_tokens)
    var = F.concat(F.col(id_col).cast("string"), F.lit(f"_{name}"))
    note = F.concat(F.lit("Large output ("), F.length(body).cast("string"), F.lit(" chars, ~"),
                    tokens(body).cast("string"), F.lit(" tokens) stored in '"), var, F.lit("'.\nPreview: "),
                    F.replace(F.substring(body, 1, preview), F.lit("\n"), F.lit(" ")), F.lit("..."))
    inline = df.select(id_col, F.when(keep, body).otherwise(note).alias("output"), (~keep).alias("stored"))
    return inline, df.filter(~keep).select(id_col, var.alias("name"), body.alias("value"))


def peek(df: DataFrame, text_col: str, start: int = 0, length: int | None = 1000, id_col: str = "id") -> DataFrame:
    """A slice of the asked length (None: to the end) with the offset to continue
    at; NULL slice past the end."""
    total = F.length(text(text_col))
    inside = F.lit(start) < total
    end = F.lit(start + length) if length is not None else total
    stop = F.least(end, total)
    return df.select(
        id_col, F.lit(start).alias("start"), F.when(inside, stop).alias("stop"), total.alias("total"),
        F.when(inside, F.substring(text(text_col), F.lit(start + 1), end - start)).alias("slice"),
        F.when(inside & (end < total), end).alias("next"),
        F.when(~inside, F.concat(F.lit(f"ERROR: start ({start}) is beyond context length ("), total.cast("string"),
                                 F.lit(")"))).alias("error"))


def resolve_refs(df: DataFrame, variables: DataFrame, text_col: str, id_col: str = "id", session_col: str = "session_id") -> DataFrame:
    """Replace ``{{var:x}}`` by the session's variable or ``<missing:x>``.
    The text is cut into literal and reference pieces, references are joined on
    (session, name) and the pieces of each row are put back in order. Only rows
    with references take the join."""
    ref = r"\{\{var:([a-zA-Z0-9_\-]+)\}\}"
    with_refs = df.filter(F.col(text_col).rlike(ref))
    plain = df.filter(~F.coalesce(F.col(text_col).rlike(ref), F.lit(False))).select(id_col, text(text_col).alias("text"))
    names = F.regexp_extract_all(F.col(text_col), F.lit(ref), F.lit(1))
    pieces = F.split(F.col(text_col), ref, -1)
    parts = with_refs.select(id_col, session_col, F.posexplode_outer(F.arrays_zip(pieces.alias("piece"), names.alias("name")))
                             .alias("pos", "p")).select(id_col, session_col, "pos", "p.piece", "p.name")
    values = variables.select(session_col, "name", F.col("value").alias("_value"))
    filled_in = parts.join(values, [session_col, "name"], "left")
    shown = F.when(F.col("name").isNull(), F.lit("")).otherwise(
        F.coalesce("_value", F.concat(F.lit("<missing:"), F.col("name"), F.lit(">"))))
    glued = (filled_in.groupBy(id_col)  # the pieces of one text
             .agg(F.sort_array(F.collect_list(F.struct("pos", F.concat("piece", shown).alias("t")))).alias("_p"))
             .select(id_col, F.array_join(F.transform("_p", lambda r: r["t"]), "").alias("text")))
    return plain.unionByName(glued)
