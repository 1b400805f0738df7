"""Rule scoring of free text: risk domains, care plans, protocols, briefs.

Rules are short fixed tables, so they are compiled into column expressions: one
projection per row, no join and no shuffle whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import contains_any, string_array, text


def priority_of(high_count: Column, thresholds: Sequence[tuple[str, int]]) -> Column:
    out = F.lit("ROUTINE")
    for name, floor in reversed(list(thresholds)):
        out = F.when(high_count >= floor, F.lit(name)).otherwise(out)
    return out


def _high_count(levels: Sequence[Column]) -> Column:
    return sum((F.when(c == "HIGH", 1).otherwise(0) for c in levels), F.lit(0))


def score_domains(
    df: DataFrame,
    text_col: str,
    rules: Sequence[tuple] = tuple(fixed.SHIPPED_RULES),
    thresholds: Sequence[tuple[str, int]] = tuple(fixed.SIX_DOMAIN_THRESHOLDS),
    id_col: str = "patient_id",
) -> DataFrame:
    """Add one level column per domain, ``high_count``, ``priority`` and the
    rendered block ``score_text``. Keywords match as plain substrings."""
    low = F.lower(text(text_col))
    levels = [
        F.when(contains_any(low, words), F.lit(hit)).otherwise(F.lit(miss)).alias(key)
        for key, _, words, hit, miss in rules
    ]
    keys = [r[0] for r in rules]
    scored = df.select("*", *levels)
    scored = scored.withColumn("high_count", _high_count([F.col(k) for k in keys]))
    scored = scored.withColumn("priority", priority_of(F.col("high_count"), thresholds))
    lines = [F.concat(F.lit("SDoH Risk Assessment for "), F.col(id_col), F.lit(":"))]
    for key, label, *_ in rules:
        lines.append(F.concat(F.lit("  " + (label + ":").ljust(fixed.ASSESSMENT_LABEL_WIDTH)), F.col(key)))
    lines.append(
        F.concat(F.lit("Overall Priority: "), F.col("priority"), F.lit(" ("), F.col("high_count").cast("string"),
                 F.lit(f"/{len(rules)} domains elevated)"))
    )
    return scored.withColumn("score_text", F.concat_ws("\n", *lines))


def score_domains_evidence(
    df: DataFrame,
    text_col: str,
    rules: Sequence[tuple] = tuple(fixed.EVIDENCE_RULES),
    thresholds: Sequence[tuple[str, int]] = tuple(fixed.FIVE_DOMAIN_THRESHOLDS),
    id_col: str = "patient_id",
) -> DataFrame:
    """Two keyword hits make HIGH, one MEDIUM; the first three hits are the
    evidence. Adds ``<domain>``, ``<domain>_evidence``, counts and text."""
    out = df.withColumn("_low", F.lower(text(text_col)))
    for key, _, words in rules:
        hits = F.filter(string_array(words), lambda w: F.col("_low").contains(w))
        out = out.withColumn(f"_{key}", hits)
    for key, *_ in rules:
        n = F.size(f"_{key}")
        out = out.withColumn(key, F.when(n >= 2, "HIGH").when(n == 1, "MEDIUM").otherwise("LOW"))
        out = out.withColumn(f"{key}_evidence", F.slice(f"_{key}", 1, 3))
    out = out.withColumn("high_count", _high_count([F.col(r[0]) for r in rules]))
    out = out.withColumn("priority", priority_of(F.col("high_count"), thresholds))
    width = max(len(r[1]) for r in rules)
    lines = []
    for key, label, _ in rules:
        shown = F.array_join(f"{key}_evidence", ", ")
        lines.append(F.concat(F.lit("  " + label.ljust(width) + ": "), F.col(key),
                              F.when(shown != "", F.concat(F.lit("  ["), shown, F.lit("]"))).otherwise("")))
    lines.append(F.concat(F.lit("Overall Priority: "), F.col("priority"), F.lit(" ("),
                          F.col("high_count").cast("string"), F.lit(f"/{len(rules)} domains elevated)")))
    return out.withColumn("score_text", F.concat_ws("\n", *lines)).drop("_low", *[f"_{r[0]}" for r in rules])


def _label_steps(score_text: Column) -> Column:
    low = F.lower(text(score_text))
    parts = [
        F.when(contains_any(low, words), string_array(steps)).otherwise(string_array([]))
        for words, steps in fixed.LABEL_PLAN
    ]
    return F.concat(*parts, string_array([fixed.CLOSING_STEP]))


def _value_steps(levels: dict[str, Column]) -> Column:
    parts = [
        F.when(levels[key] == "HIGH", string_array([step])).otherwise(string_array([]))
        for key, step in fixed.VALUE_PLAN
    ]
    return F.concat(*parts, string_array([fixed.CLOSING_STEP]))


def assessment_levels(score_text: Column) -> dict[str, Column]:
    """Domain levels read back from a rendered block; NULL when absent."""
    return {
        key: F.nullif(F.regexp_extract(text(score_text), label + r":\s*(HIGH|MEDIUM|LOW)", 1), F.lit(""))
        for key, label, *_ in fixed.SHIPPED_RULES
    }


def parse_assessment(df: DataFrame, score_col: str = "score_text") -> DataFrame:
    """Text block to ``domains`` map and ``parsed_priority``."""
    levels = assessment_levels(F.col(score_col))
    pairs = [x for key, c in levels.items() for x in (F.lit(key), c)]
    priority = F.nullif(F.regexp_extract(text(score_col), r"Overall Priority:\s*(URGENT|HIGH|ROUTINE)", 1), F.lit(""))
    return df.withColumn("domains", F.create_map(*pairs)).withColumn("parsed_priority", priority)


def with_plan_steps(df: DataFrame, mode: str = "label", score_col: str = "score_text") -> DataFrame:
    """Add the ordered ``plan_steps`` array. ``label`` tests whether a domain is
    named in the score text (always so after a full assessment), ``value`` tests
    whether its level is HIGH."""
    if mode == "label":
        steps = _label_steps(F.col(score_col))
    elif mode == "value":
        steps = _value_steps(assessment_levels(F.col(score_col)))
    else:
        raise ValueError(f"unknown plan mode {mode!r}")
    return df.withColumn("plan_steps", steps)


def plan_body(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")


def care_plan(df: DataFrame, mode: str = "label", id_col: str = "patient_id", score_col: str = "score_text") -> DataFrame:
    """One row per numbered plan step."""
    planned = with_plan_steps(df, mode, score_col)
    return planned.select(id_col, F.posexplode_outer("plan_steps").alias("_pos", "step")).select(
        id_col, (F.col("_pos") + 1).alias("step_no"), "step"
    )


def plan_text(df: DataFrame, id_col: str = "patient_id", dash: str = "-") -> DataFrame:
    """Full plan text from ``plan_steps``."""
    return df.withColumn(
        "plan_text",
        F.concat(F.lit("Care Plan for "), F.col(id_col), F.lit(":\n\n"), plan_body(F.col("plan_steps")),
                 F.lit(f"\n\nPriority: Urgent if 5+ domains HIGH {dash} escalate to supervising CHW")),
    )


def action_brief(
    df: DataFrame, resources_col: str | None = None, compat: bool = False, id_col: str = "patient_id"
) -> DataFrame:
    """Prioritised brief from evidence scores (needs the columns of
    :func:`score_domains_evidence`). ``compat=True`` infers HIGH from the word
    anywhere in the text, the default reads the level columns."""
    low = F.lower(F.col("score_text"))
    urgent = low.contains("urgent") if compat else F.col("priority") == "URGENT"
    high = (low.contains("high") & ~urgent) if compat else F.col("priority") == "HIGH"
    label = (F.when(urgent, F.lit(fixed.BRIEF_LABELS["URGENT"])).when(high, F.lit(fixed.BRIEF_LABELS["HIGH"]))
             .otherwise(F.lit(fixed.BRIEF_LABELS["ROUTINE"])))
    parts = [F.when(urgent, string_array(fixed.BRIEF_URGENT)).otherwise(string_array([]))]
    for word, key, action in fixed.BRIEF_ACTIONS:
        fires = (low.contains(word) & low.contains("high")) if compat else F.col(key) == "HIGH"
        parts.append(F.when(fires, string_array([action])).otherwise(string_array([])))
    out = df.withColumn("priority_label", label)
    out = out.withColumn("actions", F.concat(*parts, string_array([fixed.BRIEF_CLOSING])))
    named = ["Economic", "Education", "Health Care", "Neighborhood", "Social"]
    risk_lines = F.filter(F.split("score_text", "\n"), lambda x: contains_any(x, named))
    local = F.lit(None).cast("string")
    if resources_col:
        listed = F.filter(F.slice(F.split(text(resources_col), "\n"), 2, 5), lambda x: F.trim(x) != "")
        local = F.when(F.size(listed) > 0, F.concat(
            F.lit("\n--- Local Resources ---\n"),
            F.array_join(F.transform(listed, lambda x: F.concat(F.lit("  "), F.trim(x))), "\n")))
    return out.withColumn(
        "brief",
        F.concat_ws("\n",
                    F.concat(F.lit("CHW Action Brief: "), F.col(id_col)),
                    F.concat(F.lit("Priority: "), F.col("priority_label")),
                    F.lit("\n--- Risk Summary ---"), F.array_join(risk_lines, "\n"),
                    F.lit("\n--- Recommended Actions ---"), plan_body(F.col("actions")), local,
                    F.lit("\n--- Documentation ---\nRecord this assessment in the care management platform.\n"
                          "Flag for care team review if priority is URGENT or HIGH.")))


def protocols_for(c: Column, rules: Sequence[tuple] = tuple(fixed.PROTOCOL_RULES),
                  defaults: Sequence[str] = tuple(fixed.PROTOCOL_DEFAULTS)) -> Column:
    """Array of protocols whose keyword group occurs in the text, or the defaults."""
    low = F.lower(text(c))
    hits = F.concat(*[F.when(contains_any(low, words), string_array(names)).otherwise(string_array([]))
                      for words, names in rules])
    return F.when(F.size(hits) > 0, hits).otherwise(string_array(defaults))


def match_protocols(df: DataFrame, text_col: str, rules: Sequence[tuple] = tuple(fixed.PROTOCOL_RULES),
                    defaults: Sequence[str] = tuple(fixed.PROTOCOL_DEFAULTS), id_col: str = "patient_id") -> DataFrame:
    """One row per (id, matched protocol)."""
    return df.select(id_col, F.explode_outer(F.array_distinct(protocols_for(F.col(text_col), rules, defaults))).alias("protocol"))


def community_resources(requests: DataFrame, resources: DataFrame, fallback: Sequence[tuple] | None = None) -> DataFrame:
    """Resources by 3-digit zip prefix; an unknown prefix or an empty category
    result falls back. ``requests(req_id, zip, category)``, ``resources(prefix,
    name, category, phone, services)``. Equi-joins on the prefix only; a request
    left without a match gets the fallback from a literal array."""
    names = ("name", "category", "phone", "services")
    spare = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)])
                      for row in (fallback or fixed.FALLBACK_RESOURCES)])
    reqs = requests.select(
        "req_id", F.coalesce("category", F.lit("")).alias("_want"),
        F.when(F.length("zip") >= 3, F.substring("zip", 1, 3)).otherwise("000").alias("prefix"))
    known = resources.select("prefix").distinct().withColumn("_known", F.lit(True))
    offered = resources.select(F.col("prefix").alias("_p"), *names)
    fits = (F.col("_want") == "") | (F.col("category") == F.col("_want")) | (F.col("category") == "all")
    joined = reqs.join(known, "prefix", "left").join(offered, (F.col("prefix") == F.col("_p")) & fits, "left")
    narrowed = F.filter(spare, lambda r: (r["category"] == F.col("_want")) | (r["category"] == "all"))
    instead = F.when(F.col("_known") | (F.col("_want") == "") | (F.size(narrowed) == 0), spare).otherwise(narrowed)
    shown = F.when(F.col("_p").isNotNull(), F.array(F.struct(*names))).otherwise(instead)
    return joined.select("req_id", F.explode_outer(shown).alias("r")).select("req_id", "r.*")
