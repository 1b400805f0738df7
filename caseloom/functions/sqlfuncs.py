"""Scalar rules and table functions callable from SQL.

They are SQL functions (``CREATE TEMPORARY FUNCTION … RETURN expr``), which
Catalyst inlines: a call in a query costs what the expression costs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import fixed


def _quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(words: Sequence[str], c: str = "txt") -> str:
    return "(" + " OR ".join(f"contains(lower({c}), {_quote(w)})" for w in words) + ")"


def register_sql_functions(spark: SparkSession, rules: Sequence[tuple] = tuple(fixed.SHIPPED_RULES), prefix: str = "") -> None:
    """``ticket_score``, ``ticket_tier``, ``risk_<domain>``, ``risk_high_count``,
    ``risk_priority``, ``token_estimate``, ``payload_size``, ``message_status``
    and ``normal_priority``. ``prefix`` keeps several rule sets apart."""
    def make(name: str, args: str, returns: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS {returns} RETURN {body}")

    have = lambda c, n: f"CASE WHEN coalesce({c}, '') <> '' THEN {n} ELSE 0 END"
    make("ticket_score", "summary STRING, problem STRING, solution STRING, category STRING, status STRING", "INT",
         " + ".join([have("summary", 20), have("problem", 30), have("solution", 35), have("category", 10), have("status", 5)]))
    make("ticket_tier", "score INT", "STRING", "CASE WHEN score >= 80 THEN 'HIGH' WHEN score >= 50 THEN 'MEDIUM' ELSE 'LOW' END")
    for key, _, words, hit, miss in rules:
        make(f"risk_{key}", "txt STRING", "STRING", f"CASE WHEN {_any(words)} THEN {_quote(hit)} ELSE {_quote(miss)} END")
    count = " + ".join(f"CASE WHEN {_any(words)} THEN 1 ELSE 0 END" for _, _, words, _, _ in rules)
    make("risk_high_count", "txt STRING", "INT", count)
    steps = " ".join(f"WHEN n >= {floor} THEN {_quote(name)}" for name, floor in fixed.SIX_DOMAIN_THRESHOLDS)
    make("risk_priority", "n INT", "STRING", f"CASE {steps} ELSE 'ROUTINE' END")
    make("token_estimate", "txt STRING", "INT", "CAST(greatest(1, floor(length(coalesce(txt, '')) / 4)) AS INT)")
    make("payload_size", "txt STRING", "STRING",
         "CASE WHEN length(coalesce(txt, '')) < 1000 THEN 'small' WHEN length(coalesce(txt, '')) < 10000 THEN 'medium' ELSE 'large' END")
    names = " ".join(f"WHEN {k} THEN {_quote(v)}" for k, v in fixed.MESSAGE_STATUS.items())
    make("message_status", "code INT", "STRING", f"CASE code {names} ELSE concat('Status:', code) END")
    known = ", ".join(_quote(p) for p in fixed.FOLLOWUP_PRIORITIES)
    make("normal_priority", "p STRING", "STRING", f"CASE WHEN lower(p) IN ({known}) THEN lower(p) ELSE 'routine' END")


def register_table_functions(spark: SparkSession, rules: Sequence[tuple] = tuple(fixed.PROTOCOL_RULES),
                             defaults: Sequence[str] = tuple(fixed.PROTOCOL_DEFAULTS), size: int = 1000) -> None:
    """``match_protocols(txt)`` and ``search_chunks(txt, query)`` for ``LATERAL``."""
    arr = lambda items: "array(" + ", ".join(_quote(i) for i in items) + ")"
    hits = "concat(" + ", ".join(f"CASE WHEN {_any(words)} THEN {arr(names)} ELSE CAST(array() AS ARRAY<STRING>) END" for words, names in rules) + ")"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION match_protocols(txt STRING) RETURNS TABLE(protocol STRING) RETURN "
        f"SELECT p FROM (SELECT explode(CASE WHEN size({hits}) > 0 THEN array_distinct({hits}) ELSE {arr(defaults)} END) AS p)")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION search_chunks(txt STRING, query STRING) "
        "RETURNS TABLE(chunk INT, score INT, excerpt STRING) RETURN "
        "SELECT c, s, t FROM (SELECT c, t, size(filter(split(lower(query), ' '), w -> contains(lower(t), w))) AS s FROM "
        f"(SELECT c, substring(txt, c * {size} + 1, {size}) AS t FROM (SELECT explode(sequence(0, CAST(greatest(length(txt) - 1, 0) / {size} AS INT))) AS c))) WHERE s > 0")
