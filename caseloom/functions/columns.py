"""Column builders shared by the operators. Everything here is plain Catalyst."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """NULL and the empty string mean the same thing in the source systems."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def filled(c: Column | str) -> Column:
    return text(c) != ""


def cut(c: Column | str, n: int | None) -> Column:
    """The first ``n`` characters; all of them without a number."""
    return col(c) if n is None else F.substring(col(c), 1, n)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    return any_of(c.contains(w) for w in words)


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def unpack(c: Column | str, sep: str = "|") -> Column:
    """``a|b|c`` to an array that ends before the first empty piece."""
    parts = F.split(text(c), re.escape(sep), -1)
    gap = F.array_position(parts, F.lit("")).cast("int")
    return F.when(gap == 0, parts).otherwise(F.slice(parts, F.lit(1), F.greatest(gap - 1, F.lit(0))))


def last_piece(c: Column | str, sep: str = ".") -> Column:
    return F.element_at(F.split(text(c), re.escape(sep), -1), -1)


def hex_id(length: int, *parts: Column | str) -> Column:
    """Deterministic hexadecimal id of a natural key (same input, same id)."""
    return F.substring(F.sha2(F.concat_ws("|", *[col(p).cast("string") for p in parts]), 256), 1, length)


def traceparent(c: Column | str) -> Column:
    """Parse ``00-<32 hex>-<16 hex>-<2 hex>``: four parts, lengths 32 and 16."""
    parts = F.split(text(c), "-", -1)
    trace, span = F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))
    ok = (F.size(parts) == 4) & (F.length(trace) == 32) & (F.length(span) == 16)
    return F.struct(
        F.coalesce(ok, F.lit(False)).alias("valid"),
        F.when(ok, trace).alias("trace_id"),
        F.when(ok, span).alias("span_id"),
    )


def build_traceparent(trace_id: Column | str, span_id: Column | str) -> Column:
    return F.concat_ws("-", F.lit("00"), col(trace_id), col(span_id), F.lit("01"))


# --- rule expressions given as data ------------------------------------------

FALSE_WORDS = ("", "0", "false", "no", "off")


def truthy(c: Column | str) -> Column:
    return ~F.lower(F.trim(text(c))).isin(*FALSE_WORDS)


def condition_expr(clauses: Sequence[dict[str, Any]]) -> Column:
    """One boolean Column from clause rows ``{group, column, op, literal, negate}``.
    Clauses of one group are and-ed, groups are or-ed; no rows means true."""
    if not clauses:
        return F.lit(True)
    groups: dict[Any, list[Column]] = {}
    for row in clauses:
        value, op, literal = col(row["column"]), row.get("op"), row.get("literal")
        shown = F.coalesce(value.cast("string"), F.lit("None"))
        if op is None:
            hit = truthy(value)
        elif op == "contains":
            hit = text(value).contains(literal)
        elif op == "==":
            hit = shown == literal
        elif op == "!=":
            hit = shown != literal
        else:
            raise ValueError(f"unknown condition operator {op!r}")
        groups.setdefault(row.get("group", 0), []).append(~hit if row.get("negate") else hit)
    return any_of(all_of(g) for g in groups.values())


def template_expr(parts: Sequence[str | tuple]) -> Column:
    """Text from literal strings and ``(column, filter, ...)`` tuples. Filters:
    ``lower``, ``upper``, ``("default", value)``. Missing values become ''."""
    out = []
    for part in parts:
        if isinstance(part, str):
            out.append(F.lit(part))
            continue
        value = col(part[0]).cast("string")
        for f in part[1:]:
            if f == "lower":
                value = F.lower(F.coalesce(value, F.lit("")))
            elif f == "upper":
                value = F.upper(F.coalesce(value, F.lit("")))
            elif isinstance(f, tuple) and f[0] == "default":
                value = F.coalesce(F.nullif(value, F.lit("")), F.lit(f[1]))
            else:
                raise ValueError(f"unknown filter {f!r}")
        out.append(F.coalesce(value, F.lit("")))
    return F.concat(*out)


def first_match_case(cases: Sequence[tuple[Column | None, Column]], error: str) -> Column:
    """First matching condition wins; a ``None`` condition always matches."""
    out = None
    for cond, result in cases:
        cond = F.lit(True) if cond is None else cond
        out = F.when(cond, result) if out is None else out.when(cond, result)
    return F.lit(error) if out is None else out.otherwise(F.lit(error))
