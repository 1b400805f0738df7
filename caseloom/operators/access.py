"""Who may see and call what: scopes, roles, entitlements, approvals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import string_array, text


def roles_from_scopes(claims: DataFrame, scope_map: Sequence[tuple[str, str]] = tuple(fixed.SCOPE_ROLES),
                      subject: str = "subject", scope: str = "scope") -> DataFrame:
    """Whole-token scope to role. The claim may be a string or an array. The
    short scope table is a literal map, so this is a projection."""
    tokens = F.col(scope) if claims.schema[scope].dataType.typeName() == "array" else F.split(text(scope), " ")
    table = F.create_map(*[F.lit(v) for pair in scope_map for v in pair])
    roles = F.array_compact(F.transform(F.array_distinct(tokens), lambda t: F.try_element_at(table, t)))
    return claims.select(subject, F.explode_outer(F.array_distinct(roles)).alias("role")).filter("role is not null")


def entitlements(requests: DataFrame, principals: DataFrame, tools: DataFrame, deny: Sequence[str] = (),
                 allow: Sequence[str] = (), strict: bool = False, substring_roles: bool = False) -> DataFrame:
    """May each requesting principal list and execute each requested tool?
    ``requests(principal, tool)``, ``principals(principal, roles array)``,
    ``tools(tool, required_role)``. Equi-joins on principal and tool; pairs that
    nobody asks about are never formed. A deny entry beats everything; in strict
    mode a tool must be on the allow list to run, while an empty allow list
    hides nothing from the listing."""
    rows = requests.join(principals, "principal", "left").join(tools, "tool", "left")
    roles = F.coalesce(F.col("roles"), F.array().cast("array<string>"))
    need = text("required_role")
    holds = F.exists(roles, lambda r: r.contains(need)) if substring_roles else F.array_contains(roles, need)
    by_role = (need == "") | F.array_contains(roles, "%All") | F.coalesce(holds, F.lit(False))
    denied = F.col("tool").isin(*deny) if deny else F.lit(False)
    listed = F.col("tool").isin(*allow) if allow else F.lit(False)
    can_list = by_role & ~denied & (listed if strict and allow else F.lit(True))
    can_run = by_role & ~denied & (listed if strict else F.lit(True))
    reason = (F.when(denied, "denied").when(F.lit(strict) & ~listed, "not in allow list")
              .when(~by_role, F.concat(F.lit("role required: "), need)).otherwise(""))
    return rows.select("principal", "tool", can_list.alias("can_list"), can_run.alias("can_execute"), reason.alias("reason"))


def action_permissions(principals: DataFrame, policy: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """One row per principal and policy action (a short literal list)."""
    table = F.array(*[F.struct(F.lit(a).alias("action"), string_array(list(r)).alias("need"))
                      for a, r in {**fixed.ACTION_ROLES, **(policy or {})}.items()])
    rows = principals.select("principal", "roles", F.explode_outer(table).alias("p"))
    return rows.select("principal", "p.action", F.coalesce(F.arrays_overlap("roles", "p.need"), F.lit(False)).alias("allowed"))


def visible_runs(runs: DataFrame, requests: DataFrame, principals: DataFrame) -> DataFrame:
    """May the viewer see the run, and decide on it? ``requests(viewer, run_id)``,
    ``runs(run_id, requester, …)``. A caller sees own runs, an approver all; nobody
    decides on an own run. Pairs that nobody asks about are never formed."""
    can = action_permissions(principals).groupBy(F.col("principal").alias("viewer")).agg(
        F.bool_or((F.col("action") == "approve") & F.col("allowed")).alias("_approves"), F.bool_or((F.col("action") == "list") & F.col("allowed")).alias("_lists"))
    rows = requests.join(runs.select("run_id", "requester"), "run_id", "left").join(can, "viewer", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    own = F.coalesce(F.col("viewer") == F.col("requester"), F.lit(False))
    known = F.col("requester").isNotNull()
    return rows.select("viewer", "run_id", (known & (flag("_approves") | (own & flag("_lists")))).alias("visible"), (known & flag("_approves") & ~own).alias("may_decide"))


def approval_required(calls: DataFrame, policy: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Exempt list first, then the extra list, then the effect."""
    p = {**fixed.APPROVAL_POLICY, **(policy or {})}
    among = lambda c, values: F.col(c).isin(*values) if values else F.lit(False)
    need = (F.when(among("tool", p["exempt_tools"]), False).when(among("tool", p["extra_tools"]), True)
            .otherwise(among("effect", p["required_for"])))
    return calls.withColumn("required", need)
