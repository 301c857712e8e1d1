"""Row predicates: visibility, agent scope, namespaces, and the filter language."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(*, expired: bool = False, status: bool = True, workspace: str | None = "user") -> Column:
    """Rows that count: not deleted, not expired, active, and outside workspaces (or in one, or in any)."""
    p = F.col("deleted_at").isNull()
    if not expired:
        p = p & F.col("expired_at").isNull()
    if status:
        p = p & (F.col("status") == "active")
    if workspace == "user":
        p = p & F.col("workspace_id").isNull()
    elif workspace is not None:
        p = p & (F.col("workspace_id") == workspace)
    return p


def agent_scope(scope, caller: str | None) -> Column:
    """all, self, others, an id, or ids; no filter for self and others without a caller."""
    agent = F.col("agent_id")
    if isinstance(scope, (list, tuple)):
        return agent.isin(*scope)
    if scope == "all" or (scope in ("self", "others") and caller is None):
        return F.lit(True)
    if scope == "self":
        return agent == caller
    if scope == "others":
        return agent.isNull() | (agent != caller)
    return agent == scope


def visible(df: DataFrame, grants: DataFrame, caller: str) -> DataFrame:
    """Shared rows (visibility workspace or null), the caller's own, and restricted ones granted to the caller.

    grants: (memory_id, agent_id).
    """
    granted = grants.where(F.col("agent_id") == caller).select(F.col("memory_id").alias("_g")).distinct()
    own = F.coalesce(F.col("agent_id") == caller, F.lit(False))
    joined = df.join(granted, df["id"] == granted["_g"], "left")
    shared = F.col("visibility").isNull() | (F.col("visibility") == "workspace")
    return joined.where(shared | own | ((F.col("visibility") == "restricted") & F.col("_g").isNotNull())).drop("_g")


def _delimiter(scope: str) -> str:
    return "/" if "/" in scope else "."


def in_namespace(namespace: Column, scope: str, delimiter: str | None = None) -> Column:
    """Segment prefix, whatever the case; a null namespace is in every scope."""
    d = delimiter or _delimiter(scope)
    parts = scope.lower().split(d)
    head = F.slice(F.split(F.lower(namespace), "[" + d + "]"), 1, len(parts))
    return namespace.isNull() | (head == F.array(*map(F.lit, parts)))


def namespace_clause(namespace: Column, scope: str) -> Column:
    return (namespace == scope) | namespace.startswith(scope + _delimiter(scope))


def ancestors(namespace: Column, delimiter: str = "/") -> Column:
    """a/b/c -> [a, a/b, a/b/c]"""
    parts = F.split(namespace, "[" + delimiter + "]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), delimiter))


def compile_filter(expr: dict) -> Column:
    """The filter language: {"and"|"or": [...]}, {"not": f}, or {"field": f, op: value} with op one of
    eq, neq, gt, gte, lt, lte, in, contains, exists."""
    if "and" in expr:
        return reduce(lambda a, b: a & b, map(compile_filter, expr["and"]), F.lit(True))
    if "or" in expr:
        return reduce(lambda a, b: a | b, map(compile_filter, expr["or"]), F.lit(False))
    if "not" in expr:
        return ~compile_filter(expr["not"])
    c = F.col(expr["field"])
    ops = {
        "eq": lambda v: c == v, "neq": lambda v: c != v, "gt": lambda v: c > v, "gte": lambda v: c >= v, "lt": lambda v: c < v, "lte": lambda v: c <= v,
        "in": lambda v: c.isin(*v), "contains": lambda v: c.contains(v), "exists": lambda v: c.isNotNull() if v else c.isNull(),
    }
    (op, value), *more = [(k, v) for k, v in expr.items() if k != "field"]
    if more or op not in ops:
        raise ValueError(f"not a filter: {expr}")
    return ops[op](value)


def no_nul(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [~F.coalesce(F.col(c).contains("\0"), F.lit(False)) for c in columns])


def ilike_any(column: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [column.ilike(f"%{w}%") for w in words], F.lit(False))
