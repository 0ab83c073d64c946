"""Predicates over lists, contacts and campaigns, as reusable Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marktlens.functions.geo import in_bands


def is_false(c: str | Column) -> Column:
    """A null flag counts as false."""
    return ~F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def changed(a: str | Column, b: str | Column) -> Column:
    """Null-safe inequality."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return ~a.eqNullSafe(b)


def eligible(limit: str = "rate_limit") -> Column:
    """A listed contact that may be written to: on the list, rated within the limit (inclusive), not blocked, address good."""
    return is_false("removed") & F.col("rate").isNotNull() & (F.col("rate") <= F.col(limit)) & is_false("blocked") & is_false("wrong_email")


def rate_section(section: str, rate: str = "rate", limit: str = "rate_limit") -> Column:
    """in: within the limit; out: above it; rated: any rate; all: without one."""
    rated = F.col(rate).isNotNull()
    return {"in": rated & (F.col(rate) <= F.col(limit)), "out": rated & (F.col(rate) > F.col(limit)), "rated": rated, "all": ~rated}[section]


def search(q: str, *columns: str) -> Column:
    """Case-insensitive containment in any column; wildcards in q keep their meaning; an empty q matches all."""
    if not q:
        return F.lit(True)
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{q}%"), F.lit(False))
    return found


def truthy(c: str) -> Column:
    return F.lower(F.trim(F.col(c))).isin("1", "true", "on", "yes")


def display_name(*columns: str) -> Column:
    """The first column that isn't blank, trimmed; else a dash."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns], F.lit("—"))


def valid_rate(c: str, low: int = 1, high: int = 100) -> Column:
    return F.coalesce(F.col(c).between(low, high), F.lit(False))


def in_workspace(df: DataFrame, workspace_id: str) -> DataFrame:
    return df.filter(F.col("workspace_id") == workspace_id)


def like_any(c: str, patterns: list[str]) -> Column:
    """Case-insensitive LIKE with any of the patterns; false without patterns, null for a null value."""
    found = F.lit(False)
    for p in patterns:
        found = found | F.col(c).ilike(p)
    return found


def one_of(c: str, values: list, but: bool = False) -> Column:
    """Membership in a list, or absence from it; a null value is neither, and an empty list holds nothing."""
    found = F.col(c).isin(values) if values else F.when(F.col(c).isNotNull(), F.lit(False))
    return ~found if but else found


def where(rule: dict) -> Column:
    """A choice of branches or cities as a Column. A rule has one entry: `all` or `any` with a list of rules, `not` with a rule,
    `like` with {column: patterns}, `bands` with {population column: names of bands}. An empty `all` holds for every row, an
    empty `any` for none; another kind of rule is an error."""
    ((kind, what),) = rule.items()
    if kind == "not":
        return ~where(what)
    if kind in ("all", "any"):
        found = F.lit(kind == "all")
        for r in what:
            found = found & where(r) if kind == "all" else found | where(r)
        return found
    if kind in ("like", "bands"):
        ((c, names),) = what.items()
        return like_any(c, names) if kind == "like" else in_bands(F.col(c), names)
    raise ValueError(f"no such rule: {kind}")
