"""Visibility expressions (``A&(B|C)``), expiration and age-off.

An attribute with an expression that the caller's authorisations don't satisfy does not exist for the query, so these
filters come before any predicate. Expressions are few, and attributes many: the distinct expressions are
evaluated, and rows filtered by a plain comparison that reaches the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[\w:./-]+|[&|()])')
MAX_LISTED = 2_000


def allows(expression: str | None, auths: Iterable[str]) -> bool:
    """Whether the authorisations satisfy the expression; an empty one is satisfied by all."""
    have = set(auths)
    if not expression or not expression.strip():
        return True
    tokens, at = [], 0
    text = expression.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"bad visibility expression: {expression!r}")
        tokens.append(m[1])
        at = m.end()

    def term() -> bool:
        if not tokens:
            raise ValueError(f"bad visibility expression: {expression!r}")
        t = tokens.pop(0)
        if t == "(":
            value = chain()
            if not tokens or tokens.pop(0) != ")":
                raise ValueError(f"bad visibility expression: {expression!r}")
            return value
        if t in "&|)":
            raise ValueError(f"bad visibility expression: {expression!r}")
        return (re.sub(r"\\(.)", r"\1", t[1:-1]) if t[0] == '"' else t) in have

    def chain() -> bool:
        value, operator = term(), None
        while tokens and tokens[0] in "&|":
            t = tokens.pop(0)
            if operator not in (None, t):
                raise ValueError(f"& and | need parentheses: {expression!r}")
            operator = t
            other = term()
            value = value and other if t == "&" else value or other
        return value

    value = chain()
    if tokens:
        raise ValueError(f"bad visibility expression: {expression!r}")
    return value


def visible(rows: DataFrame, auths: Iterable[str], column: str = "vis") -> DataFrame:
    """The rows whose expression the authorisations satisfy.

    The distinct expressions are looked at first; should a table have more than ``MAX_LISTED`` of them, the
    allowed ones are joined instead of listed.
    """
    auths = list(auths)
    text = F.coalesce(F.col(column), F.lit(""))
    distinct = rows.select(text.alias("v")).distinct()
    listed = [r.v for r in distinct.limit(MAX_LISTED + 1).collect()]
    if len(listed) <= MAX_LISTED:
        allowed = sorted(v for v in listed if allows(v, auths))
        condition = F.col(column).isin(*allowed) if allowed else F.lit(False)
        return rows.where(condition | F.col(column).isNull() if "" in allowed else condition)
    check = F.udf(lambda v: allows(v, auths), "boolean")
    return rows.join(distinct.where(check("v")), text == F.col("v"), "left_semi")


def visible_expr(auths: Iterable[str], expressions: Iterable[str], column: Column) -> Column:
    """The same as a condition, where the expressions are known."""
    auths = list(auths)
    return F.coalesce(column, F.lit("")).isin(*sorted(v for v in set(expressions) | {""} if allows(v, auths)))


def unexpired(now_ms: int | Column, ts: Column, expiration: Column) -> Column:
    """Whether an attribute still lives: no expiration (-1), or not more milliseconds old than that."""
    age = (F.lit(now_ms) if isinstance(now_ms, int) else now_ms) - millis(ts)
    return F.coalesce((expiration <= -1) | (age <= expiration), F.lit(True))


def within_age(now_ms: int, ts: Column, ttl_ms: int) -> Column:
    """Age-off: not from the future, and at most ``ttl_ms`` old."""
    at = millis(ts)
    return (at <= now_ms) & (F.lit(now_ms) - at <= ttl_ms)


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp, read as UTC."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("bigint")
