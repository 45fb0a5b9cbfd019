"""Criteria: a tree of typed leaves under AND, OR and NOT, and its compilation to Spark.

Three targets: columns of a wide table (pushed into the scan where Spark can), an array of attributes on a
document row, and the long attribute table (one aggregation by document). In all of them a leaf is a
plain yes or no: an attribute that a document lacks makes positive leaves false and negative ones true. Over
several values, a positive leaf holds if any value does, a negative one if none does. Values are compared
within one type only: a long never equals a double. Where ``coerce`` is asked for, numbers, booleans and texts are compared
across types: a text counts as the number or the boolean that it spells, and a whole number equals the double of its value.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import as_boolean, as_number
from ..functions.types import TYPES
from ..model import IDENTITY, VALUE_COLUMNS

NEGATIVE = {"not_eq": "eq", "has_not": "has", "not_in": "in", "not_matches": "matches"}


@dataclass(frozen=True)
class Leaf:
    """One condition on one key."""

    op: str
    key: str
    values: tuple = ()


@dataclass(frozen=True)
class All:
    """All children hold."""

    children: tuple


@dataclass(frozen=True)
class AnyOf:
    """One child at least holds."""

    children: tuple


@dataclass(frozen=True)
class Not:
    """The child doesn't hold."""

    child: object


@dataclass(frozen=True)
class Call:
    """A function of the caller's: it gets the values' column and returns a condition on one value."""

    key: str
    vtype: str
    function: Callable[[Column], Column]


class Criteria:
    """Builder: ``Criteria().and_().eq("a", 1).or_().has("b").has("c").end().end().build()``."""

    def __init__(self):
        self._open: list[tuple[type, list]] = []
        self._done: list = []

    def _add(self, node) -> Criteria:
        (self._open[-1][1] if self._open else self._done).append(node)
        return self

    def and_(self) -> Criteria:
        self._open.append((All, []))
        return self

    def or_(self) -> Criteria:
        self._open.append((AnyOf, []))
        return self

    def not_(self) -> Criteria:
        self._open.append((Not, []))
        return self

    def end(self) -> Criteria:
        kind, children = self._open.pop()
        return self._add(Not(All(tuple(children))) if kind is Not else kind(tuple(children)))

    def eq(self, key, value) -> Criteria:
        return self._add(Leaf("eq", key, (value,)))

    def not_eq(self, key, value) -> Criteria:
        return self._add(Leaf("not_eq", key, (value,)))

    def greater_than(self, key, value) -> Criteria:
        return self._add(Leaf("gt", key, (value,)))

    def greater_than_eq(self, key, value) -> Criteria:
        return self._add(Leaf("ge", key, (value,)))

    def less_than(self, key, value) -> Criteria:
        return self._add(Leaf("lt", key, (value,)))

    def less_than_eq(self, key, value) -> Criteria:
        return self._add(Leaf("le", key, (value,)))

    def range(self, key, low, high) -> Criteria:
        return self._add(Leaf("range", key, (low, high)))

    def has(self, key) -> Criteria:
        return self._add(Leaf("has", key))

    def has_not(self, key) -> Criteria:
        return self._add(Leaf("has_not", key))

    def in_(self, key, *values) -> Criteria:
        return self._add(Leaf("in", key, values))

    def not_in(self, key, *values) -> Criteria:
        return self._add(Leaf("not_in", key, values))

    def matches(self, key, pattern) -> Criteria:
        return self._add(Leaf("matches", key, (pattern,)))

    def not_matches(self, key, pattern) -> Criteria:
        return self._add(Leaf("not_matches", key, (pattern,)))

    def call(self, key, vtype, function) -> Criteria:
        return self._add(Call(key, vtype, function))

    def build(self):
        """The tree; None if nothing was added, and such a query finds nothing."""
        if self._open:
            raise ValueError("and_, or_ or not_ without end")
        return None if not self._done else self._done[0] if len(self._done) == 1 else All(tuple(self._done))


def vtype_of(value) -> str:
    """The type alias of a literal."""
    for kind, name in ((bool, "boolean"), (int, "long"), (float, "double"), (str, "string"), (dt.datetime, "timestamp")):
        if isinstance(value, kind):
            return name
    if (custom := TYPES.of(value)) is not None:
        return custom.alias
    raise TypeError(f"no attribute type for {type(value).__name__}")


def literal(value) -> Column:
    """The literal in its type's column."""
    if isinstance(value, dt.datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    if (kind := vtype_of(value)) in TYPES:
        return F.lit(TYPES[kind].text(value))
    return F.lit(value).cast("bigint") if kind == "long" else F.lit(value)


def value_column(vtype: str) -> str:
    """The column that holds values of a type; those of custom types are texts."""
    return VALUE_COLUMNS.get(vtype, VALUE_COLUMNS["string"])


def _test(op: str, value: Column, values: tuple) -> Column:
    """A positive condition on one value."""
    if op == "has":
        return value.isNotNull()
    if op == "range":
        return (value >= literal(values[0])) & (value <= literal(values[1]))
    if op == "in":
        return value.isin(*(literal(v) for v in values)) if values else F.lit(False)
    if op == "matches":
        return value.rlike(f"(?s)^(?:{values[0]})$")
    x = literal(values[0])
    return {"eq": value == x, "gt": value > x, "ge": value >= x, "lt": value < x, "le": value <= x}[op]


def _fold(node, leaf: Callable) -> Column:
    if isinstance(node, All):
        return reduce(lambda a, b: a & b, (_fold(c, leaf) for c in node.children), F.lit(True))
    if isinstance(node, AnyOf):
        return reduce(lambda a, b: a | b, (_fold(c, leaf) for c in node.children), F.lit(False))
    if isinstance(node, Not):
        return ~_fold(node.child, leaf)
    if isinstance(node, Leaf) and node.op in NEGATIVE:
        return ~leaf(Leaf(NEGATIVE[node.op], node.key, node.values))
    if isinstance(node, Leaf | Call):
        return leaf(node)
    raise TypeError(f"not a criteria node: {node!r}")


def _null_free_top(node) -> bool:
    """Whether a filter may keep the leaf's null as it is: under AND and OR a null row is dropped as a false one is."""
    return not isinstance(node, Not) and all(_null_free_top(c) for c in getattr(node, "children", ()))


def wide(node, columns: Mapping[str, Column] | None = None) -> Column:
    """A condition on a table with one column a key, for use in a filter."""
    positive = _null_free_top(node)

    def leaf(n) -> Column:
        column = (columns or {}).get(n.key, F.col(n.key))
        if isinstance(n, Call):
            return F.coalesce(n.function(column), F.lit(False))
        test = _test(n.op, column, n.values)
        return test if n.op == "has" or positive and n in plain else F.coalesce(test, F.lit(False))

    # Only leaves that are not negated may stay as they are; those Spark can push into the scan.
    plain = {n for n in leaves(node) if n.op not in NEGATIVE} - {Leaf(NEGATIVE[n.op], n.key, n.values) for n in leaves(node) if n.op in NEGATIVE}
    return _fold(node, leaf)


def leaves(node) -> list[Leaf]:
    """All plain leaves of the tree."""
    if isinstance(node, Leaf):
        return [node]
    return [x for c in getattr(node, "children", (node.child,) if isinstance(node, Not) else ()) for x in leaves(c)]


def keys(node) -> set[str]:
    """All keys that the tree asks for."""
    if isinstance(node, Leaf | Call):
        return {node.key}
    return {k for c in getattr(node, "children", (node.child,) if isinstance(node, Not) else ()) for k in keys(c)}


def _coerced(op: str, a: Callable[[str], Column], values: tuple) -> Column:
    """A comparison with a literal across types; other pairs of types than numbers, booleans and texts don't compare."""
    kind = vtype_of(values[0])
    number = F.coalesce(a("v_long").cast("double"), a("v_dbl"), as_number(a("v_str")))
    if kind in ("long", "double"):
        exact = (a("vtype") == kind) & _test(op, a(VALUE_COLUMNS[kind]), values)
        return F.when(a("vtype") == kind, exact).otherwise(a("vtype").isin("long", "double", "string") & _test(op, number, tuple(map(float, values))))
    if kind == "boolean":
        return a("vtype").isin("boolean", "string") & _test(op, F.coalesce(a("v_bool"), as_boolean(a("v_str"))), values)
    same = (a("vtype") == kind) & _test(op, a(value_column(kind)), values)
    if kind != "string":
        return same
    try:
        numbers = tuple(float(v) for v in values)
    except ValueError:
        numbers = ()
    flags = tuple(v.lower() == "true" for v in values) if all(v.lower() in ("true", "false") for v in values) else ()
    if numbers:
        same = same | a("vtype").isin("long", "double") & _test(op, number, numbers)
    return same | (a("vtype") == "boolean") & _test(op, a("v_bool"), flags) if flags else same


def _on_value(n, a: Callable[[str], Column], coerce: bool = False) -> Column:
    """A leaf's condition on one attribute value, given its fields."""
    if isinstance(n, Call):
        test = (a("vtype") == n.vtype) & n.function(a(value_column(n.vtype)))
    elif n.op == "has":
        test = F.lit(True)
    elif n.op == "in":
        parts = [(a("vtype") == t) & _test("in", a(value_column(t)), tuple(v for v in n.values if vtype_of(v) == t)) for t in sorted({vtype_of(v) for v in n.values})]
        parts += [_coerced("eq", a, (v,)) for v in n.values] if coerce else []
        test = reduce(lambda x, y: x | y, parts, F.lit(False))
    elif coerce and n.op != "matches":
        test = _coerced(n.op, a, n.values)
    else:
        t = vtype_of(n.values[0])
        test = (a("vtype") == t) & _test(n.op, a(value_column(t)), n.values)
    return F.coalesce((a("key") == n.key) & test, F.lit(False))


def on_docs(node, attrs: str = "attrs", coerce: bool = False) -> Column:
    """A condition on documents that hold their attributes as an array."""
    return _fold(node, lambda n: F.exists(attrs, lambda v: _on_value(n, lambda f: v[f], coerce)))


def true_when_missing(node) -> bool:
    """Whether the tree holds for a document that has none of its keys."""
    if isinstance(node, All):
        return all(true_when_missing(c) for c in node.children)
    if isinstance(node, AnyOf):
        return any(true_when_missing(c) for c in node.children)
    if isinstance(node, Not):
        return not true_when_missing(node.child)
    return isinstance(node, Leaf) and node.op in NEGATIVE


def matching_ids(attrs: DataFrame, node, coerce: bool = False) -> DataFrame:
    """Identities of the documents that the tree holds for, by one aggregation over the long table.

    Rows of other keys don't enter the shuffle, unless documents without any of the keys match as well.
    """
    if node is None:
        return attrs.select(*IDENTITY).limit(0)
    found: list = []

    def leaf(n) -> Column:
        if n not in found:
            found.append(n)
        return F.col(f"leaf_{found.index(n)}")

    condition = _fold(node, leaf)
    rows = attrs if true_when_missing(node) else attrs.where(F.col("key").isin(*sorted(keys(node))))
    flags = [F.bool_or(_on_value(n, F.col, coerce)).alias(f"leaf_{i}") for i, n in enumerate(found)]
    return rows.groupBy(*IDENTITY).agg(*(flags or [F.count("*").alias("n")])).where(condition).select(*IDENTITY)
