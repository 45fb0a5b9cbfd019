"""Criteria from text, custom types, comparisons across types, and writing what is read again."""

import random
import uuid
from datetime import datetime
from ipaddress import IPv4Address

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gritstone.functions import scalars as S
from gritstone.functions.types import TYPES, TypeRegistry
from gritstone.model import to_attrs
from gritstone.operators import changelog, features, graph, ranges
from gritstone.plans.criteria import All, AnyOf, Call, Leaf, Not, matching_ids
from gritstone.plans.expressions import parse, unescape_key
from gritstone.sources import scratch, tables


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a == 1", Leaf("eq", "a", (1,))),
        ("a eq -1.5e2", Leaf("eq", "a", (-150.0,))),
        ("2 < a", Leaf("gt", "a", (2,))),
        ('a != "x\\"y"', Leaf("not_eq", "a", ('x"y',))),
        ("a == null", Leaf("has_not", "a")),
        ("null ne a", Leaf("has", "a")),
        ("a =~ '.*' or b !~ 'x' || c ge true", AnyOf((Leaf("matches", "a", (".*",)), Leaf("not_matches", "b", ("x",)), Leaf("ge", "c", (True,))))),
        ("a == 1 or b == 2 and not (c == 3 or d == 4)", AnyOf((Leaf("eq", "a", (1,)), All((Leaf("eq", "b", (2,)), Not(AnyOf((Leaf("eq", "c", (3,)), Leaf("eq", "d", (4,)))))))))),
        ("!!a$46$b == 1", Not(Not(Leaf("eq", "a.b", (1,))))),
        ("  ", None),
    ],
)
def test_expressions(text, want):
    assert parse(text) == want


@pytest.mark.parametrize("text", ["a", "a ==", "a == b", "1 == 2", "(a == 1", "a == 1)", "a < null", "a =~ 3", "f:g(a)", "a == 1 b == 2", "a # 1", "and"])
def test_expressions_that_cannot_be_read(text):
    with pytest.raises(ValueError):
        parse(text)


def test_calls_of_expressions():
    node = parse("f:g(a, 2, 'x')", {"f:g": ("long", lambda column, n, s: (column, n, s))})
    assert isinstance(node, Call) and (node.key, node.vtype, node.function(7)) == ("a", "long", (7, 2, "x"))


def test_keys_survive_escaping(spark):
    keys = ["plain_1", "a.b c", "x$y", "é-ü", ""]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select(S.escape_key(F.col("k")).alias("e")).collect()
    assert [unescape_key(r.e) for r in rows] == keys


def test_custom_types(spark):
    registry = TypeRegistry()
    registry.register("length", range, lambda r: f"{len(r):09d}", lambda c: F.lpad(c.cast("string"), 9, "0"), lambda c: c.cast("long"))
    assert "length" in registry and registry.of(range(3)).alias == "length" and registry.of(3) is None
    for taken in ("length", "string"):
        with pytest.raises(ValueError):
            registry.register(taken, set, str, lambda c: c, lambda c: c)
    one = uuid.uuid4()
    rows = [(k, f"10.0.{k}.{300 - k}" if k else None, str(one).upper() if k == 99 else str(uuid.uuid4())) for k in range(50, 100)]
    a = to_attrs(spark.createDataFrame(rows, "id int, ip string, u string"), F.lit("t"), F.col("id"), None, {"ip": ("ipv4", F.col("ip")), "u": ("uuid", F.col("u"))})
    assert {r.doc_id for r in matching_ids(a, Leaf("gt", "ip", (IPv4Address("10.0.97.1"),))).collect()} == {"97", "98", "99"}
    assert [r.doc_id for r in matching_ids(a, Leaf("in", "u", (one, 5))).collect()] == ["99"]
    assert a.where("key = 'ip' AND doc_id = '60'").select(TYPES["ipv4"].decode(F.col("v_str")).alias("ip")).first().ip == "10.0.60.240"


def test_comparisons_across_types(spark):
    t = spark.createDataFrame([(0, "10", 10, 10.0, "true", True), (1, "9.5", 9, 9.5, "no idea", False), (2, "ten", None, None, None, None)], "id int, s string, l long, d double, f string, b boolean")
    a = to_attrs(t, F.lit("t"), F.col("id"), None, {c: (k, F.col(c)) for c, k in (("s", "string"), ("l", "long"), ("d", "double"), ("f", "string"), ("b", "boolean"))})

    def ids(op, key, *values, coerce=True):
        return "".join(sorted(r.doc_id for r in matching_ids(a, Leaf(op, key, values), coerce).collect()))

    assert [ids("eq", k, 10) for k in "sld"] == ["0", "0", "0"] and [ids("eq", k, 10, coerce=False) for k in "sld"] == ["", "0", ""]
    assert [ids("lt", k, "10") for k in "ld"] == ["1", "1"] and ids("le", "s", 9.5) == "1" and ids("eq", "l", "ten") == ""
    assert (ids("eq", "f", True), ids("eq", "b", "false"), ids("not_eq", "b", "true"), ids("in", "s", 10, "ten"), ids("range", "s", 9, 11)) == ("0", "1", "12", "02", "01")


def test_puts_can_be_repeated(spark, tmp_path):
    t = spark.createDataFrame([(f"g{k % 3}", datetime(2024, 1, 1, k % 24), k) for k in range(60)], "grp string, ts timestamp_ntz, id long")
    path = str(tmp_path / "n")
    for part in (t.where("id % 2 = 0"), t, t, t.limit(0)):
        tables.put_last_n(part, path, 4, slots=5)
    got = tables.load_last_n(spark, path).collect()
    want = {r.id for g in range(3) for r in sorted((r for r in t.collect() if r.grp == f"g{g}"), key=lambda r: (-r.ts.hour, r.id))[:4]}
    assert len(got) == 12 and {r.id for r in got} == want
    with pytest.raises(PySparkException, match="ends before"):
        tables.save_ranges(spark.createDataFrame([(1, 5, 3)], "id long, lo long, hi long"), str(tmp_path / "r"))


def test_overlaps_of_long_and_short_intervals(spark):
    rng = random.Random(4)

    def make(n):
        return [(k, lo := rng.randrange(5000), lo + rng.choice([-1, 0, 3, 40, 900, 4000])) for k in range(n)]

    a, b = make(120), make(90)
    frames = [spark.createDataFrame(x, "id long, lo long, hi long") for x in (a, b)]
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and x[2] >= y[1])
    assert sorted((r.a_id, r.b_id) for r in ranges.overlap_join(*frames, 4).collect()) == want
    assert ranges.overlap_join(frames[0].limit(0), frames[1], 4).count() == 0
    points = {(k % 2, p) for k, lo, hi in a for p in range(lo, hi + 1)}
    joined = ranges.united(frames[0].withColumn("side", F.col("id") % 2), "side").collect()
    assert {(r.side, p) for r in joined for p in range(r.lo, r.hi + 1)} == points and len(joined) < 60


@pytest.mark.parametrize(("n", "dims"), [(1, 2), (9, 2), (70, 3)])
def test_trees(spark, monkeypatch, n, dims):
    monkeypatch.setattr(changelog, "SUBTREE", 8)
    leaves = spark.createDataFrame([(k, f"{k:032x}") for k in range(n)], "idx long, hash string")
    want = {(level, r.idx, r.hash) for level, nodes in enumerate(changelog.tree(leaves, n, dims)) for r in nodes.collect()}
    got = changelog.tree_frame(leaves, n, dims)
    assert {(r.level, r.idx, r.hash) for r in got.collect()} == want and got.count() == len(want)
    other = changelog.tree_frame(leaves.withColumn("hash", F.when(F.col("idx") == n - 1, "f").otherwise(F.col("hash"))), n, dims)
    assert [r.idx for r in changelog.descend(got, other, dims, 9).collect()] == [n - 1] and changelog.descend(got, got, dims).count() == 0
    with pytest.raises(ValueError, match="different sizes"):
        changelog.descend(got, changelog.tree_frame(leaves.union(leaves.selectExpr("idx + 1000", "hash")).limit(n + 1), n + 1, dims), dims)


def test_loops_end(spark):
    v = spark.createDataFrame([("v", k, k) for k in range(5)], "type string, id long, weight long")
    e = spark.createDataFrame([("next", "v", k, "v", (k + 1) % 5) for k in range(5)], "label string, head_type string, head_id long, tail_type string, tail_id long")
    start = graph.Traversal(v, e).start(F.col("id") == 0)
    assert [(r.id, len(r.path)) for r in start.loop_while(lambda _: F.col("weight") < 3, "OUT", "next").frame().collect()] == [(3, 4)]
    assert [r.id for r in start.loop_while(lambda loops: loops < 2).frame().collect()] == [2]
    assert [r.id for r in start.loop_while(lambda _: F.lit(True), most=7).frame().collect()] == [2]


def test_json_keeps_types(spark):
    t = spark.createDataFrame([(1, '{"a": 1, "b": 2.5, "c": true, "d": "x\\"\\n", "e": [3, 4]}')], "row int, json string")
    leaves = tables.flatten_json(t, "json", "a long, b double, c boolean, d string, e array<int>", typed=True)
    assert tables.expand_json(leaves, ["row"]).first().json == '{"a":1,"b":2.5,"c":true,"d":"x\\"\\n","e":[3,4]}'


def test_pandas_vectors_and_scratch(spark):
    assert features.custom_rollup(spark.createDataFrame([(datetime(2024, 1, 1), 3)], "ts timestamp_ntz, v long"), "DAYS", [F.max("v").alias("m")], []).first().m == 3
    path = scratch.fresh_path(spark, "x")
    assert path != scratch.fresh_path(spark, "x") and path.startswith(scratch.shared_folder(spark))
    assert scratch.stored(spark.range(3), "y").count() == 3
