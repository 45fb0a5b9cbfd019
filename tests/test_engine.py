import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gritstone.functions import scalars as S
from gritstone.functions.visibility import allows, millis, unexpired, visible, within_age
from gritstone.model import ATTRS_SCHEMA, from_docs, orders_as_attrs, orders_as_docs, to_docs
from gritstone.operators import blobs, changelog, documents, features, geo, graph, lastn, ranges
from gritstone.plans.criteria import Criteria, matching_ids, on_docs, wide
from gritstone.queries import QUERIES
from gritstone.sources import tables


def attr(doc, key, vtype, value, ord_=0, vis="", expiration=-1, type_="t", ts=None):
    cells = {"string": None, "long": None, "double": None, "boolean": None, "timestamp": None} | {vtype: value}
    return (type_, doc, ts, ord_, key, vtype, *cells.values(), vis, expiration, {})


@pytest.fixture(scope="module")
def attrs(spark):
    rows = [
        attr("a", "x", "long", 1), attr("a", "x", "long", 9, 1), attr("a", "n", "string", "it's", 2),
        attr("b", "x", "double", 1.0), attr("b", "n", "string", "line\nbreak", 1),
        attr("c", "n", "string", "", 0),
        attr("d", "x", "long", 5, 0, "ADMIN"), attr("d", "y", "boolean", True, 1),
    ]
    return spark.createDataFrame(rows, ATTRS_SCHEMA)


C = Criteria
LEAVES = [
    (C().eq("x", 1), {"a"}),
    (C().eq("x", 1.0), {"b"}),
    (C().not_eq("x", 1), {"b", "c", "d"}),
    (C().greater_than("x", 4), {"a", "d"}),
    (C().greater_than_eq("x", 9), {"a"}),
    (C().less_than("x", 2), {"a"}),
    (C().less_than_eq("x", 5), {"a", "d"}),
    (C().range("x", 2, 8), {"d"}),
    (C().has("x"), {"a", "b", "d"}),
    (C().has_not("x"), {"c"}),
    (C().in_("x", 5, 1.0), {"b", "d"}),
    (C().in_("x"), set()),
    (C().not_in("x", 5, 9), {"b", "c"}),
    (C().eq("n", "it's"), {"a"}),
    (C().matches("n", "line.break"), {"b"}),
    (C().not_matches("n", "line.*"), {"a", "c", "d"}),
    (C().eq("y", True), {"d"}),
    (C().and_().eq("x", 1).eq("x", 9).end(), {"a"}),
    (C().or_().eq("x", 5).has("n").end(), {"a", "b", "c", "d"}),
    (C().not_().eq("x", 1).end(), {"b", "c", "d"}),
    (C().call("x", "long", lambda v: v % 5 == 0), {"d"}),
]


@pytest.mark.parametrize("k", range(len(LEAVES)))
def test_leaves_over_many_values(attrs, k):
    builder, want = LEAVES[k]
    node = builder.build()
    assert {r.doc_id for r in matching_ids(attrs, node).collect()} == want
    docs = to_docs(attrs)
    assert {r.doc_id for r in docs.where(on_docs(node)).collect()} == want


def test_wide_conditions_treat_null_as_missing(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, k string")
    ids = lambda node: {r.id for r in t.where(wide(node)).collect()}
    assert ids(C().eq("k", "a").build()) == {1}
    assert ids(C().not_eq("k", "a").build()) == {2, 3}
    assert ids(C().not_().or_().eq("k", "a").less_than("k", "b").end().end().build()) == {2, 3}
    assert ids(C().has_not("k").build()) == {2}
    assert ids(C().and_().has("k").not_in("k", "b").end().build()) == {1}
    plan = t.where(wide(C().eq("k", "a").build()))._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce" not in plan.lower()


def test_empty_criteria_find_nothing(attrs):
    assert documents.query(attrs, None).count() == 0
    with pytest.raises(ValueError):
        C().and_().eq("a", 1).build()


def test_hidden_attributes_do_not_exist(attrs):
    assert {r.doc_id for r in documents.query(attrs, C().has_not("x").build(), auths=[]).collect()} == {"c", "d"}
    assert {r.key for r in documents.query(attrs, C().has("y").build(), auths=[]).collect()} == {"y"}
    assert documents.query(attrs, C().eq("x", 5).build(), auths=["ADMIN"]).count() == 2
    assert documents.query(attrs, C().eq("x", 1).build(), fields=["n"]).count() == 1


@pytest.mark.parametrize(("expression", "auths", "want"), [("", [], True), (None, [], True), ("A|B", ["B"], True), ("A&B", ["B"], False), ("A&(B|C)", ["A", "C"], True), ('"x y"&A', ["A", "x y"], True), ("A", [], False)])
def test_visibility_expressions(expression, auths, want):
    assert allows(expression, auths) is want


@pytest.mark.parametrize("expression", ["A&B|C", "(A", "A B", "&", "A&"])
def test_bad_visibility_expressions_are_refused(expression):
    with pytest.raises(ValueError):
        allows(expression, ["A"])


def test_many_visibility_expressions_are_joined(spark, monkeypatch):
    from gritstone.functions import visibility

    monkeypatch.setattr(visibility, "MAX_LISTED", 3)
    t = spark.createDataFrame([(i, f"A{i}" if i else None) for i in range(8)], "id int, vis string")
    assert {r.id for r in visible(t, ["A2", "A5"]).collect()} == {0, 2, 5}


def test_expiration_and_age(spark):
    t = spark.createDataFrame([(1, datetime(2024, 1, 1), -1), (2, datetime(2024, 1, 1), 1000), (3, datetime(2024, 1, 1), 999), (4, None, 5)], "id int, ts timestamp_ntz, e long")
    now = 1_704_067_201_000
    assert {r.id for r in t.where(unexpired(now, F.col("ts"), F.col("e"))).collect()} == {1, 2, 4}
    assert {r.id for r in t.where(within_age(now, F.col("ts"), 1000)).collect()} == {1, 2, 3}
    assert t.where(within_age(1_704_067_199_000, F.col("ts"), 10_000)).count() == 0


def test_documents_round_trip(attrs):
    back = from_docs(to_docs(attrs)).select(*attrs.columns)
    key = lambda r: repr(r)
    assert sorted(map(key, back.collect())) == sorted(map(key, attrs.collect()))


def test_documents_of_orders_are_those_of_the_long_form(spark):
    day = datetime(1995, 3, 1)
    orders = spark.createDataFrame([(1, day, "1-URGENT", 5.5), (2, None, None, 0.0), (3, day, None, None), (4, day, None, None), (5, day, "low", None)], "o_orderkey long, o_orderdate timestamp_ntz, o_orderpriority string, o_totalprice double")
    lines = [(1, "R", "F", 46.0), (1, "A", "O", 1.0), (1, "R", "F", 46.0), (3, None, None, None), (5, None, "O", 9.0), (99, "R", "O", 50.0), (None, "R", "O", 50.0)]
    lineitem = spark.createDataFrame(lines, "l_orderkey long, l_returnflag string, l_linestatus string, l_quantity double")
    got, want = orders_as_docs(orders, lineitem), to_docs(orders_as_attrs(orders, lineitem))
    assert got.schema.simpleString() == want.schema.simpleString()
    plain = lambda docs: sorted((r.doc_type, r.doc_id, str(r.ts), [a.ord for a in r.attrs], sorted(map(repr, r.attrs))) for r in docs.collect())
    assert plain(got) == plain(want) and {r[1] for r in plain(got)} == {"1", "2", "5"}


def test_documents_of_orders_gather_no_attributes(spark, sf_dir):
    plan = QUERIES["multivalue_documents"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    gathered = [line for line in plan.splitlines() if "collect_list" in line]
    assert gathered and not [line for line in gathered if "vtype" in line or "v_str" in line]


def test_catalogue(attrs, spark):
    assert {r.key for r in documents.unique_keys(attrs, "t", "x").collect()} == {"x"}
    assert {r.value for r in documents.unique_values(attrs, "t", "x", "long").collect()} == {"1", "9", "5"}
    assert documents.delete(attrs, spark.createDataFrame([("t", "a")], "doc_type string, doc_id string")).select("doc_id").distinct().count() == 3


@pytest.mark.parametrize(("rows", "want"), [([(1, 2), (1, 2), (1, 50), (1, 2), (1, 2)], (5, 50)), ([(1, 2), (1, 2), (1, -1), (1, 2), (1, 2)], (5, -1))])
def test_cardinality_merge(spark, rows, want):
    t = spark.createDataFrame([("k", *r) for r in rows], "k string, cardinality long, expiration long")
    r = documents.merge_cardinality(t, ["k"]).first()
    assert (r.cardinality, r.expiration) == want


@pytest.mark.parametrize(("values", "variance"), [([1], 0.0), ([1, 1, 1, 5, 1], 2.56), ([1, 1, 5, 5, 5], 3.84), ([], 0.0), ([7, 7, 7], 0.0)])
def test_metric_moments(spark, values, variance):
    t = spark.createDataFrame([(v,) for v in values], "v long").agg(*features.summarise(F.col("v")))
    r = features.with_moments(t).first()
    assert r.variance == pytest.approx(variance) and r.std_dev == pytest.approx(variance**0.5)
    assert r["count"] == len(values) and r.mean == pytest.approx(sum(values) / len(values) if values else 0)


def test_moments_of_given_summaries(spark):
    t = spark.createDataFrame([(1, 1, 1, 5, 1), (0, 0, 0, 0, 0)], "min long, max long, sum long, count long, sum_square long")
    got = features.with_moments(t).orderBy("count").collect()
    assert got[0].mean == got[0].variance == 0.0 and got[1].mean == pytest.approx(0.2) and got[1].variance == pytest.approx(0.16)


def test_sum_of_squares_is_exact(spark):
    big = (1 << 62) + 12345
    r = spark.createDataFrame([(big,), (3,)], "v long").agg(*features.summarise(F.col("v"))).first()
    assert int(r.sum_square) == big * big + 9


def test_rollups_of_rollups_agree(spark):
    rows = [("g", "t", "n", "", datetime(2024, 1, d, h, 5 * h), d * h) for d in range(1, 9) for h in range(10)]
    f = spark.createDataFrame(rows, "grp string, type string, name string, vis string, ts timestamp_ntz, value long")
    both = features.rollups(f, ["MINUTES", "DAYS", "MONTHS"])
    for unit in ("DAYS", "MONTHS"):
        direct = {tuple(r) for r in features.rollup(f, unit).collect()}
        assert {tuple(r)[1:] for r in both.where(F.col("unit") == unit).collect()} == direct


def test_last_n(spark):
    rows = [("index1", str(i), 10_000 * i) for i in (1, 2, 3, 4)] + [("two", "b", 5), ("two", "a", 5)]
    t = spark.createDataFrame(rows, "grp string, id string, ts long")
    out = lastn.last_n(t, "grp", 3).collect()
    assert [r.ts for r in sorted(out, key=lambda r: r["rank"]) if r.grp == "index1"] == [40_000, 30_000, 20_000]
    assert [r.id for r in sorted(out, key=lambda r: r["rank"]) if r.grp == "two"] == ["a", "b"]


def test_ranges(spark):
    t = spark.createDataFrame([(1, 5, 10), (2, 90, 95), (3, 2, 98), (4, 20, 80), (5, 60, 50)], "id long, lo long, hi long")
    assert {r.id for r in ranges.overlapping(t.where("id < 5"), 49, 51).collect()} == {3, 4}
    assert {r.id for r in ranges.overlapping(t.where("id < 5"), 10, 20).collect()} == {1, 3, 4}
    ok = [r for r in t.collect() if r.lo <= r.hi]
    want = {(a.id, b.id) for a in ok for b in ok if a.lo <= b.hi and a.hi >= b.lo}
    for width in (1, 7, 1000):
        got = [(r.a_id, r.b_id) for r in ranges.overlap_join(t, t, width).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert ranges.delete(t, t.where("id = 1")).count() == 4


def test_overlaps_in_a_full_bin_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK", 64, raising=False)
    t = spark.range(1000).selectExpr("id", "id % 7 AS lo", "10 + id % 5 AS hi").coalesce(1)
    pairs = ranges.overlap_join(t, t, 100)
    shares = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert pairs.distinct().count() == sum(shares) == 1_000_000 and max(shares) < 100_000


def test_overlaps_of_constant_and_extreme_ends(spark):
    same = spark.range(70).selectExpr("id", "7L AS lo", "7L AS hi")
    assert ranges.overlap_join(same, same, 1).distinct().count() == 4900
    far = spark.createDataFrame([(1, -(1 << 62), 1 << 62), (2, 1 << 62, (1 << 62) + 1), (3, 0, 0)], "id long, lo long, hi long")
    assert sorted((r.a_id, r.b_id) for r in ranges.overlap_join(far, far, 1).collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 3)]


def test_overlapping_times_of_a_day_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK", 64, raising=False)
    lo = F.lit("2024-01-05").cast("timestamp_ntz") + F.make_interval(hours=(F.col("id") % 5).cast("int"))
    span = lambda n, days: spark.range(n).select("id", lo.alias("lo"), (lo + F.make_interval(days=F.lit(days))).alias("hi")).coalesce(1)
    pairs = ranges.overlap_join(span(2000, 900), span(500, 1), 5 * 86_400_000, millis)
    shares = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert pairs.distinct().count() == sum(shares) == 1_000_000 and max(shares) < 100_000


@pytest.mark.parametrize("width", [1, 30, 10_000])
def test_overlaps_of_blocks_and_lengths(spark, monkeypatch, width):
    monkeypatch.setattr(ranges, "BLOCK", 16, raising=False)
    rng = random.Random(width)
    make = lambda n: [(k, lo := rng.randrange(-900, 900), lo + rng.choice([-2, 0, 1, 25, 26, 130, 3000])) for k in range(n)]
    a, b = make(150) + [(0, 5, 9), (0, 5, 9), (1, None, 3)], make(110)
    frames = [spark.createDataFrame(x, "id long, lo long, hi long") for x in (a, b)]
    want = sorted((*x, *y) for x in a for y in b if None not in x and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and x[2] >= y[1])
    assert sorted(map(tuple, ranges.overlap_join(*frames, width).collect())) == want


def test_geo(spark):
    p = spark.createDataFrame([(1, "a", 76.7, 39.0), (2, "a", 74.0, 37.0), (3, "b", 79.0, 46.0), (4, "a", 79.1, 46.0)], "id long, type string, x double, y double")
    assert {r.id for r in geo.in_box(p, 74, 37, 5, 9).collect()} == {1, 2, 3}
    assert {r.id for r in geo.in_box_by_zorder(geo.with_zorder(p), 74, 37, 5, 9, ["a"]).collect()} == {1, 2}
    assert geo.with_zorder(spark.createDataFrame([(180.0, 90.0)], "x double, y double")).first().z == (1 << 32) - 1


def test_graph(spark):
    v = spark.createDataFrame([("Person", i, f"p{i}") for i in (1, 2, 3)], "type string, id long, name string")
    e = spark.createDataFrame([("brother", "Person", 1, "Person", 2), ("child", "Person", 2, "Person", 3), ("child", "Person", 1, "Person", 3), ("child", "Person", 1, "Person", 99)], "label string, head_type string, head_id long, tail_type string, tail_id long")
    one = v.where("id = 1")
    assert sorted(r.id for r in graph.adjacencies(one, e, v, "OUT").collect()) == [2, 3]
    assert sorted(r.id for r in graph.adjacencies(v.where("id = 3"), e, v, "IN", ["child"]).collect()) == [1, 2]
    assert sorted(r.id for r in graph.k_hops(v, e, v, "OUT", 1).collect()) == [2, 3, 3]
    walk = graph.Traversal(v, e).start(F.col("id") == 1).out("brother").out("child").has(C().eq("name", "p3").build()).frame().first()
    assert [p.id for p in walk.path] == [1, 2, 3]
    assert graph.Traversal(v, e).start(F.col("id") == 1).loop(2).frame().count() == 1


def test_change_trees(spark):
    rows = [(datetime(2024, 1, 1, 0, 5 * k, 1), f"h{k}") for k in (0, 1, 3, 3, 6)]
    mine = spark.createDataFrame(rows, "ts timestamp_ntz, hash string")
    theirs = spark.createDataFrame(rows[:4] + [(rows[4][0], "other")], "ts timestamp_ntz, hash string")
    args = (datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 34))
    a, b = (changelog.bucket_leaves(t, *args) for t in (mine, theirs))
    assert a.count() == 7
    assert [r.bucket for r in changelog.diff(a, b).collect()] == [1_704_067_200_000 + 6 * 300_000]
    assert changelog.changes(mine, changelog.diff(a, b)).count() == 1
    levels = changelog.tree(a, 7)
    assert [t.count() for t in levels] == [7, 4, 2, 1]
    assert levels[-1].first().hash != changelog.tree(b, 7)[-1].first().hash
    assert [t.count() for t in changelog.tree(a, 7, 3)] == [7, 3, 1]
    single = changelog.bucket_leaves(mine, args[0], args[0]), changelog.bucket_leaves(theirs.where("false"), args[0], args[0])
    assert changelog.diff(*single).count() == 0


def test_event_hash_ignores_order(spark):
    t = spark.createDataFrame([(1, [("a", "1", ""), ("b", "2", "")]), (1, [("b", "2", ""), ("a", "1", "")])], "id long, attrs array<struct<key:string,value:string,meta:string>>")
    assert t.select(changelog.event_hash(F.col("id"), F.col("attrs"))).distinct().count() == 1


def test_blobs(spark):
    data = bytes(range(256)) * 9
    t = spark.createDataFrame([("f", "x", data, 5, "ABC", {"n": "1"}), ("e", "x", b"", 5, "", {})], "key string, type string, data binary, ts long, vis string, properties map<string,string>")
    stored = blobs.chunks(t, 1024)
    assert stored.count() == 3 and {r.seq for r in stored.collect()} == {1, 2, 3}
    assert bytes(blobs.get(stored, ["ABC"]).first().data) == data and blobs.get(stored, []).count() == 0
    shorter = blobs.chunks(t.withColumn("data", F.lit(b"new")).withColumn("ts", F.lit(6).cast("long")), 1024)
    both = stored.unionByName(shorter)
    assert bytes(blobs.get(both.where("key = 'f'")).first().data) == b"new"
    assert blobs.sizes(stored).first()["size"] == len(data)
    assert blobs.properties(stored).first().properties == {"n": "1"}


def test_scalars(spark):
    t = spark.createDataFrame([(datetime(2024, 2, 29, 23, 59, 59, 123000), "http://a/b?x=1&x=a%20b&y&z=#f?q=1", "1.5e3", "yes")], "ts timestamp_ntz, url string, n string, b string")
    r = t.select(
        S.reverse_digits(F.col("ts")).alias("rd"), S.from_reverse_digits(S.reverse_digits(F.col("ts"))).alias("back"), S.bucket_floor(F.col("ts")).alias("bf"),
        S.url_pairs(F.col("url")).alias("u"), S.as_number(F.col("n")).alias("n"), S.as_number(F.col("b")).alias("bad"), S.as_boolean(F.col("b")).alias("b"),
        *(S.truncate(u, F.col("ts")).alias(u) for u in S.UNITS), S.from_reverse_millis(S.reverse_millis("HOURS", F.col("ts"))).alias("rm"),
        S.full_match(F.lit("a\nb"), "a.b").alias("m"), S.full_match(F.lit(None).cast("string"), ".*").alias("mn"), S.escape_key(F.lit("a.b c")).alias("k"),
        S.metadata(S.set_metadata(F.create_map(F.lit("v"), F.lit("1")), "w", F.lit("2")), "w").alias("mw"), S.metadata(S.set_metadata(F.create_map(F.lit("v"), F.lit("1")), "v", F.lit("")), "v", "none").alias("mv"),
    ).first()
    assert r.rd == 999999999999999999 - 20240229235959123 and r.back == t.first().ts
    assert [tuple(p) for p in r.u] == [("x", "1"), ("x", "a b"), ("y", ""), ("z", "")]
    assert (r.n, r.bad, r.b, r.m, r.mn, r.k, r.mw, r.mv) == (1500.0, None, True, True, False, "a$46$b$32$c", "2", "none")
    assert (r.MINUTES, r.MONTHS) == (datetime(2024, 2, 29, 23, 59), datetime(2024, 2, 1)) and r.bf % 300_000 == 0 and r.rm == 1_709_247_600_000


def test_json(spark):
    text = '{"id": 1, "user": {"name": "a", "tags": ["x", "y"], "none": null}, "list": [{"k": 2}, {"k": 3}]}'
    t = spark.createDataFrame([(7, text)], "row int, json string")
    leaves = tables.flatten_json(t, "json", "id long, user struct<name:string,tags:array<string>,none:string>, list array<struct<k:int>>")
    assert sorted((r.row, r.key, r.value) for r in leaves.collect()) == [(7, "id", "1"), (7, "list_$k", "2"), (7, "list_$k", "3"), (7, "user_$name", "a"), (7, "user_$tags", "x"), (7, "user_$tags", "y")]
    assert tables.expand_json(leaves, ["row"]).first().json == '{"id":"1","list.k":["2","3"],"user.name":"a","user.tags":["x","y"]}'


def test_layout(spark, attrs, tmp_path):
    stamped = attrs.withColumn("ts", F.lit("2024-01-02").cast("timestamp_ntz"))
    tables.save_events(stamped, str(tmp_path / "e"), 3)
    assert (tmp_path / "e" / "day=2024-01-02").is_dir()
    assert tables.load_attrs(spark, str(tmp_path / "e")).count() == attrs.count()
    tables.save_entities(attrs, str(tmp_path / "n"), 3)
    assert {r.doc_id for r in documents.get_all_by_type(tables.load_attrs(spark, str(tmp_path / "n")), ["t"]).collect()} == {"a", "b", "c", "d"}
    assert tables.shard_splits(spark, "1969-01-01", "1969-01-01").count() == 181
    assert tables.shard_splits(spark, "1969-01-01", "1969-01-02").count() == 181 and tables.shard_splits(spark, "1969-01-01", "1969-01-03").count() == 362
    tables.save_grouped(attrs.withColumn("group", F.col("key")), str(tmp_path / "g"))
    assert (tmp_path / "g" / "group=x").is_dir()
    parts = tables.range_partitioned(attrs, 3, "doc_id", "key").select("doc_id", F.spark_partition_id().alias("p")).collect()
    assert sorted(parts, key=lambda r: r.p) == sorted(parts, key=lambda r: (r.p, r.doc_id))
