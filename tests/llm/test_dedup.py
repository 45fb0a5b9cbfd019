import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gritstone.llm import components, line_dedup, mphf, near_dedup, substring_dedup
from gritstone.llm.queries import ORACLE_SQL, QUERIES
from tests import oracle

from . import cases


def key(text):
    return " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower()))


def texts(seed, n=80):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("the of and tion ther ing é ß ñandú a".split()) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    return [(i, "\n".join(rng.choice(pool).title() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(n)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    oracle.same(QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), ORACLE_SQL[name])


def test_perfect_hash_is_minimal_and_marks_are_checked():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    sizes, bits = mphf.build(keys)
    slot = mphf.lookup(sizes, bits, mphf.ranks(bits), keys)
    assert sorted(slot.tolist()) == list(range(len(keys)))
    assert len(bits) * 64 / len(keys) < 4.5
    other = rng.integers(0, 1 << 63, len(keys), dtype=np.uint64)
    shard = line_dedup.Shard(memoryview(line_dedup.Shard.pack(keys, other, np.arange(len(keys)) + 2, np.arange(len(keys)))))
    count, owner = shard.probe(keys, other)
    assert (count == np.arange(len(keys)) + 2).all() and (owner == np.arange(len(keys))).all()
    assert not shard.probe(rng.integers(0, 1 << 63, 9_999, dtype=np.uint64), rng.integers(0, 1 << 63, 9_999, dtype=np.uint64))[0].any()
    assert not line_dedup.Shard(memoryview(line_dedup.Shard.pack(*(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))))).probe(keys, keys)[0].any()


def brute_lines(rows, min_count=2, min_words=2):
    seen, first = defaultdict(int), {}
    for i, t in sorted((r for r in rows if r[1]), key=lambda r: r[0]):
        for k, line in enumerate(t.split("\n")):
            seen[key(line)] += 1
            first.setdefault(key(line), (i, k))
    out = {}
    for i, t in rows:
        kept = [line for k, line in enumerate((t or "").split("\n")) if len(key(line).split()) < min_words or seen[key(line)] < min_count or first[key(line)] == (i, k)]
        out[i] = "\n".join(kept) if t else t
    return out


@pytest.mark.parametrize("shard_size", [5, 1_000_000])
def test_lines_against_brute_force(spark, shard_size):
    rows = texts(1)
    for least in (2, 4):
        got = line_dedup.dedup_lines(cases.docs(spark, rows), least, 2, shard_size).collect()
        assert {r.doc_id: r.text for r in got} == brute_lines(rows, least)


def test_line_dedup_of_odd_tables(spark):
    out = line_dedup.dedup_lines(cases.clashing(cases.odd(spark)))
    rows = out.collect()
    assert len(rows) == 11 and {"lane0", "owner", "row", "n_chars"} <= set(out.columns)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r.text)
    assert by[1] == [None] and by[2] == [""] and by[6] == ["one", "one"] and by[4] == [cases.LONG] and by[5] == [cases.HUGE_WORD]
    assert line_dedup.dedup_lines(cases.empty(spark)).count() == 0
    same = [(9, "same line here\nmore of it"), (9, "same line here\nmore of it"), (3, "Same, line here!"), (None, "same line here")]
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.dedup_lines(cases.docs(spark, same)).collect())
    assert got == [("3", "Same, line here!"), ("9", "more of it"), ("9", "more of it"), ("None", "")]


WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def brute_passages(rows, least, near):
    """What each document loses, told word by word: character spans and who keeps them."""
    words = {i: [(m.group(), *m.span()) for m in WORD.finditer(t.lower())] for i, t in rows}
    units, first = {}, {}
    for i in sorted(words):
        w = [x[0].encode() for x in words[i]]
        cuts = {0, len(w)} | {max(range(k, k + near), key=lambda j: (min(255, len(w[j])), w[j][:7], -j)) for k in range(len(w) - near + 1)}
        starts = [c for c in sorted(cuts) if c + least <= len(w)]
        units[i] = {(c, min(z for z in cuts if z >= c + least)) for c in starts} | {(c, len(w)) for c in starts[-1:]}
        for a, z in sorted(units[i]):
            first.setdefault(tuple(w[a:z]), (i, a))
    out = {}
    for i, own in units.items():
        w = [x[0].encode() for x in words[i]]
        stays = {k for a, z in own if first[tuple(w[a:z])] == (i, a) and sum(tuple(w[a:z]) == tuple(x[0].encode() for x in words[j][b:e]) for j in units for b, e in units[j]) > 1 for k in range(a, z)}
        later = [(a, z, first[tuple(w[a:z])][0]) for a, z in own if first[tuple(w[a:z])] != (i, a)]
        goes = sorted({k for a, z, _ in later for k in range(a, z)} - stays)
        spans = []
        for k in goes:
            if spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
            else:
                spans.append([k, k + 1])
        place = [x[1] for x in words[i]] + [words[i][-1][2] if w else 0]
        if spans:
            out[i] = [(place[a], place[z], min(o for x, y, o in later if x < z and a < y)) for a, z in spans]
    return out


def lost(rows):
    return {r.doc_id: list(zip(r.begins, r.ends, r.kept_in, strict=True)) for r in rows}


@pytest.mark.parametrize("seed", [2, 3])
def test_passages_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("the of and tion, ther. ing é ß ñandú a Ünder whatever".split()) for _ in range(rng.randint(0, 30))) for _ in range(25)]
    rows = [(i, rng.choice(["", "- ", "\n"]) + rng.choice(["\n", " ", ". "]).join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(50)]
    rows += [(60, "x " * 90), (61, "y x " * 50 + "z")]
    want = brute_passages(rows, 9, 5)
    got = substring_dedup.dedup_passages(cases.docs(spark, rows), 9, 5).collect()
    assert lost(got) == want and len(want) > 20 and any(len(v) > 1 for v in want.values())
    for r in got:
        left = dict(rows)[r.doc_id]
        for b, e in reversed(list(zip(r.begins, r.ends, strict=True))):
            left = left[:b] + left[e:]
        assert r.text == left


def test_passages_of_odd_tables(spark):
    assert substring_dedup.dedup_passages(cases.empty(spark)).count() == 0
    assert substring_dedup.dedup_passages(cases.clashing(cases.odd(spark))).count() == 0
    copy = " ".join(f"é{k}" for k in range(25))
    rows = [(5, f"x {copy}"), (None, copy.upper()), (5, f"y\n\n{copy}!"), (2, f"{copy}\ntail"), (8, cases.LONG + "\n" + copy), (None, cases.LONG.upper())]
    got = sorted((str(r.doc_id), r.text, r.kept_in) for r in substring_dedup.dedup_passages(cases.docs(spark, rows), 9, 5).collect())
    assert [g[0] for g in got] == ["5", "5", "8", "None", "None"] and {tuple(g[2]) for g in got} <= {(2,), (8,)}
    assert all(len(g[1]) < len(copy) for g in got[:2]) and len(cases.LONG) < len(got[2][1]) < len(cases.LONG) + len(copy) and all(len(g[1]) < 100 for g in got[3:])
    with pytest.raises(TypeError, match="doc_id must be of an integer type"):
        substring_dedup.dedup_passages(cases.docs(spark, rows).withColumn("doc_id", F.concat(F.lit("urn:"), "doc_id")))


def test_passages_inside_lines_and_across_short_ones(spark):
    rng = random.Random(8)

    def words(n):
        return [f"w{rng.randrange(5000)}" for _ in range(n)]

    passages = [words(51 + k % 30) for k in range(60)]
    rows = [(1, "\n".join(" ".join(words(30) + p + words(9)) for p in passages))]
    for k, p in enumerate(passages):
        wrapped = "\n".join(" ".join(p[i : i + 7]) for i in range(0, len(p), 7))
        rows += [(100 + k, " ".join(words(13)) + " " + wrapped + " " + " ".join(words(40))), (200 + k, " ".join(words(200)))]
    got = {r.doc_id: r for r in substring_dedup.dedup_passages(cases.docs(spark, rows)).collect()}
    assert set(got) == set(range(100, 160))
    for i, r in got.items():
        gone = [w for b, e in zip(r.begins, r.ends, strict=True) for w in dict(rows)[i][b:e].split()]
        assert len(gone) >= 20 and set(gone) <= set(passages[i - 100]) and r.kept_in == [1]


def near_copies(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    out = []
    for base in range(25):
        text = [rng.choice(words) for _ in range(rng.choice([3, 40, 200]))]
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            copy = [rng.choice(words) if rng.random() < 0.04 else w for w in text]
            out.append((len(out), " ".join(copy) + rng.choice(["", ".", "\n"])))
    return out


@pytest.mark.parametrize("one_task_edges", [0, 10_000])
def test_near_copies_against_all_pairs(spark, one_task_edges):
    rows = near_copies(3)
    ids, sig = near_dedup.signatures(pa.array([t for _, t in rows]))
    a, b = [], []
    for i in range(len(ids)):
        j = i + 1 + np.flatnonzero((sig[i + 1 :] == sig[i]).sum(axis=1) >= near_dedup.MIN_EQUAL)
        a += [rows[ids[i]][0]] * len(j)
        b += [rows[ids[k]][0] for k in j]
    node, root = components.label_edges(np.array(a), np.array(b))
    want = {(int(n), int(r)) for n, r in zip(node, root, strict=True) if n != r}
    got = {tuple(r) for r in near_dedup.near_duplicates(cases.docs(spark, rows), one_task_edges=one_task_edges).collect()}
    assert got == want and len(want) > 50
    kept = near_dedup.drop_near_duplicates(cases.clashing(cases.docs(spark, rows)))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {a for a, _ in want}


def test_near_copies_have_the_jaccard_similarity_asked_for(spark):
    rng = random.Random(5)
    rows, near, far = [], set(), set()
    for k in range(60):
        text = [f"v{rng.randrange(9000)}" for _ in range(300)]
        rate = rng.choice([0.02, 0.05, 0.6])
        other = [f"z{rng.randrange(9000)}" if rng.random() < rate else w for w in text]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
        (far if rate == 0.6 else near).add(2 * k + 1)
    got = {r.doc_id for r in near_dedup.near_duplicates(cases.docs(spark, rows)).collect()}
    assert len(got & near) >= 0.9 * len(near) and not got & far


def test_near_copies_in_odd_tables(spark):
    assert near_dedup.near_duplicates(cases.empty(spark)).count() == 0
    assert near_dedup.near_duplicates(cases.clashing(cases.odd(spark))).count() == 0
    rows = [(4, "One two."), (3, "one TWO"), (3, "one two"), (None, "one two"), (9, "one"), (8, "one"), (1, "")]
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(cases.docs(spark, rows)).collect()) == [(4, 3), (9, 8)]


def test_shared_postings_are_right_for_any_batches(monkeypatch):
    monkeypatch.setattr(near_dedup, "_FREQUENT", 7)
    rng = random.Random(1)
    keys = sorted(rng.choice([rng.randrange(40), 5, 5, 33]) for _ in range(400))
    batch = pa.RecordBatch.from_pydict({"key": keys, "doc": list(range(len(keys)))})
    for size in (1, 3, 50, 1000):
        got = [r for b in near_dedup._shared(batch.slice(i, size) for i in range(0, len(keys), size)) for r in b.to_pylist()]
        want = {i: min(keys.count(k), 7) for i, k in enumerate(keys) if keys.count(k) > 1}
        assert {r["doc"]: r["n"] for r in got} == want and len(got) == len(want)
