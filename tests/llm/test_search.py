import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from gritstone.llm import components, decontaminate, embedding_dedup, pieces, token_counts
from gritstone.llm.shared import fresh_path, write_file

from . import cases

# -- decontamination


def brute_overlaps(docs, items, window, min_match):
    """Item and document laid along each other at every offset; without any seeds."""
    out = set()
    for i, text in docs:
        a = (text or "").lower().split()
        for k, item in items:
            b = (item or "").lower().split()
            w = min(window, len(b))
            for shift in range(-len(b), len(a)):
                same = [0 <= q + shift < len(a) and a[q + shift] == b[q] for q in range(len(b))]
                if any(sum(same[q : q + w]) >= min_match * w - 1e-9 and q + shift >= 0 and q + shift + w <= len(a) for q in range(len(b) - w + 1)):
                    out.add((i, k))
    return out


def leaks(seed):
    rng = random.Random(seed)
    words = ["the", "of", "and"] + [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(3, 40)))) for k in range(25)]
    docs = []
    for i in range(60):
        body = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.6:
            part = rng.choice(items)[1].split()
            part = part[: rng.randint(1, len(part))]
            part = [rng.choice(words) if rng.random() < rng.choice([0, 0.1, 0.3]) else w for w in part]
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs.append((i, " ".join(body)))
    return docs, items


@pytest.mark.parametrize("pass_bytes", [300, 1 << 20])
def test_overlaps_against_brute_force(spark, pass_bytes):
    docs, items = leaks(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_overlaps(cases.docs(spark, docs), bench, pass_bytes=pass_bytes).collect()
    found = {(r.doc_id, r.item_id) for r in out}
    every = brute_overlaps(docs, items, decontaminate.WINDOW, decontaminate.MIN_MATCH)
    # Items of a window and more are all found; shorter ones with a replaced token may have no stretch that a mask sees.
    long = {k for k, t in items if len(t.split()) >= decontaminate.WINDOW}
    want = {(i, k) for i, k in every if k in long}
    assert {(i, k) for i, k in found if k in long} == want and len(want) > 15
    assert found <= every and len(found) >= 0.8 * len(every)
    text = dict(docs)
    for r in out:
        assert len(text[r.doc_id][r.begin : r.end].split()) == r.n_tokens >= r.n_agree >= 0.6 * r.n_tokens
    want = found
    left = decontaminate.drop_contaminated(cases.clashing(cases.docs(spark, docs)), bench, pass_bytes=pass_bytes)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_three_of_twelve_tokens_may_differ_anywhere():
    item = [f"t{k}" for k in range(12)]
    seeds = decontaminate.make_seeds(pa.array([0]), pa.array([" ".join(item)]))
    texts = [" ".join("other" if k in gone else t for k, t in enumerate(item)) for gone in combinations(range(12), 3)]
    assert sorted(set(decontaminate.overlaps(seeds, pa.array(texts))["row"].tolist())) == list(range(len(texts)))


def test_stretches_apart_are_overlaps_of_their_own(spark):
    item = [f"t{k}" for k in range(60)]
    text = " ".join(["x", *item[:15], *(f"o{k}" for k in range(30)), *item[45:], "y"])
    rows = decontaminate.find_overlaps(cases.docs(spark, [(1, text)]), spark.createDataFrame([(4, " ".join(item))], "item_id long, text string")).orderBy("begin").collect()
    assert len(rows) == 2 and all(r.n_agree >= 0.75 * r.n_tokens and 15 <= r.n_tokens <= 18 for r in rows)
    assert {"t0", "t14"} <= set(text[rows[0].begin : rows[0].end].split()) and {"t45", "t59"} <= set(text[rows[1].begin : rows[1].end].split())


def test_seeds_of_many_items_are_looked_up_in_parts(monkeypatch):
    items = [f"what is the answer to this question number {k}" for k in range(300)]
    seeds = decontaminate.make_seeds(pa.array(range(300)), pa.array(items))
    docs = pa.array(["and what is the answer to this question number 7", "what is the answer to this question number 8 what is"])
    whole = {k: v.tolist() for k, v in decontaminate.overlaps(seeds, docs).items()}
    monkeypatch.setattr(decontaminate, "_CHUNK", 50)
    assert {k: v.tolist() for k, v in decontaminate.overlaps(seeds, docs).items()} == whole and len(whole["row"]) == 600


def test_substitutions_are_tolerated(spark):
    rng = random.Random(3)
    items = [(k, " ".join(f"u{rng.randrange(10_000)}" for _ in range(30))) for k in range(100)]
    docs = []
    for k, t in items:
        part = [f"s{k}" if rng.random() < 0.12 else w for w in t.split()]
        docs.append((k, "x y z " + " ".join(part) + " p q"))
    got = decontaminate.find_overlaps(cases.docs(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert len({r.doc_id for r in got.collect()}) >= 97


def test_overlaps_of_odd_tables(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (None, "Alpha, BETA gamma delta epsilon zeta!"), (3, None), (4, ""), (5, "alpha beta"), (1, "alpha beta gamma delta epsilon zeta")]
    bench = spark.createDataFrame([(None, rows[0][1], "x"), (7, rows[0][1], "y"), (8, None, "z"), (9, "", "z"), (10, "two words", "z")], "item_id long, text string, doc_id string")
    got = sorted(str((r.doc_id, r.item_id)) for r in decontaminate.find_overlaps(cases.docs(spark, rows), bench).collect())
    assert got == sorted(str(x) for x in [(1, None), (1, None), (1, 7), (1, 7), (None, None), (None, 7)])
    odd = cases.clashing(cases.odd(spark))
    assert decontaminate.find_overlaps(odd, bench).count() == 0 and decontaminate.drop_contaminated(odd, bench).count() == 11
    assert decontaminate.find_overlaps(cases.empty(spark), bench).count() == 0
    assert decontaminate.drop_contaminated(odd, bench.limit(0)).count() == 11


# -- embeddings


def vectors(seed, n, d, clusters):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 3 * rng.normal(size=(clusters, d))[rng.integers(0, clusters, n)]
    for _ in range(n // 4):
        i, j = rng.integers(0, n, 2)
        x[i] = x[j] + rng.normal(size=d) * rng.uniform(0, 0.12) * np.linalg.norm(x[j]) / np.sqrt(d) * 4
    return x


@pytest.mark.parametrize(("n", "clusters", "block_rows"), [(1500, 1, 4096), (1500, 8, 60), (40, 3, 5)])
def test_vectors_against_all_pairs(spark, n, clusters, block_rows):
    x = vectors(n, n, 24, clusters)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.97, 1))
    node, root = components.label_edges(a, b)
    want = {int(v) for v, r in zip(node, root, strict=True) if v != r}
    t = spark.createDataFrame([(i, [float(v) for v in row], "c") for i, row in enumerate(x)], "vec_id long, embedding array<float>, unit string")
    got = {r.vec_id for r in embedding_dedup.near_duplicate_vectors(t, 0.97, block_rows=block_rows).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.01 * len(want) + 1 and want
    assert embedding_dedup.drop_near_duplicate_vectors(t, min_cosine=0.97).count() == n - len(embedding_dedup.near_duplicate_vectors(t, 0.97).collect())


def test_few_copies_and_high_recall_of_uniform_vectors():
    rng = np.random.default_rng(3)
    b, e = (rng.normal(size=(4000, 64)) for _ in range(2))
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    e -= (e * b).sum(axis=1, keepdims=True) * b
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    x = np.concatenate([b, 0.905 * b + (1 - 0.905**2) ** 0.5 * e]).astype(np.float32)
    c = x[rng.permutation(8000)[:90]]
    for _ in range(4):
        near = embedding_dedup.nearest(x, c)
        c = np.stack([x[near == k].sum(axis=0) for k in range(90)])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    row, cell, home = embedding_dedup.cells_of(x, c, embedding_dedup.REACH * 0.2**0.5 / 8)
    own, places = np.empty(8000, int), set(zip(row.tolist(), cell.tolist(), strict=True))
    own[row[home]] = cell[home]
    met = [(k, own[k + 4000]) in places or (k + 4000, own[k]) in places for k in range(4000)]
    assert len(row) <= 4 * 8000 and np.mean(met) > 0.97 and len(places) == len(row)


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(TypeError, match="vec_id must be of an integer type"):
        embedding_dedup.near_duplicate_vectors(spark.createDataFrame([("urn:a", [1.0])], "vec_id string, embedding array<float>"))


def test_many_copies_of_one_vector(spark):
    t = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(300)], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in embedding_dedup.near_duplicate_vectors(t, block_rows=32).collect()} == {(i, 0) for i in range(1, 300)}


def test_odd_vectors_have_no_partner(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [3.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (9, [float("inf"), 0.0])]
    t = cases.clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in embedding_dedup.near_duplicate_vectors(t).collect()] == [(2, 1)]
    assert embedding_dedup.drop_near_duplicate_vectors(t).count() == 10
    for none in (t.limit(0), t.where("vec_id = 5"), t.where("vec_id = 3")):
        assert embedding_dedup.near_duplicate_vectors(none).count() == 0


# -- tokens


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


TEXTS = ["hello world", " lead", "  two  spaces ", "", None, " ", "   ", "a▁b ▁ c", "tab\tnew\nline \n x", "émoji 😀 ж", "x " * 50, "</s> <s> <unk> <0x41>", "á   b", "\x00", cases.LONG]


@pytest.mark.parametrize("table_chunks", [1, 3, 300_000])
def test_chunks_encode_like_whole_texts(model, table_chunks):
    codec = pieces.Codec(pieces.model_path(), table_chunks)
    assert codec.by_chunk
    for _ in range(2):
        ids, off = codec.encode(pa.array(TEXTS))
        for i, t in enumerate(TEXTS):
            assert ids[off[i] : off[i + 1]].tolist() == model.encode(t or "")
        assert codec.decode(ids, off).to_pylist() == [model.decode(model.encode(t or "")) for t in TEXTS]
    codec.by_chunk = False
    ids, off = codec.encode(pa.array(TEXTS))
    assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(TEXTS))] == [model.encode(t or "") for t in TEXTS]


def test_documents_survive_the_round_trip(spark, sf_dir, model):
    docs = cases.clashing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    coded = pieces.encode(docs)
    rows = coded.collect()
    assert all(r.decodes and r.n_ids == len(r.ids) and r.ids == model.encode(r.text) for r in rows)
    back = {r.doc_id: r.text for r in pieces.decode(coded.drop("text")).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


def test_encoding_of_odd_tables(spark, model):
    rows = pieces.encode(cases.clashing(cases.odd(spark))).collect()
    assert len(rows) == 11
    for r in rows:
        assert (r.ids, r.n_ids, r.decodes) == ((None, None, None) if r.text is None else (model.encode(r.text), len(r.ids), model.decode(r.ids) == r.text))
    assert pieces.encode(cases.empty(spark)).count() == 0
    t = spark.createDataFrame([(1, None), (2, []), (3, [5000, -4, 99_999, 200, 201, None])], "id int, ids array<int>")
    assert {r.id: r.text for r in pieces.decode(t).collect()} == {1: None, 2: "", 3: model.decode([5000]) + "��"}


@pytest.mark.parametrize("block_tokens", [1, 2, 7, 1000])
def test_token_counts_against_a_walk(spark, block_tokens):
    rng = np.random.default_rng(block_tokens)
    folder, want = fresh_path(spark, "walk"), {}
    for k in range(8):
        tokens = rng.integers(2, 5 if k % 2 else 40, int(rng.integers(0, 70))).astype("<u2")
        write_file(f"{folder}/f{k}.bin", tokens.tobytes())
        lengths, n = [], 0
        for t in tokens:
            n += 1
            if t == 2:
                lengths.append(n - 1)
                n = 0
        want |= {(f"f{k}.bin", i): m for i, m in enumerate([*lengths, n] if n else lengths)}
    got = {(r.file, r.ordinal): r.n_tokens for r in token_counts.count_tokens(spark, folder, 2, 16, block_tokens).collect()}
    assert got == want


def test_chunk_table_with_hashes_that_clash():
    rng = np.random.default_rng(2)
    table = pieces.ChunkTable()
    hashes = rng.integers(0, 50, 90_000).astype(np.uint64) << np.uint64(40)  # all of them want a few slots
    hashes[::3] = rng.integers(0, 1 << 63, 30_000, dtype=np.uint64)
    pairs = np.unique(np.stack([hashes[:2_000], np.arange(2_000, dtype=np.uint64)]), axis=1)
    spread = np.stack([hashes[::3], np.arange(30_000, dtype=np.uint64)])
    for part in (pairs, spread[:, 1_000:9_000], spread[:, 9_000:]):
        table.add(*part)
    every = np.concatenate([pairs, spread[:, 1_000:]], axis=1)
    assert len(table) == every.shape[1] and (table.find(*every) == np.arange(every.shape[1])).all()
    assert (table.find(every[0], every[1] + np.uint64(1 << 40)) == -1).all() and len(table.find(*every[:, :0])) == 0


def test_token_counts_of_documents(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.op9_token_counts(spark, sf_dir).collect()}
    assert got == {r.doc_id: len(model.encode(r.text)) for r in docs.collect()}
    folder = fresh_path(spark, "odd")
    places = token_counts.write_token_files(cases.clashing(cases.odd(spark)), folder)
    rows = places.join(token_counts.count_tokens(spark, folder, 2, block_tokens=1000), ["file", "ordinal"]).collect()
    texts = sorted(len(model.encode(t or "")) for t in (r.text for r in cases.odd(spark).collect()))
    assert sorted(r.n_tokens for r in rows) == texts and sum(r.doc_id is None for r in rows) == 2
    folder = fresh_path(spark, "none")
    assert token_counts.write_token_files(cases.empty(spark), folder).count() == 0
    assert token_counts.count_tokens(spark, folder, 2).count() == 0
    write_file(f"{folder}/cut.bin", b"\x05\x00\x02")
    with pytest.raises(ValueError, match="cut.bin"):
        token_counts.count_tokens(spark, folder, 2)
