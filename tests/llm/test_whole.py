"""The registered queries on whole tables, against plain Python that goes one document, vector or pair at a time."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece

from gritstone.llm import decontaminate, embedding_dedup, near_dedup, pieces, pii, quality, string_kernel, toxicity
from gritstone.llm.queries import QUERIES

from .test_search import brute_overlaps

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark, d):
    return {r.doc_id: r.text for r in table(spark, d, "documents").select("doc_id", "text").collect()}


def groups(ids, linked):
    """Each id's smallest one of those it is linked with, over any number of links."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def statistics(text):
    """The quality features of one text, character by character."""
    raw = text.encode()
    words = WORD.findall(text.lower())
    n = len(words)

    def count(chars):
        return sum(b in chars for b in raw)

    upper, lower, other = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw), sum(b >= 128 for b in raw)
    some, size = max(n, 1), max(len(raw), 1)
    return [
        math.log1p(n), sum(len(w.encode()) for w in words) / some, count(b"%$&#*@^~<>{}[]_+=\\/") / size, count(b"|") / some, count(b"!?") / some, upper / max(upper + lower, 1),
        count(b"0123456789") / size, sum(a == b for a, b in zip(words, words[1:])) / some, sum(a == b for a, b in zip(words, words[2:])) / some,
        sum(len(w.encode()) <= 3 for w in words) / some, n / (count(b"\n") + 1), n / (count(b".") + 1), other / size,
    ]


def test_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    m = quality.train(docs, labels)
    want = {}
    for i, t in texts(spark, sf_dir).items():
        x = statistics(t or "")
        score = m.intercept + sum(tab[sum(e <= v for e in edges)] for tab, edges, v in zip(m.tables, m.edges, x, strict=True))
        score += sum(tab[sum(e <= x[a] for e in m.coarse[a]), sum(e <= x[b] for e in m.coarse[b])] for (a, b), tab in zip(m.pairs, m.pair_tables, strict=True))
        p = 1 / (1 + math.exp(-max(-30, min(30, score))))
        if p >= m.threshold and x[0] > 0:
            want[i] = p
    got = {r.doc_id: r.quality_score for r in QUERIES["op1_quality"](spark, sf_dir).collect()}
    assert set(got) == set(want) and 0 < len(got) < docs.count() and all(math.isclose(got[i], want[i], abs_tol=1e-9) for i in got)


def test_decontamination(spark, sf_dir):
    docs, items = texts(spark, sf_dir), {r.item_id: r.text for r in table(spark, sf_dir, "benchmark").collect()}
    got = QUERIES["op2_decontamination"](spark, sf_dir).collect()
    # Any overlap has four tokens running, or at every other place, that agree; documents without are none of the brute force's business.
    words = {k: WORD.findall(t.lower()) for k, t in items.items()}
    grams = {(s, *w[i : i + 3 * s : s]) for w in words.values() for s in (1, 2) for i in range(len(w) - 2 * s)}
    near = [(i, w) for i, t in docs.items() if t for w in [WORD.findall(t.lower())] if any((s, *w[j : j + 3 * s : s]) in grams for s in (1, 2) for j in range(len(w) - 2 * s))]
    want = brute_overlaps([(i, " ".join(w)) for i, w in near], [(k, " ".join(w)) for k, w in words.items()], decontaminate.WINDOW, decontaminate.MIN_MATCH)
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    for r in got:
        assert len(WORD.findall(docs[r.doc_id][r.begin : r.end].lower())) == r.n_tokens >= r.n_agree


def test_near_dedup(spark, sf_dir):
    docs = {i: t for i, t in texts(spark, sf_dir).items() if t and WORD.search(t.lower())}
    import pyarrow as pa

    rows, sig = near_dedup.signatures(pa.array(list(docs.values())))
    ids = [list(docs)[r] for r in rows]
    links = [(ids[a], ids[b]) for a in range(len(ids)) for b in np.flatnonzero((sig[a + 1 :] == sig[a]).sum(axis=1) >= near_dedup.MIN_EQUAL) + a + 1]
    want = {(i, r) for i, r in groups(ids, links).items() if i != r}
    assert {tuple(r) for r in QUERIES["op3_minhash_near_dedup"](spark, sf_dir).collect()} == want and want


@pytest.mark.parametrize("block", [3, 1024])
def test_lists_meet_in_blocks(spark, sf_dir, block):
    whole = {tuple(r) for r in QUERIES["op3_minhash_near_dedup"](spark, sf_dir).collect()}
    assert {tuple(r) for r in near_dedup.near_duplicates(table(spark, sf_dir, "documents"), block=block, one_task_edges=0).collect()} == whole


def units_of(text):
    """Units of one text with their places."""
    raw = text.lower().encode()
    out, at = [], 0
    for part in re.split(rb"[ \t\r\n,;:!?/|()\"<>\[\]{}=]", raw):
        out.append((at - 1 if at else 0, bytes(b for b in part if chr(b).isalnum() and b < 128 or b >= 128)))
        at += len(part) + 1
    out = [u for u in out if u[1]]
    spelt, run = [], []
    for u in [*out, (0, b"--")]:
        if len(u[1]) == 1:
            run.append(u)
        else:
            if len(run) >= 3:
                spelt.append((run[0][0], b"".join(x[1] for x in run)))
            run = []
    width, found = string_kernel.WIDTH - 1, []
    for place, u in out + spelt:
        found += [(place, u)] if len(u) <= width else [(place, u[b : b + width]) for b in range(0, len(u) - width + width // 2, width // 2)]
    return [(p, u) for p, u in found if len(u) >= string_kernel.ORDER]


def test_toxicity(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    m = toxicity.train(docs, labels)
    units = {i: units_of(t or "") for i, t in texts(spark, d).items()}
    names = sorted({u for own in units.values() for _, u in own})
    values = (string_kernel.kernel(string_kernel.matrix([b"^" + u for u in names]), list(m.landmarks)) ** toxicity.POWER @ m.weights + m.bias).tolist()
    score = {u: -math.inf if b"^" + u in m.benign else v for u, v in zip(names, values, strict=True)}

    def counts(found):
        out = [0] * len(m.bands)
        for s in found:
            if (band := sum(b < s for b in m.bands) - 1) >= 0:
                out[band] += 1
        return out

    def control(hits, n):
        return max(1.0, (hits[0] + 2) / (m.rates[0] * n + 2))

    def evidence(hits, n, other=1.0):
        more = [(h, m.rates[b] * n * max(control(hits, n), other)) for b, h in enumerate(hits)][1:]
        return sum(h * math.log(h / e) - h + e for h, e in more if h > e)

    want, close = set(), set()
    for i, own in units.items():
        hits = counts(score[u] for u in {u for _, u in own})
        total = evidence(hits, len(own))
        places = sorted(p for p, _ in own)
        windows = defaultdict(list)
        for p, u in own:
            at = sum(q < p for q in places) // (toxicity.WINDOW // 2) if score[u] > m.bands[0] else -1
            for w in {at, at - 1} if at > 0 else {at}:
                windows[w].append(score[u])
        windows.pop(-1, None)
        local = max((evidence(counts(s), min(len(own), toxicity.WINDOW), control(hits, len(own))) for s in windows.values()), default=0)
        if total > m.threshold or local > m.local:
            want.add(i)
        if abs(total - m.threshold) < 1e-3 or abs(local - m.local) < 1e-3:
            close.add(i)
    got = {r.doc_id for r in QUERIES["op4_toxicity"](spark, d).collect()}
    assert got - close == want - close and len(want) > 20 and len(close) < 3


def test_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").collect()
    x = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(r.embedding) for r in rows}
    ids = sorted(x)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if x[a] @ x[b] >= embedding_dedup.MIN_COSINE]
    want = {i for i, r in groups(ids, links).items() if i == r}
    got = {r.vec_id for r in QUERIES["op7_embedding_near_dedup"](spark, sf_dir).collect()}
    assert want <= got and len(got - want) <= 0.05 * (len(ids) - len(want))


def test_tokens(spark, sf_dir):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    docs = texts(spark, sf_dir)
    coded = {r.doc_id: r for r in QUERIES["op8_sentencepiece"](spark, sf_dir).collect()}
    want = {i: None if t is None else sp.encode(t) for i, t in docs.items()}
    assert {i: r.ids for i, r in coded.items()} == want and all(r.decodes for r in coded.values() if r.ids is not None)
    assert {r.doc_id: r.n_tokens for r in QUERIES["op9_token_counts"](spark, sf_dir).collect()} == {i: len(v or []) for i, v in want.items()}


def test_personal_data(spark, sf_dir):
    m, want = pii.detector(), Counter()
    for i, t in texts(spark, sf_dir).items():
        scored = [(float(m.trees.probability(np.array([pii.describe(t, s)]))[0]), s) for s in pii.candidates(t or "")]
        taken = []
        for p, s in sorted(scored, key=lambda x: (-x[0], x[1].begin - x[1].end, x[1].begin, x[1].kind)):
            if p >= m.thresholds[s.kind] and all(s.end <= o.begin or o.end <= s.begin for o in taken):
                taken.append(s)
                want[i, s.begin, s.end, pii.KINDS[s.kind]] += 1
    assert Counter(tuple(r)[:4] for r in QUERIES["op10_pii"](spark, sf_dir).collect()) == want and want
