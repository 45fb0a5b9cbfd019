"""Toxicity: a linear support vector machine on a subsequence string kernel with Nystroem landmarks.

A sentence is a bag of *units*: stretches between blanks and separators, lower-cased, without the
characters people put inside words (so "i.d*iot" is "idiot"), and with a mark at its beginning; three or more
single characters in a row make one more unit ("i d i o t"). Units over 23 bytes are cut into overlapping windows. A sentence is as toxic as
its worst unit.

Training needs no word list. From a bounded sample of labelled documents come the units that tell toxic
documents from clean ones; of these, frequent ones that are unlike each other, and frequent clean units, are
the landmarks. The squared kernel values with the landmarks, whitened, are the features; sentences with a telling
unit are positive, also with characters inserted at random, sentences of clean documents negative. Units
that several clean documents have are known to be harmless, whatever they resemble.

Some units tell more than others: a slur is proof, a word that resembles one may be chance in a long text.
So on labelled documents that took no part in the fit, scores are cut into bands by how rarely
clean text reaches them, and a document's evidence is the Poisson deviance of its own counts of different units from those rates. The
threshold on the evidence is such that nearly all of those clean documents stay below. Little abuse in a long document
is told by its window of units with the most evidence, where repeats count; that has its own threshold, found alike. Either is enough.

Scoring: units are made distinct in each slice and evaluated once a task, as far as its table reaches. The
kernel with all landmarks is one sparse-to-dense product over the subsequences they share. Every document is scored, on its whole text, in one pass.

Defined results for odd input: null and empty texts have no unit and are not toxic. Labels that are null
don't count; of several labels of a document the highest does. Without labels of both kinds nothing is
toxic. Units of fewer than three bytes are like nothing. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_map, stored
from .string_kernel import ORDER, WIDTH, Landmarks, matrix, self_kernel
from .text import lowered, runs, slices, text_buffer

MAX_LABELLED = 20_000
LANDMARKS = 150
CLEAN_LANDMARKS = 30
UNLIKE = 0.85
POWER = 2
CLEAN_RATES = (5e-3, 5e-4, 1e-4, 1e-5)
TELLING = 5_000
NEGATIVES = 15_000
TELLING_EVIDENCE, TELLING_RATE = 8.0, 10.0
LEAST_EVIDENCE = 4.0
COST = 4.0
WINDOW = 50
CLEAN_SHARE = 0.9995
_TABLE = 300_000
_MARK = ord("^")
_KEPT = np.zeros(256, bool)
_KEPT[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_PARTS = np.zeros(256, bool)
_PARTS[list(b" \t\r\n,;:!?/|()\"<>[]{}=")] = True


def kernel(u: np.ndarray, landmarks: list[bytes], own: np.ndarray | None = None) -> np.ndarray:
    """The normalised kernel to the power of ``POWER``, which is a kernel too and tells near from similar."""
    return Landmarks(landmarks).values(u, own) ** POWER


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes kept, unit starts and ends in them, the row of each unit, and the unit's byte position in the slice."""
    buf, off = text_buffer(lowered(column))
    keep = _KEPT[buf]
    before = np.concatenate([[0], np.cumsum(keep)])
    is_cut = np.zeros(len(buf) + 1, bool)
    is_cut[:-1] = _PARTS[buf]
    is_cut[off] = True
    cuts = np.flatnonzero(is_cut)
    edge = before[cuts]
    start, end, place = edge[:-1], edge[1:], cuts[:-1]
    some = end > start
    start, end, place = start[some], end[some], place[some]
    row = np.searchsorted(off, place, "right") - 1
    body = buf[keep]
    single = end - start == 1
    same = np.zeros(len(start), bool)
    same[1:] = single[1:] & single[:-1] & (row[1:] == row[:-1])
    head = single & ~same
    run = np.cumsum(head) - 1
    heads = np.flatnonzero(head)
    if len(heads):
        size = np.bincount(run[single], minlength=len(heads))
        spelt = heads[size >= 3]
        last = spelt + size[size >= 3] - 1
        start, end = np.concatenate([start, start[spelt]]), np.concatenate([end, end[last]])
        row, place = np.concatenate([row, row[spelt]]), np.concatenate([place, place[spelt]])
    width = WIDTH - 1
    long = np.flatnonzero(end - start > width)
    if len(long):
        step = width // 2
        n = -(-(end[long] - start[long] - width) // step) + 1
        begin = np.repeat(start[long], n) + runs(n, np.zeros(len(n), np.int64)) * step
        close = np.minimum(begin + width, np.repeat(end[long], n))
        rest = np.ones(len(start), bool)
        rest[long] = False
        start, end = np.concatenate([start[rest], begin]), np.concatenate([end[rest], close])
        row, place = np.concatenate([row[rest], np.repeat(row[long], n)]), np.concatenate([place[rest], np.repeat(place[long], n)])
    use = end - start >= ORDER
    return body, start[use], end[use], row[use], place[use]


def distinct_units(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct units as rows of bytes behind the mark, and each unit's number among them."""
    size = end - start
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(body[runs(size, start)])]).dictionary_encode()
    flat, at = text_buffer(coded.dictionary)
    size = np.diff(at)
    rows = np.zeros((len(size), WIDTH), np.uint8)
    rows[:, 0] = _MARK
    rows[np.repeat(np.arange(len(size)), size), runs(size, np.ones(len(size), np.int64))] = flat
    return rows, coded.indices.to_numpy()


class Model(NamedTuple):
    """Landmarks with their weights: a unit's score is the bias plus the weighted kernel values.

    ``bands`` are lower ends of scores; ``rates`` has how often a unit of clean text falls into each band;
    ``threshold`` is for the evidence of a document, ``local`` for that of its worst window.
    """

    landmarks: tuple[bytes, ...]
    index: Landmarks
    weights: np.ndarray
    bias: float
    benign: frozenset[bytes]
    bands: np.ndarray
    rates: np.ndarray
    threshold: float
    local: float = 0.0

    def by_band(self, row: np.ndarray, score: np.ndarray, rows: int) -> np.ndarray:
        """Counts of scores by row and band."""
        band = np.searchsorted(self.bands, score, "left") - 1
        out = np.zeros((rows, len(self.bands)))
        np.add.at(out, (row[band >= 0], band[band >= 0]), 1)
        return out

    def control(self, hits: np.ndarray, n_units: np.ndarray) -> np.ndarray:
        """How much more is expected of a row that has more in the lowest band than usual.

        That band is a control: such a row is written in words that resemble telling ones (another language, say).
        """
        return np.maximum(1, (hits[:, 0] + 2) / (self.rates[0] * n_units + 2))

    def evidence(self, hits: np.ndarray, n_units: np.ndarray, control: np.ndarray | None = None) -> np.ndarray:
        """Poisson deviance of each row's counts by band, where they are above what clean text has."""
        own = self.control(hits, n_units)
        expected = self.rates * n_units[:, None] * (own if control is None else np.maximum(own, control))[:, None]
        more = hits > expected
        more[:, 0] = False
        out = np.zeros(hits.shape)
        out[more] = hits[more] * np.log(hits[more] / expected[more]) - hits[more] + expected[more]
        return out.sum(axis=1)

    def worst_window(self, row: np.ndarray, score: np.ndarray, order: np.ndarray, hits: np.ndarray, n_units: np.ndarray) -> np.ndarray:
        """The most evidence in any window of each row, from all scores in bands and the number of the unit in its row.

        Windows begin every half window. The control is that of the row, or of the window if it is stronger.
        """
        out = np.zeros(len(n_units))
        at = row.astype(np.int64) << 32 | (order // (WINDOW // 2)).astype(np.int64)
        before = (at & 0xFFFFFFFF) > 0
        window, code = np.unique(np.concatenate([at, at[before] - 1]), return_inverse=True)
        own = window >> 32
        counts = self.by_band(code, np.concatenate([score, score[before]]), len(window))
        np.maximum.at(out, own, self.evidence(counts, np.minimum(n_units, WINDOW)[own], self.control(hits, n_units)[own]))
        return out

    def scores(self, u: np.ndarray) -> np.ndarray:
        """Scores of units given as rows of bytes."""
        return self.index.values(u) ** POWER @ self.weights + self.bias


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss; labels are -1 and 1. Newton steps on the active rows until they stay the same."""
    x1 = np.column_stack([x, np.ones(len(x))]).astype(float)
    w, active = np.zeros(x1.shape[1]), np.ones(len(x1), bool)
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(50):
        c = 2 * cost * weight[active]
        w = np.linalg.solve(ridge + x1[active].T @ (x1[active] * c[:, None]), x1[active].T @ (c * y[active]))
        now = y * (x1 @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def _insertions(unit: bytes, rng: np.random.Generator) -> list[bytes]:
    """The unit with characters put in: one anywhere, two, and one in every gap."""
    filler = b"abcdefghijklmnopqrstuvwxyz0123456789"
    out = []
    for n in (1, 1, 1, 2, 2):
        s = bytearray(unit)
        for _ in range(n):
            s.insert(int(rng.integers(2, len(s))), filler[int(rng.integers(len(filler)))])
        out.append(bytes(s))
    for c in (b"x", b"0", filler[int(rng.integers(36)) : 36][:1]):
        out.append(unit[:1] + c.join(unit[i : i + 1] for i in range(1, len(unit))))
    return [s for s in out if len(s) <= WIDTH]


def unlike(units_: list[tuple[bytes, int]], most: int = LANDMARKS, limit: float = UNLIKE) -> list[bytes]:
    """Of units in order of weight, those that are not like one taken before."""
    names = [u for u, _ in units_]
    rows = matrix(names)
    own, open_, out = self_kernel(rows), np.ones(len(names), bool), []
    while open_.any() and len(out) < most:
        k = int(open_.argmax())
        out.append(names[k])
        open_ &= kernel(rows, [names[k]], own)[:, 0] < limit
        open_[k] = False
    return out


def fit(telling: list[tuple[bytes, int]], clean: list[tuple[bytes, int]], benign: frozenset[bytes] = frozenset()) -> Model | None:
    """A model from units that tell toxic documents and units of clean ones, each with a count of documents."""
    if not telling or not clean:
        return None
    rng = np.random.default_rng(611_953)
    marks = unlike(telling)
    landmarks = marks + unlike(clean, CLEAN_LANDMARKS)
    often = dict(telling)
    positive = [(v, often[u] / 8) for u in marks for v in _insertions(u, rng)] + [(u, float(n)) for u, n in telling]
    u = matrix([p for p, _ in positive] + [c for c, _ in clean])
    y = np.repeat([1.0, -1.0], [len(positive), len(clean)])
    weight = np.concatenate([[w for _, w in positive], np.minimum([n for _, n in clean], 50.0)])
    for side in (y > 0, y < 0):
        weight[side] *= len(clean) / weight[side].sum()
    k = kernel(u, landmarks)
    values, vectors = np.linalg.eigh(kernel(matrix(landmarks), landmarks).astype(float))
    good = values > 1e-6
    whiten = vectors[:, good] / np.sqrt(values[good])
    w, bias = fit_svm(k @ whiten, y, weight)
    alpha = (whiten @ w).astype(np.float32)
    return Model(tuple(landmarks), Landmarks(landmarks), alpha, bias, benign, np.zeros(2), np.full(2, 1e-6), 0.0)


def _unit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        body, start, end, row, _ = units(batch.column("text"))
        rows, code = distinct_units(body, start, end)
        pairs = np.unique(row * np.int64(len(rows) + 1) + code)
        row, code = pairs // (len(rows) + 1), pairs % (len(rows) + 1)
        names = pa.array(np.ascontiguousarray(rows).view(f"S{WIDTH}").ravel().tolist(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), batch.column("label").take(pa.array(row)), names.take(pa.array(code))], ["doc_id", "label", "unit"])


def _sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    share = max_labelled / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # The sample's size is bounded by the parameter, whatever the size of the tables.
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, most_telling: int = TELLING, negatives: int = NEGATIVES) -> Model | None:
    """Fit to ``labels(doc_id, toxic)``; at most about ``max_labelled`` of them, and all if there are no more.

    The machine learns from the ``most_telling`` most frequent telling units and the ``negatives`` most frequent others; these
    bound the fit only. All units that several clean documents of the sample have are known to be harmless.
    """
    sample = stored(_sample(docs, labels, max_labelled), "labelled")
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("unit", T.BinaryType())])
    sets = stored(arrow_map(sample.where(part > 0), _unit_sets, schema), "unit-sets")
    n = {r["label"]: r["n"] for r in sets.groupBy("label").agg(F.countDistinct("doc_id").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return None
    counts = sets.groupBy("unit").agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("c"))
    chance = (F.col("c") + 0.5) / n[0] * n[1]
    tells = (F.col("t") >= 3) & (F.col("t") > TELLING_RATE * chance) & (F.col("t") * F.log(F.col("t") / chance) - F.col("t") + chance > TELLING_EVIDENCE)
    telling = [(bytes(r["unit"]), r["t"]) for r in counts.where(tells).orderBy(F.desc("t"), "unit").limit(most_telling).collect()]
    rest = stored(counts.where("c > 0").where(~tells).select("unit", "c"), "clean-units")
    clean = [(bytes(r["unit"]), r["c"]) for r in rest.orderBy(F.desc("c"), F.xxhash64("unit"), "unit").limit(negatives).collect()]
    model = fit(telling, clean, frozenset(map(bytes, rest.where("c > 1").select("unit").toArrow().column(0).to_pylist())))
    if model is None:
        return None
    held = _tally(sample.where((part == 0) & (F.col("label") == 0)), model).toPandas()
    n_units = held["n"].to_numpy(float)
    if not n_units.sum():
        return model
    every, order, number = (np.concatenate([np.asarray(x, kind) for x in held[c]]) for c, kind in (("scores", float), ("orders", np.int64), ("numbers", np.int64)))
    rows = np.repeat(np.arange(len(held)), [len(x) for x in held["scores"]])
    once = different(rows, number)
    scores, row = every[once], rows[once]
    top = np.concatenate([np.sort(scores)[::-1], [0.0]])
    model = model._replace(bands=bands_of(top, int(n_units.sum())))
    hits = model.by_band(row, scores, len(held))
    model = model._replace(rates=(hits.sum(axis=0) + 0.5) / (n_units.sum() + 1))
    rank = int((1 - CLEAN_SHARE) * len(held))
    # The bands have risen: what was tallied above 0 may lie below them now.
    inside = every > model.bands[0]
    found = model.evidence(hits, n_units), model.worst_window(rows[inside], every[inside], order[inside], hits, n_units)
    threshold, local = (max(LEAST_EVIDENCE, float(np.sort(x)[::-1][rank]) + 1e-3) for x in found)
    return model._replace(threshold=threshold, local=local)


def different(row: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Places of the first of each different unit in each row."""
    return np.unique(row.astype(np.int64) << 32 | number, return_index=True)[1]


class Judge:
    """A worker's copy of the model with the scores it has computed."""

    def __init__(self, model: Model):
        self.model, self.known = model, dict.fromkeys(model.benign, -np.inf)
        self.room = len(self.known) + _TABLE

    def hits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Row and score of each unit in a band, all units' bytes, the unit's number among them and in its row, and the number of units of each row."""
        body, start, end, row, place = units(column)
        rows, code = distinct_units(body, start, end)
        names = np.ascontiguousarray(rows).view(f"S{WIDTH}").ravel().tolist()
        known = self.known
        score = np.array([known.get(u, np.nan) for u in names])
        new = np.flatnonzero(np.isnan(score))
        if len(new):
            score[new] = self.model.scores(rows[new])
            known.update((names[i], float(score[i])) for i in new[: max(0, self.room - len(known))].tolist())
        at = np.flatnonzero(score[code] > self.model.bands[0])
        total = np.bincount(row, minlength=len(column))
        order = np.searchsorted(np.sort(place), place[at]) - (np.cumsum(total) - total)[row[at]]
        return row[at], score[code[at]], names, code[at], order, total.astype(float)


def bands_of(top: np.ndarray, n_units: int) -> np.ndarray:
    """Lower ends of the bands, from the scores above 0 of clean units in falling order, and 0 behind them.

    The lowest band is the control, so there is one more at least: above all of ``top``, even where that has no score.
    """
    bands = np.unique([top[0], *(top[min(int(r * n_units), len(top) - 1)] for r in CLEAN_RATES)])
    return bands if len(bands) > 1 else np.array([0.0, max(float(top[0]), 1e-9)])


def _tally(docs: DataFrame, model: Model) -> DataFrame:
    """Scores in the bands and number of units of each document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(held.value)
        for batch in slices(batches, "text"):
            row, value, _, number, place, n = judge.hits(batch.column("text"))
            order = np.argsort(row, kind="stable")
            off = pa.array(np.searchsorted(row[order], np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(off, pa.array(x[order])) for x in (value, place.astype(np.int64), number.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*lists, pa.array(n)], ["scores", "orders", "numbers", "n"])

    return arrow_map(docs.select("text"), run, "scores array<double>, orders array<bigint>, numbers array<bigint>, n double")


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row for each toxic document: ``doc_id``, ``score`` (the evidence), ``n_units`` that count, and the worst ``unit``."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("n_units", T.IntegerType()), T.StructField("unit", T.StringType())])
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(held.value)
        for batch in slices(batches, "text"):
            row, value, names, number, place, total = judge.hits(batch.column("text"))
            once = different(row, number)
            hits = judge.model.by_band(row[once], value[once], batch.num_rows)
            evidence = judge.model.evidence(hits, total)
            local = judge.model.worst_window(row, value, place, hits, total)
            toxic = (evidence > judge.model.threshold) | (local > judge.model.local)
            evidence = np.maximum(evidence, local)
            worst = np.lexsort((number, -value, row))
            first = worst[np.concatenate([[True], row[worst][1:] != row[worst][:-1]])] if len(worst) else worst
            first = first[toxic[row[first]]]
            n = hits.sum(axis=1)[row[first]].astype(np.int32)
            terms = [names[i][1:].decode(errors="replace") for i in number[first]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[first])), pa.array(evidence[row[first]]), pa.array(n), pa.array(terms, pa.string())], ["doc_id", "score", "n_units", "unit"])

    return arrow_map(docs.select("doc_id", "text"), run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every toxic document with its score, the number of toxic units and the worst one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
