"""Substring dedup by hashing passages of lines: a repeated passage stays where it ranks first and goes elsewhere.

Whole lines are too coarse as units: passages lie inside longer lines, or run over many short ones. So text
is broken where its own words say so, whatever its lines: at each word that is the greatest of some
``near`` words running (the longest, then the last by its first bytes, then the earlier one), and at both ends. A unit goes from
a break to the first one ``least`` words on, and the last unit that begins also reaches the text's end. Any passage of
``2 * near + least - 1`` words (51) that another place has word for word holds a whole unit in both.

Units are normalised to lower-cased words and hashed to 96 bits. Digests are counted with their lowest ``doc_id`` in one
shuffle with partial sums; occurrences of repeated digests are then joined with that, in a sort-merge join that Spark
splits where it is skewed. Of one document's occurrences of a unit only the first is told apart, overlapping later ones
are one row, so that a text of one word repeated is a few rows. Texts themselves are shuffled only to apply the removals.

A word under a unit that ranks first here (lowest ``doc_id``, then lowest offset) stays; other words under a
unit that has an earlier place go, with the separators behind them. Up to ``near`` words at a passage's
beginning and ``near + least`` at its end may stay where other words follow. Offsets are those of characters in the
original text, ends exclusive, and stay so however many spans go.

Defined results for odd input: case, punctuation and line breaks don't matter. Texts of fewer than ``least`` words, null and
empty ones lose nothing. Rows with the same ``doc_id`` are the same document: each row keeps the unit or
loses it like the other, by offsets of its own text. Rows without a ``doc_id`` rank last; those with the same text are one document, and ``kept_in`` of a
unit that one of these keeps is null. An empty table gives an empty one. A ``doc_id`` that is no integer is refused.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_map, integer_ids, stored
from .text import char_offsets, lowered, mix, sequence_hash, slices, text_buffer, words

LEAST = 20
NEAR = 16
_NAMELESS = 1 << 62
_UNITS = "lane0 bigint, lane1 int, doc bigint, body int, begin int, end int"


def _greatness(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words as numbers in the order that breaks go by: bytes (255 at most), then the first seven of them."""
    size = end - start
    out = np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
    last = len(buf) - 1
    for k in range(7):
        byte = np.where(size > k, buf[np.minimum(start + k, last)], 0).astype(np.uint64)
        out |= byte << np.uint64(48 - 8 * k)
    return out


def breaks(greatness: np.ndarray, first: np.ndarray, near: int = NEAR) -> np.ndarray:
    """Words at which a unit may begin or end: the greatest of any ``near`` running within a row, and the rows' borders."""
    n = len(greatness)
    at = np.arange(n)
    value, width = greatness, 1
    # The place of the greatest of 2, 4, 8 .. words from each; two such stretches cover one of any width.
    while width < near and n >= near:
        step = min(width, near - width)
        low, high = at[:-step], at[step:]
        at = np.where(value[low] >= value[high], low, high)
        width += step
    is_break = np.zeros(n + 1, bool)
    if n >= near:
        row = np.searchsorted(first, np.arange(len(at)), "right")
        is_break[at[np.arange(len(at)) + near <= first[row]]] = True
    is_break[first] = True
    return np.flatnonzero(is_break)


def spans_of(cuts: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (exclusive) of the units between ``cuts``."""
    at = cuts[cuts < first[-1]]
    limit = first[np.searchsorted(first, at, "right")]
    at, limit = at[at + least <= limit], limit[at + least <= limit]
    if not len(at):
        return at, at
    to = cuts[np.searchsorted(cuts, at + least)]
    final = np.append(limit[1:] != limit[:-1], True) & (to < limit)
    return np.concatenate([at, at[final]]), np.concatenate([to, limit[final]])


def _merged(row: np.ndarray, lane: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a row's units with one digest, the first, and the others where overlapping ones are one: index and last word."""
    order = np.lexsort((begin, lane, row))
    r, h, b, e = row[order], lane[order], begin[order], end[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    second = np.zeros(len(order), bool)
    second[1:] = fresh[:-1]
    apart = np.ones(len(order), bool)
    apart[1:] = b[1:] > e[:-1]
    head = np.flatnonzero(fresh | second | apart)
    tail = np.append(head[1:], len(order)) - 1
    return order[head], e[tail] if len(head) else head


def _find_units(least: int, near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            buf, off = text_buffer(lowered(batch.column("text")))
            w = words(buf, off)
            begin, end = spans_of(breaks(_greatness(buf, w.start, w.end), w.first, near), w.first, least)
            lane0 = sequence_hash(w.hash, begin, end, "lane0")
            lane1 = sequence_hash(mix(w.hash), begin, end, "lane1")
            use, end = _merged(np.searchsorted(w.first, begin, "right") - 1, lane0, begin, end)
            begin, lane0, lane1 = begin[use], lane0[use], lane1[use]
            row = np.searchsorted(w.first, begin, "right") - 1
            last = end == w.first[row + 1]
            stop = np.where(last, w.end[end - 1], w.start[np.minimum(end, len(w.start) - 1)]) if len(end) else end
            columns = [lane0.view(np.int64), (lane1 >> np.uint64(32)).astype(np.uint32).view(np.int32), *(batch.column(c).to_numpy()[row] for c in ("doc", "body"))]
            columns += [char_offsets(buf, off, row, x).astype(np.int32) for x in (w.start[begin], stop)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["lane0", "lane1", "doc", "body", "begin", "end"])

    return run


def _united(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[list[int]] = []
    for b, e in spans:
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return out


def gone(doc: int, units: list[dict]) -> list[tuple[int, int, int]]:
    """Stretches of ``doc`` under units with an earlier place but under none that ranks first: begin, end, the lowest document that keeps such a unit."""
    seen: set[int] = set()
    kept, later = [], []
    for u in sorted(units, key=lambda u: (u["begin"], u["end"])):
        if u["owner"] == doc and u["lane0"] not in seen:
            seen.add(u["lane0"])
            kept.append((u["begin"], u["end"]))
        else:
            later.append((u["begin"], u["end"], u["owner"]))
    stays, out, k = _united(kept), [], 0
    for b, e in _united([x[:2] for x in later]):
        while b < e:
            while k < len(stays) and stays[k][1] <= b:
                k += 1
            if k < len(stays) and stays[k][0] <= b:
                b = stays[k][1]
            else:
                out.append((b, min(e, stays[k][0]) if k < len(stays) else e))
                b = out[-1][1]
    ends = [e for _, e in out]
    who = [1 << 63] * len(out)
    for b, e, owner in later:
        i = bisect_right(ends, b)
        while i < len(out) and out[i][0] < e:
            who[i] = min(who[i], owner)
            i += 1
    return [(*span, w) for span, w in zip(out, who, strict=True)]


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = zip(batch.column("text").to_pylist(), batch.column("doc").to_pylist(), batch.column("units").to_pylist(), strict=True)
        rows = [(i, t, gone(d, u)) for i, (t, d, u) in enumerate(found)]
        rows = [r for r in rows if r[2]]
        texts = ["".join(t[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(t)], strict=True)) for _, t, spans in rows]
        begins, ends = (pa.array([[s[k] for s in spans] for _, _, spans in rows], pa.list_(pa.int32())) for k in (0, 1))
        who = pa.array([[None if s[2] >= _NAMELESS else s[2] for s in spans] for _, _, spans in rows], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array(texts, pa.string()), begins, ends, who], ["doc_id", "text", "begins", "ends", "kept_in"])


def dedup_passages(docs: DataFrame, least: int = LEAST, near: int = NEAR) -> DataFrame:
    """The documents that lose something: ``doc_id``, ``text`` without it, and ``begins``, ``ends`` and ``kept_in`` of what was removed."""
    integer_ids(docs, "doc_id")
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NAMELESS) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))
    docs = docs.where("text IS NOT NULL").select("doc_id", "text", key.alias("doc"), F.hash("text").alias("body"))
    units = stored(arrow_map(docs.select("doc", "body", "text"), _find_units(least, near), _UNITS), "units")
    first = units.groupBy("lane0", "lane1").agg(F.count("*").alias("n"), F.min("doc").alias("owner")).where("n > 1").drop("n")
    found = units.join(first, ["lane0", "lane1"]).select("doc", "body", F.struct("begin", "end", "owner", "lane0").alias("unit"))
    own = found.groupBy("doc", "body").agg(F.collect_list("unit").alias("units"))
    changed = docs.join(own, ["doc", "body"]).select("doc_id", "text", "doc", "units")
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("text string, begins array<int>, ends array<int>, kept_in array<bigint>").fields])
    return arrow_map(changed, _apply, schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that loses a repeated passage: its new text, and what was removed, by original offsets."""
    return dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP6_SQL = r"""
WITH split AS (
  SELECT doc_id, text, regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10ffff}]+[^0-9A-Za-z\x{80}-\x{10ffff}]*') AS tokens
  FROM documents WHERE text IS NOT NULL
), listed AS (
  SELECT doc_id, text, tokens, len(tokens) AS n, length(text) - length(array_to_string(tokens, '')) AS lead FROM split WHERE len(tokens) > 0
), token AS (
  SELECT doc_id, n, lead, token, lower(regexp_extract(token, '^[0-9A-Za-z\x{80}-\x{10ffff}]+')) AS word, k
  FROM (SELECT doc_id, n, lead, unnest(tokens) AS token, unnest(range(n)) AS k FROM listed)
), sequence AS (
  SELECT doc_id, list(word ORDER BY k) AS words FROM token GROUP BY doc_id
), placed AS (
  SELECT *, CAST(lead + sum(length(token)) OVER (PARTITION BY doc_id ORDER BY k) - length(token) AS INTEGER) AS place,
         lpad(CAST(least(strlen(word), 255) AS VARCHAR), 3, '0') || rpad(left(hex(word), 14), 14, '0') || lpad(CAST(900000000 - k AS VARCHAR), 9, '0') AS greatness
  FROM token
), cut AS (
  SELECT DISTINCT doc_id, n, 900000000 - CAST(right(top, 9) AS BIGINT) AS k
  FROM (SELECT doc_id, n, k, max(greatness) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS top FROM placed)
  WHERE k + 16 <= n
  UNION SELECT doc_id, n, 0 FROM listed UNION SELECT doc_id, n, n FROM listed
), open AS (
  SELECT doc_id, n, k, k + 20 AS reach FROM cut WHERE k + 20 <= n
), stretch AS (
  SELECT o.doc_id, o.n, o.k AS a, c.k AS z FROM open o ASOF JOIN cut c ON o.doc_id = c.doc_id AND o.reach <= c.k
), unit AS (
  SELECT s.doc_id, a, z, array_to_string(words[a + 1 : z], ' ') AS unit
  FROM (SELECT doc_id, a, z FROM stretch UNION
        SELECT doc_id, max(a), n FROM stretch GROUP BY doc_id, n) s JOIN sequence USING (doc_id)
), ranked AS (
  SELECT doc_id, a, z, row_number() OVER w AS rank, first_value(doc_id) OVER w AS kept, count(*) OVER (PARTITION BY unit) AS copies
  FROM unit WINDOW w AS (PARTITION BY unit ORDER BY doc_id, a)
), repeated AS (
  SELECT * FROM ranked WHERE copies > 1
), edge AS (
  SELECT doc_id, k, sum(stays) AS stays, sum(goes) AS goes FROM (
    SELECT doc_id, a AS k, CAST(rank = 1 AS INTEGER) AS stays, CAST(rank > 1 AS INTEGER) AS goes FROM repeated UNION ALL
    SELECT doc_id, z, -CAST(rank = 1 AS INTEGER), -CAST(rank > 1 AS INTEGER) FROM repeated
  ) GROUP BY doc_id, k
), part AS (
  SELECT doc_id, k AS a, lead(k) OVER w AS z, sum(stays) OVER w = 0 AND sum(goes) OVER w > 0 AS gone
  FROM edge WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), grouped AS (
  SELECT *, sum(CAST(gone AND NOT before AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY a) AS number
  FROM (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY a), FALSE) AS before FROM part)
), span AS (
  SELECT doc_id, min(a) AS a, max(z) AS z FROM grouped WHERE gone GROUP BY doc_id, number
), owned AS (
  SELECT s.doc_id, s.a, s.z, min(r.kept) AS kept FROM span s JOIN repeated r ON r.doc_id = s.doc_id AND r.rank > 1 AND r.a < s.z AND s.a < r.z
  GROUP BY s.doc_id, s.a, s.z
), offsets AS (
  SELECT o.*, f.place AS begin, CAST(l.place + CASE WHEN o.z = l.n THEN length(l.word) ELSE length(l.token) END AS INTEGER) AS finish
  FROM owned o JOIN placed f ON f.doc_id = o.doc_id AND f.k = o.a JOIN placed l ON l.doc_id = o.doc_id AND l.k = o.z - 1
), removed AS (
  SELECT doc_id, list(begin ORDER BY begin) AS begins, list(finish ORDER BY begin) AS ends, list(kept ORDER BY begin) AS kept_in
  FROM offsets GROUP BY doc_id
), rest AS (
  SELECT p.doc_id, string_agg(CASE WHEN s.a IS NULL THEN p.token WHEN p.k = p.n - 1 THEN substr(p.token, length(p.word) + 1) ELSE '' END, '' ORDER BY p.k) AS body
  FROM placed p LEFT JOIN span s ON s.doc_id = p.doc_id AND s.a <= p.k AND p.k < s.z
  WHERE p.doc_id IN (SELECT doc_id FROM removed) GROUP BY p.doc_id
)
SELECT r.doc_id, left(l.text, l.lead) || t.body AS text, r.begins, r.ends, r.kept_in
FROM removed r JOIN rest t USING (doc_id) JOIN listed l USING (doc_id)
"""
