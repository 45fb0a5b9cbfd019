"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of whitespace markers and what follows up to the next marker. Where no piece of the
vocabulary holds a marker behind another character, merges never reach over a chunk's end, so a text's
ids are its chunks' ids in order. Each task keeps a table from chunk to ids: a chunk goes to the
library once, every later occurrence is a gather by position. Chunks are found, hashed and looked up for a whole slice
at a time; no row of text, and no chunk but a new one, is touched by Python alone. Nothing is shuffled.
A chunk is known by a 64-bit hash, its length and its first seven bytes.

The condition is checked on the model when it is loaded (pieces across markers, a normaliser that changes
text, no leading marker); a model that fails it is run on whole texts instead, with the same results.

The table's memory is bounded: once it has ``table_chunks`` entries (the frequent ones come early; a million take about
100 MB), a further chunk is segmented once in each slice of documents instead. That only costs time.

Defined results for odd input: a null text has null ids, an empty one no ids. A text that holds the
marker character itself decodes to a space there, as the library's own decoding has it. Decoding takes
any ids: null stays null, ids outside the vocabulary decode to nothing, broken byte sequences to U+FFFD.
Repeated rows are encoded alike; other columns pass through, but for those named like the new ones.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_map
from .text import runs, slices, span_hashes, text_buffer

TOKENIZERS = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
TABLE_CHUNKS = 1_000_000
_ENCODED_AT_ONCE = 16_384
MARKER = "▁"


def _marks(wide: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Length (255 at most) and first seven bytes behind the marker of each chunk, as one number: all of a chunk of up to eight bytes."""
    size = end - start
    out = np.minimum(size, 255).astype(np.uint64)
    for k in range(1, 8):
        out = (out << np.uint64(8)) | np.where(size > k, wide[np.minimum(start + k, len(wide) - 1)], 0).astype(np.uint64)
    return out


class ChunkTable:
    """A hash table of chunks known by a 64-bit hash and a 64-bit mark, in flat arrays; entries are numbered as they are added."""

    def __init__(self):
        self.n = 0
        self._resize(1 << 16)

    def __len__(self) -> int:
        return self.n

    def _resize(self, slots: int) -> None:
        self.mask = np.uint64(slots - 1)
        self.hash, self.mark, self.number = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)

    def find(self, hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The number of each chunk, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        slot = (hashes & self.mask).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            number = self.number[slot]
            hit = (self.hash[slot] == hashes[open_]) & (self.mark[slot] == marks[open_]) & (number >= 0)
            out[open_[hit]] = number[hit]
            more = (number >= 0) & ~hit
            open_, slot = open_[more], (slot[more] + 1) & int(self.mask)
        return out

    def add(self, hashes: np.ndarray, marks: np.ndarray) -> None:
        """New chunks, each once."""
        if 2 * (self.n + len(hashes)) > len(self.hash):
            used = np.flatnonzero(self.number >= 0)
            order = used[np.argsort(self.number[used])]
            old = self.hash[order], self.mark[order]
            slots = len(self.hash)
            while 2 * (self.n + len(hashes)) > slots:
                slots *= 2
            self._resize(slots)
            self._place(*old, 0)
        self._place(hashes, marks, self.n)
        self.n += len(hashes)

    def _place(self, hashes: np.ndarray, marks: np.ndarray, number: int) -> None:
        slot = (hashes & self.mask).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            free = np.flatnonzero(self.number[slot] < 0)
            # Of several that want one slot, the last written has it.
            self.number[slot[free]] = (number + open_[free]).astype(np.int32)
            won = np.zeros(len(open_), bool)
            won[free] = self.number[slot[free]] == number + open_[free]
            self.hash[slot[won]], self.mark[slot[won]] = hashes[open_[won]], marks[open_[won]]
            open_, slot = open_[~won], (slot[~won] + 1) & int(self.mask)


class Codec:
    """A model with its chunk table."""

    def __init__(self, path: str, table_chunks: int = TABLE_CHUNKS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.table_chunks = table_chunks
        self.by_chunk = self.model.encode("a b") == self.model.encode("a") + self.model.encode("b") and self._chunks_hold(pieces)
        self.forget()
        body = []
        for i, p in enumerate(pieces):
            if self.model.is_byte(i):
                body.append(bytes([int(p[1:-1], 16)]))
            elif self.model.is_control(i):
                body.append(b"")
            elif self.model.is_unknown(i):
                body.append(" ⁇ ".encode())
            else:
                body.append(p.replace(MARKER, " ").encode())
        self.piece_size = np.array([len(b) for b in body] + [0], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(body), np.uint8)
        self.lone = self.model.piece_to_id(MARKER)

    def _chunks_hold(self, pieces: list[str]) -> bool:
        across = any(MARKER in p.lstrip(MARKER) for p in pieces)
        kept = all(self.model.decode(self.model.encode(t)) == t for t in ("  a  b ", "\ta\n\nb", "Ａ é ½"))
        return not across and kept and MARKER in pieces

    def forget(self) -> None:
        """Start with an empty table."""
        self.table = ChunkTable()
        self.ids, self.filled = np.empty(1 << 16, np.int32), 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _segment(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, one after another, and how many each has."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i in range(0, len(chunks), _ENCODED_AT_ONCE):
            part = chunks[i : i + _ENCODED_AT_ONCE]
            found = self.model.encode([c[1:].decode() for c in part], num_threads=1)
            found = [(self.lone,) if c == b" " else f for f, c in zip(found, part, strict=True)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.int32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def _places(self, wide: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each chunk's number in ``at`` and ``size``; new chunks are segmented, once each.

        They stay in the table while it has room; the others are there until the next call.
        """
        hashes, marks = span_hashes(wide, start, end), _marks(wide, start, end)
        place = self.table.find(hashes, marks)
        new = np.flatnonzero(place < 0)
        if not len(new):
            return place
        # A hash and a mark are one chunk; the mark tells those apart that share a hash.
        order = new[np.lexsort((marks[new], hashes[new]))]
        first = np.ones(len(order), bool)
        first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (marks[order][1:] != marks[order][:-1])
        head = order[first]
        data, n, known = wide.tobytes(), len(head), len(self.table)
        ids, sizes = self._segment([data[a:z] for a, z in zip(start[head].tolist(), end[head].tolist(), strict=True)])
        while known + n > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.at[known : known + n] = self.filled + np.cumsum(sizes) - sizes
        self.size[known : known + n] = sizes
        place[order] = known + np.cumsum(first) - 1
        room = max(0, min(n, self.table_chunks - known))
        self.table.add(hashes[head[:room]], marks[head[:room]])
        self.filled += int(sizes[:room].sum())
        return place

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and each row's offsets in them; nulls have none."""
        if column.null_count:
            column = pc.fill_null(column, "")
        if not self.by_chunk:
            found = self.model.encode(column.to_pylist(), num_threads=1) if len(column) else []
            sizes = np.array([len(f) for f in found], np.int64)
            return np.array([i for f in found for i in f], np.int32), np.concatenate([[0], np.cumsum(sizes)])
        buf, off = text_buffer(column)
        if bool((buf == 0xE2).any()) and pc.any(pc.match_substring(column, MARKER)).as_py():
            buf, off = text_buffer(pc.replace_substring(column, MARKER, " "))
        # A space before each row that isn't empty, as the model's leading marker.
        held = np.flatnonzero(np.diff(off))
        wide = np.empty(len(buf) + len(held), np.uint8)
        lead = off[held] + np.arange(len(held))
        inner = np.ones(len(wide), bool)
        inner[lead] = False
        wide[lead], wide[inner] = 32, buf
        space = wide == 32
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[lead] = True
        at = np.flatnonzero(opens)
        place = self._places(wide, at, np.append(at[1:], len(wide))) if len(at) else np.zeros(0, np.int64)
        sizes = self.size[place]
        ids = self.ids[runs(sizes, self.at[place])]
        total = np.concatenate([[0], np.cumsum(sizes)])
        row_chunks = np.searchsorted(at, np.concatenate([lead, [len(wide)]]))
        offsets = np.zeros(len(off), np.int64)
        offsets[held + 1] = np.diff(total[row_chunks])
        return ids, np.cumsum(offsets)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of rows of ids."""
        n = len(self.piece_size) - 1
        ids = np.where((ids < 0) | (ids >= n), n, ids)
        sizes = self.piece_size[ids]
        body = self.piece_bytes[runs(sizes, self.piece_at[ids])]
        total = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        # The leading marker is no part of the text.
        held = np.flatnonzero(np.diff(total))
        lead = total[held][body[total[held]] == 32] if len(held) else np.zeros(0, np.int64)
        keep = np.ones(len(body), bool)
        keep[lead] = False
        gone = np.searchsorted(lead, total)
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((total - gone).astype(np.int64)), pa.py_buffer(body[keep])])
        try:
            return texts.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([t.decode(errors="replace") for t in texts.to_pylist()], pa.large_string())


@lru_cache(maxsize=2)
def codec(path: str, table_chunks: int = TABLE_CHUNKS) -> Codec:
    """This worker's codec of a model file."""
    return Codec(path, table_chunks)


def model_path(tokenizers: str = TOKENIZERS, model: str = MODEL) -> str:
    """Path of the model file, the same on every machine."""
    return os.path.join(tokenizers, model)


def _with(batch: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *new.values()], [*batch.schema.names, *new])


def encode(docs: DataFrame, path: str | None = None, round_trip: bool = True, table_chunks: int = TABLE_CHUNKS) -> DataFrame:
    """``docs`` with ``ids`` and ``n_ids`` of the column ``text``.

    With ``round_trip`` the ids are decoded again: ``decodes`` says whether that gives the text. A column
    of ``docs`` with one of these names is replaced.
    """
    path = path or model_path()
    docs = docs.drop("ids", "n_ids", "decodes")
    new = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.IntegerType())]
    new += [T.StructField("decodes", T.BooleanType())] if round_trip else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, table_chunks)
        own.forget()
        for batch in slices(batches, "text", 4 << 20):
            text = batch.column("text")
            ids, off = own.encode(text)
            valid = text.is_valid()
            null = None if not text.null_count else pc.invert(valid)
            more = {"ids": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids), mask=null), "n_ids": pa.array(np.diff(off), pa.int32(), mask=None if null is None else null.to_numpy(zero_copy_only=False))}
            if round_trip:
                more["decodes"] = pc.equal(own.decode(ids, off), text.cast(pa.large_string()))
            yield _with(batch, **more)
        own.forget()

    return arrow_map(docs, run, T.StructType([*docs.schema.fields, *new]))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with the column ``text`` made from the column ``ids``; a column of that name is replaced."""
    path = path or model_path()
    encoded = encoded.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            lists = batch.column("ids")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            text = own.decode(ids, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])).cast(pa.string())
            yield _with(batch, text=pc.if_else(lists.is_valid(), text, pa.scalar(None, pa.string())))

    return arrow_map(encoded, run, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether they decode to its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), F.col("text"))
    return encode(docs).drop("text")
