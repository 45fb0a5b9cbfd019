import random
import re

import pyarrow as pa
import pytest

from gritstone.llm import text as X
from gritstone.llm.shared import shared_folder

T = ["Hello wörld\nfoo", "", "x", "\n\n", "a b\n", None, "ÉÀ b\nÉÀ b", "foo\nbar\n\nhello WÖRLD", "İstanbul İ", "a\x00b"]


@pytest.mark.parametrize("segment", [4, 1 << 16])
def test_words_and_lines_are_those_of_python(monkeypatch, segment):
    monkeypatch.setattr(X, "_SEGMENT", segment)
    low = X.lowered(pa.array(T))
    buf, off = X.text_buffer(low)
    w, got = X.words(buf, off), {}
    plain = low.to_pylist()
    for r in range(len(T)):
        mine = [bytes(buf[s:e]).decode() for s, e in zip(w.start[w.first[r] : w.first[r + 1]], w.end[w.first[r] : w.first[r + 1]], strict=True)]
        assert mine == re.findall(r"[0-9a-z\x80-\U0010ffff]+", plain[r])
        for m, h in zip(mine, w.hash[w.first[r] : w.first[r + 1]], strict=True):
            assert got.setdefault(m, h) == h
    assert len(set(got.values())) == len(got)
    rows = {}
    found = X.lines(buf, off)
    for s, e, r in zip(found.start, found.end, found.row, strict=True):
        rows.setdefault(int(r), []).append(bytes(buf[s:e]).decode())
    assert [rows.get(i, []) for i in range(len(T))] == [t.split("\n") if t else [] for t in plain]


def test_lower_case_keeps_lengths():
    low = X.lowered(pa.array(T)).to_pylist()
    assert [len(t.encode()) for t in low] == [len((t or "").encode()) for t in T]


def test_character_offsets():
    text = ["aé😀b", "é"]
    buf, off = X.text_buffer(pa.array(text))
    import numpy as np

    assert X.char_offsets(buf, off, np.array([0, 0, 1]), np.array([3, 7, 10])).tolist() == [2, 3, 1]


def test_slices_hold_every_row_once():
    rng = random.Random(0)
    rows = ["x" * rng.randrange(30) if rng.random() < 0.9 else None for _ in range(200)]
    batches = [pa.record_batch({"text": rows[i : i + 33]}) for i in range(0, 200, 33)]
    for limit in (1, 40, 10_000):
        parts = list(X.slices(iter(batches), "text", limit))
        assert [t for p in parts for t in p.column("text").to_pylist()] == rows


def test_shared_folder_is_the_clusters(spark):
    class Context:
        master, applicationId = "yarn", "app"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        shared_folder(Session)
    Session.conf.get = staticmethod(lambda *_: "hdfs://x/y/")
    assert shared_folder(Session) == "hdfs://x/y/gritstone-app"
