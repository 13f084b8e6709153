from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shelfwork.llm import buffers, decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows: dict = {}
    for item, text in items:
        w = words(text)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, known = words(text), set(), set()
        for m in range(1, 11):
            for k in range(len(w) - m + 1):
                if (own := windows.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    known |= own
        known = sorted(str(x) for x in known if x is not None)
        out.append((doc, len(w), len(hit), len(known), hashlib.sha256(",".join(known).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, hits string, n_words int")
    i = spark.createDataFrame([(a, b, "x", 1) for a, b in items], "item_id long, text string, span string, fp int")
    got = decontamination.decontaminate(d, i, **more)
    return sorted(map(tuple, got.collect()), key=str)


def prose(rng, n, vocabulary=300):
    return " ".join(rng.choice(["w", "É", "ß"]) + str(rng.randrange(vocabulary)) for _ in range(n))


def test_equal_to_all_windows(spark):
    """Spans of every length around the window, short items of every length, repeated spans, overlaps, ties."""
    rng = random.Random(3)
    items = [(k, prose(rng, 14 + k)) for k in range(12)] + [(20 + n, " ".join(f"s{n}x{j}" for j in range(n))) for n in range(1, 10)]
    items += [(5, prose(rng, 30)), (None, prose(rng, 12)), (40, None), (41, " ., "), (42, items[3][1]), (43, "the the the the the the the the the the the the")]
    docs = []
    for k in range(120):
        parts = [prose(rng, rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 4)):
            w = words(rng.choice(items)[1])
            a = rng.randrange(0, max(1, len(w)))
            parts += [rng.choice([" ", "-", ". ", "\x7f"]).join(x.upper() if rng.random() < 0.3 and x.isascii() else x for x in w[a : a + rng.randrange(1, 16)]), prose(rng, rng.randrange(0, 5))]
        docs.append((k % 100, " ".join(parts)))
    docs += [(7, None), (8, ""), (9, "!?"), (None, items[0][1]), (None, items[0][1]), (200, "the " * 40), (201, "S1X0"), (202, "x S3X0 s3x1, s3x2! S3x0 s3x1"), (203, " ".join(i[1] or "" for i in items))]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs[:40], items, most_broadcast=0) == brute(docs[:40], items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    assert run(spark, [(1, "a b c"), (2, None)], []) == brute([(1, "a b c"), (2, None)], [])


@pytest.mark.parametrize("width", range(1, 11))
def test_every_shared_span_has_a_shared_fingerprint(width):
    """A span of the window's length gives one of its own runs' hashes as the fingerprint, on both sides."""
    rng = np.random.default_rng(width)
    for _ in range(50):
        span = rng.integers(0, 1 << 63, width, dtype=np.uint64)
        a, b = (np.concatenate([rng.integers(0, 1 << 63, 9, dtype=np.uint64), span, rng.integers(0, 1 << 63, 9, dtype=np.uint64)]) for _ in range(2))
        assert set(decontamination.selected(a, width).tolist()) & set(decontamination.selected(b, width).tolist())
    h = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    gram, window = decontamination.scheme(width)
    assert len(decontamination.selected(h, width)) <= 4000 * 2 / (window + 1) * 1.15  # thinned to the known density


def test_pieces_of_a_long_text_give_the_same():
    rng = random.Random(9)
    text = prose(rng, 3000) + " " + "longword" * 400 + " " + prose(rng, 2000) + " " + "z" * 5000 + " y " * 30
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, "a b"])], names=["doc_id", "text"])
    item = pa.RecordBatch.from_arrays([pa.array(["i"]), pa.array([" ".join(words(text)[100:4900])])], names=["item", "text"])
    windows = {(x["width"], x["span"]) for b in decontamination._of_items(1 << 20)([item]) for x in b.to_pylist()}
    assert windows == {(x["width"], x["span"]) for b in decontamination._of_items(700)([item]) for x in b.to_pylist()} and len(windows) >= 4700
    ones = np.full(1 << 18, np.iinfo(np.uint64).max, np.uint64)  # all may be there
    whole, cut = (next(iter(decontamination._of_documents([2, 10], ones, ones, size)([batch]))).to_pylist() for size in (1 << 22, 900))
    assert len(buffers.raw(batch.column(1))[0]) > 20000
    for a, b in zip(whole, cut, strict=True):
        assert a["n_words"] == b["n_words"] == len(words(text if a["doc_id"] == 1 else "a b"))
        key = lambda h: (h["width"], h["start"])
        assert sorted(a["hits"], key=key) == sorted(b["hits"], key=key)
