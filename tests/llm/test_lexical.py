from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from shelfwork.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in WORD.findall(text or "")]


def brute(docs, items, best=50):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        rows = []
        for doc, tf, length in held:
            m = 50 + 50 * length * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in own if tf[t])
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        rows.sort(key=lambda r: r[:3])
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(rows[:best])]
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, item string, score int").repartition(5)
    i = spark.createDataFrame([(a, b, "x", 1) for a, b in items], "item_id long, text string, term string, rank int")
    return sorted(map(tuple, lexical.search(d, i, **more).collect()), key=str)


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "an", "É", "tree", "x9", "日本"]) + str(int(rng.expovariate(0.1)))
    docs = [(k % 380, rng.choice([" ", "\n", "--", "\x00"]).join(rng.choice([str.upper, str])(word()) for _ in range(rng.randrange(0, 60)))) for k in range(n)]
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 25)))) for k in range(30)]
    return docs + [(900, None), (901, ""), (902, " .,"), (None, "a1 a2"), (None, "a1 a2"), (903, "a1 " * 500)], items + [(3, "a1 a1 tree2"), (None, "a1"), (None, "x91"), (50, None), (51, "?"), (52, "nowhere")]


def test_equal_to_scoring_all_documents(spark):
    docs, items = corpus()
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, best=3) == brute(docs, items, 3)


def test_blocks_of_items_give_the_same(spark):
    docs, items = corpus(120, 5)
    assert run(spark, docs, items, most_postings=60) == brute(docs, items)
    assert run(spark, docs[:30], items[:6], most_bytes=1) == brute(docs[:30], items[:6])


def test_ties_and_empty_tables(spark):
    docs = [(k, "same words here") for k in range(120, 0, -1)] + [(500, "other")]
    got = run(spark, docs, [(1, "words")])
    assert sorted((r[1], r[2]) for r in got) == [(k, k) for k in range(1, 51)]
    assert run(spark, [], [(1, "words")]) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], [(1, "words")]) == []


@pytest.mark.parametrize("piece", [3, 7, 64, 1 << 20])
def test_terms_are_whole_words(piece):
    own = [b"ab", b"abc", b"b", "é".encode(), "éa".encode(), b"9"]
    text = "ab abc, AB;b é éa éab x b 9-9 abab ab " * 20 + "abc" * 50 + " ab"
    got = lexical.term_counts(lexical.automaton(own), text.encode(), piece)
    want = Counter(terms(text))
    assert {own[k].decode(): v for k, v in got.items()} == {t.decode(): want[t.decode()] for t in own if want[t.decode()]}


def test_best_rows_are_kept_as_they_come():
    rng = np.random.default_rng(1)
    kept, rows = lexical._Best(7, 5), []
    for _ in range(60):
        scores, docs, missing = rng.integers(0, 40, (50, 7)), rng.integers(0, 1000, 50), rng.random(50) < 0.05
        kept.add(scores, docs, missing)
        rows += [(i, -int(s[i]), bool(x), int(d)) for s, d, x in zip(scores, docs, missing, strict=True) for i in range(7) if s[i] > 0]
    item, score, doc, missing = kept.settle()
    want = [r for i in range(7) for r in sorted(x for x in rows if x[0] == i)[:5]]
    assert list(zip(item.tolist(), (-score).tolist(), missing.tolist(), doc.tolist(), strict=True)) == want
