from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwork.llm import langid, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _prose(rng, n):
    return " ".join(rng.choice("bcdfg") + rng.choice("aeiou") + str(rng.randrange(300)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(make, tmp_path_factory):
    rng = random.Random(21)
    texts = [_prose(rng, rng.randrange(20, 90)) for _ in range(60)]
    texts += [t.upper() for t in texts[:10]]  # exact copies
    texts += [t.replace(" ", "  ", 1) + " end" for t in texts[10:20]]  # near copies
    texts += [None, "", "12 34"]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}") for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("sf")
    make([*rows, rows[5]]).write.parquet(f"{path}/documents.parquet")
    return f"file://{path}"


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        if name != "best_fit_packing":
            assert after.columns == columns
        after.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = docs.collect()
    ids = {k: Counter(r.doc_id for r in v) for k, v in seen.items()}
    whole = [r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert set(ids["language_id"]) == set(whole) - {80, 81, 82} and ids["language_id"][5] == 2
    assert set(ids["exact_dedup"]) == set(range(10, 80)) and max(ids["exact_dedup"].values()) == 1
    assert set(ids["ngram_jaccard_join"]) == set(range(10, 70))
    kept = seen["ngram_jaccard_join"]
    size = {r.doc_id: len(WORD.findall(r.text)) for r in kept}
    mixed = Counter({i: n * size[i] for i, n in ids["source_mix"].items()})
    assert max(ids["source_mix"].values()) <= 2
    assert sum(mixed.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.2)
    assert Counter(r.doc_id for r in seen["best_fit_packing"] if r.piece == 0) == ids["source_mix"]


def test_run(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "source_mix", "best_fit_packing"]
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 0 and "sequence_id" in got.columns


def test_run_on_no_documents(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_language_stage_without_labels(spark, make):
    """Nothing to learn from: all documents with letters stay."""
    rows = [(i, t) for i, t in enumerate(["one two", "été", None, "", "12 34", "漢字"])]
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, make(rows), "").collect()} == {0, 1, 5}
    held_out = [(i, "alpha beta", "en") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert corpus_pipeline.language_id(spark, make(held_out), "").count() == len(held_out) > 0


def test_language_stage_rejects_by_score(spark, make):
    rng = random.Random(7)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop"}
    text = lambda k: " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(12))
    clean = [(i, text(k), k) for i in range(6000) for k in ["aa" if i % 2 else "bb"]]
    mixed = [(10_000 + i, " ".join(a + " " + b for a, b in zip(text("aa").split(), text("bb").split(), strict=True)), None) for i in range(60)]
    left = {r.doc_id for r in corpus_pipeline.language_id(spark, make(clean + mixed), "").collect()}
    assert sum(i < 10_000 for i in left) >= 0.995 * len(clean)
    assert sum(i >= 10_000 for i in left) < 40


def test_least_score_follows_the_least_sure_label(make):
    """One rule for any number of labels: half of the least odds."""
    docs = make([(i, f"some text {i}", "en" if i % 2 else "fr") for i in range(40)])
    model = langid.train(docs)
    for some in (docs, docs.where("doc_id < 3")):
        least = min(r.score for r in langid.identify(some, model).collect())
        odds = 0.5 * least / (1 - least)
        assert abs(langid.least_score(some, model) - odds / (1 + odds)) < 1e-9
    assert langid.least_score(docs.where("false"), model) == 0.0


def test_stages_take_columns_of_any_name(spark, make):
    """Names with dots, quotes and those that stages use themselves stay as they are, with their values."""
    rng = random.Random(3)
    docs = make([(i % 9, _prose(rng, 12), "en", "a") for i in range(12)] + [(1, "same", "en", "b"), (1, "same", "en", "b"), (None, "same", None, None)])
    names = ["k.z", "__shelfwork_doc", "row", "doc", "hash", "d", "h", "n", "a b", "q`t"]
    wide = docs.select("doc_id", "text", "lang", "source", *[F.concat(F.lit(f"{i}-"), F.col("text")).alias(x) for i, x in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, "")
        assert got.columns == wide.columns, name
        for r in got.collect():
            assert [r[i + 4] for i in range(len(names))] == [f"{i}-{r.text}" for i in range(len(names))]
    assert corpus_pipeline.exact_duplicates(spark, wide, "").where("text = 'same'").count() == 1


def test_near_duplicates_keep_the_least_id(make):
    rng = random.Random(2)
    t = _prose(rng, 100)
    got = ngram_join.ngram_join(make([(5, t), (3, t + " x"), (9, t + " y"), (1, _prose(rng, 50))]))
    assert {r.doc_id: (r.class_id, r.kept) for r in got.collect()} == {5: (3, False), 3: (3, True), 9: (3, False), 1: (1, True)}


def test_language_stage_rejects_beside_a_short_label(spark, make):
    """A labelled text that tells nothing of its language doesn't let everything pass, inside or outside the held-out fold."""
    rng = random.Random(17)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop"}
    text = lambda k: " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(12))
    clean = [(i, text(k), k) for i in range(3000) for k in ["aa" if i % 2 else "bb"]]
    held_out = [i for i in range(20_000, 20_100) if zlib.crc32(str(i).encode()) % 5 == 0]
    short = [(i, f"x{i % 3}", "aa" if i % 2 else "bb") for i in held_out]
    mixed = [(10_000 + i, " ".join(a + " " + b for a, b in zip(text("aa").split(), text("bb").split(), strict=True)), None) for i in range(60)]
    left = {r.doc_id for r in corpus_pipeline.language_id(spark, make(clean + short + mixed), "").collect()}
    assert sum(i < 10_000 for i in left) >= 0.995 * len(clean) and left >= set(held_out)
    assert sum(10_000 <= i < 20_000 for i in left) < 40
