"""Ranked lexical search by scanning documents with an automaton of the items' terms.

No index of documents is built. All different terms of the items become one Aho-Corasick automaton, each between guards
that stand for the ends of a word, and every task runs it over the texts it reads: its outputs are the terms that occur,
as often as they occur, and a term leads to the items that have it. Two scans are made, as a score needs how many
documents hold a term: the first gathers these numbers, the second scores, keeps each item's best of the task and sends
those on. Best rows meet by item and group of tasks first, then by item.

Items are searched in blocks of at most MOST_POSTINGS pairs of item and term and MOST_BYTES of terms (or of one item),
counted before, since the automaton is broadcast; each block is a pair of scans, and blocks are halved until they fit.

Defined results: null and texts without terms are no documents of the corpus (N, L) and are never listed; empty tables give
an empty result; items without terms or without a match have no rows; rows of one item_id are one item of all their
terms, those without an id are one as well; repeated rows of documents are ranked each; of equal scores rows without a
doc_id are last. Other columns don't matter, whatever their names. Texts are scanned in pieces of some megabytes.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwork.llm import buffers
from shelfwork.llm.storage import short_batches, stash

BEST = 50
MOST_POSTINGS = 400_000
MOST_BYTES = 1 << 23
#: A text is scanned in pieces of about so many bytes.
PIECE = 1 << 22
#: Scores of a batch of documents, one for each item, are held at once up to this number.
SCORES = 1 << 21

#: A-Z lower-cased; all that is no part of a term is a space, the guard.
_NORMAL = bytes(0x20 if buffers.NOT_ALNUM[b] else int(buffers.LOWER[b]) for b in range(256))


def automaton(terms: list[bytes]):
    """Terms between guards. A byte is a character, so any UTF-8 text can be scanned."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        found.add_word(f" {term.decode('latin-1')} ", k)
    if terms:
        found.make_automaton()
    return found


def term_counts(scanner, text: bytes, piece: int = PIECE) -> Counter:
    """How often each term of the automaton occurs as a whole word. Pieces are cut between words; both have the guard."""
    found: Counter = Counter()
    if not len(scanner):
        return found
    first = 0
    while first < len(text):
        end = min(first + piece, len(text))
        part = text[first:end].translate(_NORMAL)
        if end < len(text):
            cut = part.rfind(b" ")
            while cut < 0 and end < len(text):
                more = text[end : end + piece].translate(_NORMAL)
                part, end = part + more, min(end + piece, len(text))
                cut = part.rfind(b" ")
            if cut >= 0 and end < len(text):
                part = part[: cut + 1]
        found.update(map(itemgetter(1), scanner.iter(f" {part.decode('latin-1')} ")))
        first += len(part)
    return found


def _texts(batches):
    """(doc_ids, bytes, number of terms of each) of blocks of rows."""
    for batch in batches:
        for first, end, data, at in buffers.blocks(batch.column(1)):
            inside = ~buffers.NOT_ALNUM[data]
            new = inside.copy()
            new[1:] &= ~inside[:-1]
            edges = at[:-1][np.diff(at) > 0]
            new[edges] = inside[edges]
            whole = data.tobytes()
            yield batch.column(0).slice(first, end - first), [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], buffers.sums(new, np.diff(at), np.int64)


def _terms(batches):
    """item, term of every different term of a row."""
    for batch in batches:
        for first, end, data, at in buffers.blocks(batch.column(1)):
            items, terms = [], []
            for r in range(end - first):
                own = {*data[at[r] : at[r + 1]].tobytes().translate(_NORMAL).split()}
                items += [batch.column(0)[first + r].as_py()] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([pa.array(items, batch.column(0).type), pa.array(terms, pa.binary())], names=["item_id", "term"])


#: Keys of the first scan's results that aren't terms.
N_DOCS, N_TERMS = -1, -2


def _first_scan(shared):
    def run(batches):
        terms, _ = shared.value
        scanner = automaton(terms)
        held, docs, length = np.zeros(len(terms), np.int64), 0, 0
        for _, texts, n in _texts(batches):
            docs, length = docs + int((n > 0).sum()), length + int(n.sum())
            for text in texts:
                known = term_counts(scanner, text)
                if known:
                    held[np.fromiter(known, np.int64, len(known))] += 1
        seen = np.flatnonzero(held)
        keys, values = np.append(seen, [N_DOCS, N_TERMS]), np.append(held[seen], [docs, length])
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(values.astype(np.int64))], names=["key", "n"])

    return run


class _Best:
    """The best rows of each item so far; rows that can't be among them are dropped as more come in."""

    def __init__(self, items: int, most: int):
        self.most, self.least = most, np.zeros(items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros(0, bool)]
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, docs: np.ndarray, missing: np.ndarray) -> None:
        """``scores``: a row for each document, a column for each item."""
        row, item = np.nonzero((scores > 0) & (scores >= self.least))
        self.new.append((item.astype(np.int64), scores[row, item], docs[row], missing[row]))
        self.waiting += len(row)
        if self.waiting > 4 * self.most * len(self.least) + 10_000:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        item, score, doc, missing = (np.concatenate([a, *(x[k] for x in self.new)]) for k, a in enumerate(self.rows))
        order = np.lexsort((doc, missing, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.most]
        self.rows, self.new, self.waiting = [x[order] for x in (np.concatenate([a, *(x[k] for x in self.new)]) for k, a in enumerate(self.rows))], [], 0
        item, score = self.rows[0], self.rows[1]
        last = np.flatnonzero(np.arange(len(item)) - np.searchsorted(item, item) == self.most - 1)
        self.least[item[last]] = score[last]
        return self.rows


def saturation(tf: np.ndarray, m: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 20 * m)."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _second_scan(shared, weights: np.ndarray, n_docs: int, n_terms: int, items: int, best: int, groups: int):
    def run(batches):
        terms, (starts, of) = shared.value
        scanner, kept = automaton(terms), _Best(items, best)
        degree, rows = np.diff(starts), max(1, SCORES // max(items, 1))
        pending: list[tuple] = []

        def flush():
            if not pending:
                return
            scores = np.zeros(len(pending) * items, np.int64)
            for k, (_, ids, value) in enumerate(pending):
                n = degree[ids]
                at = np.repeat(starts[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                np.add.at(scores[k * items : (k + 1) * items], of[at], np.repeat(value, n))
            docs = np.array([0 if d is None else d for d, _, _ in pending], np.int64)
            kept.add(scores.reshape(len(pending), items), docs, np.array([d is None for d, _, _ in pending]))
            pending.clear()

        for doc_ids, texts, n in _texts(batches):
            for doc, text, length in zip(doc_ids.to_pylist(), texts, n.tolist(), strict=True):
                known = term_counts(scanner, text)
                if known:
                    ids, tf = np.fromiter(known.keys(), np.int64, len(known)), np.fromiter(known.values(), np.int64, len(known))
                    pending.append((doc, ids, weights[ids] * saturation(tf, 50 + 50 * length * n_docs // n_terms)))
                    if len(pending) >= rows:
                        flush()
        flush()
        item, score, doc, missing = kept.settle()
        group = TaskContext.get().partitionId() % groups if TaskContext.get() else 0
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(np.full(len(item), group, np.int32)), pa.array(doc, mask=missing), pa.array(score)], names=["item", "group", "doc_id", "score"])

    return run


def _blocks(pairs: DataFrame, postings: int, size: int) -> list[tuple[int, list[int]]]:
    """(number of blocks, those of them that fit) until all do: an item's block is its hash modulo that number. A block of one item fits."""
    found, n, todo = [], 1, [0]
    while todo:
        block = F.pmod(F.xxhash64("item_id"), F.lit(n))
        sizes = {r["b"]: r for r in pairs.groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("bytes"), F.min("item_id").eqNullSafe(F.max("item_id")).alias("one")).where(F.col("b").isin(todo)).collect()}
        fits = [b for b in todo if b in sizes and (sizes[b]["one"] or (sizes[b]["n"] <= postings and sizes[b]["bytes"] <= size))]
        found.append((n, fits))
        todo, n = [c for b in todo if b in sizes and b not in fits for c in (b, b + n)], 2 * n
    return found


def search(docs: DataFrame, items: DataFrame, best: int = BEST, most_postings: int = MOST_POSTINGS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` rows of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    short_batches(docs)
    kind = items.schema["item_id"].dataType
    asked = items.select("item_id", F.col("text").cast("string").alias("text"))
    pairs = stash(asked.mapInArrow(_terms, f"item_id {kind.simpleString()}, term binary").distinct(), "item-terms")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    result = None
    for n, fits in _blocks(pairs, most_postings, most_bytes):
        for b in fits:
            own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).orderBy("item_id", "term").collect()  # bounded by the block
            ids: dict = {}
            terms: dict[bytes, list[int]] = {}
            for r in own:
                terms.setdefault(bytes(r["term"]), []).append(ids.setdefault(r["item_id"], len(ids)))
            starts = np.cumsum([0, *map(len, terms.values())])
            shared = spark.sparkContext.broadcast((list(terms), (starts, np.array([i for x in terms.values() for i in x], np.int64))))
            counts = {r["key"]: r["n"] for r in rows.mapInArrow(_first_scan(shared), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the block
            n_docs, n_terms = counts.get(N_DOCS, 0), counts.get(N_TERMS, 0)
            if not n_docs:
                continue
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(k, 0) + 1))) for k in range(len(terms))], np.int64)
            found = rows.mapInArrow(_second_scan(shared, weights, n_docs, n_terms, len(ids), best, groups), "item int, group int, doc_id long, score long")
            for by in (["item", "group"], ["item"]):
                found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= best)
            names = spark.createDataFrame([(k, i) for i, k in ids.items()], f"item int, item_id {kind.simpleString()}")
            one = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
            result = one if result is None else result.unionByName(one)
    if result is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return result
