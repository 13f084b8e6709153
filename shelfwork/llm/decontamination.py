"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words. Of the hashes of all runs of five words in a row the least one in every
sliding window of six is kept. A window of six runs spans ten words, so a span of ten words or more that a document
shares with a benchmark item has its fingerprint on both sides, wherever it lies: no such span is missed. Items of fewer
than ten words are one window each, winnowed with the runs and windows that their length allows; documents are winnowed
again for the lengths that occur.

A task keeps, of a document's fingerprints, those that may be among the benchmark's: two filters of fixed size are
broadcast, one for fingerprints and one for the windows that hits extend to. What is left is joined by Spark with the
benchmark's different windows on fingerprint and words, so hash collisions don't count and a pair of equal fingerprints
in different surroundings is no row. Words that several windows cover are counted once. Documents without a hit move
nowhere; the benchmark may have any size (its windows are broadcast up to MOST_BROADCAST bytes, counted before, else both
sides are shuffled).

Defined results: null and texts without words have no words, no hits, and the SHA-256 of the empty text; repeated rows
are rows of the result each; items of one id, whatever their number, count once; an item without an id makes words hit
but isn't counted or listed; an empty table of documents gives an empty result, an empty benchmark one without hits.
Other columns don't matter, whatever their names. A text is worked on in pieces of some megabytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwork.llm import bloom, buffers
from shelfwork.llm.storage import drop, short_batches, stash

#: Words of a window and of a run that is hashed.
WIDTH, GRAM = 10, 5
#: A text is cut into pieces of about so many bytes, which share the words of a window less one.
PIECE = 1 << 22
#: Windows of the benchmark are broadcast up to so many bytes of words.
MOST_BROADCAST = 1 << 24

_RNG = np.random.default_rng(86028157)
_STEP = _RNG.integers(0, 1 << 62, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def scheme(width: int) -> tuple[int, int]:
    """(words of a run, runs of a window) for windows of ``width`` words."""
    gram = min(GRAM, width)
    return gram, width - gram + 1


def _runs(h: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of ``n`` words from each place (or those of ``at``) on; places near the end of all words are filled up by 0."""
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    at = np.arange(len(h)) if at is None else at
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total += padded[at + k] * _STEP[k]
    return buffers.mix(total ^ np.uint64(n))


def winnow(h: np.ndarray, width: int) -> np.ndarray:
    """For each place the least hash of the window of ``width`` words that begins there: the window's fingerprint."""
    gram, window = scheme(width)
    runs = np.concatenate([_runs(h, gram), np.full(window, np.iinfo(np.uint64).max, np.uint64)])
    least = runs[: len(h)].copy()
    for k in range(1, window):
        np.minimum(least, runs[k : k + len(h)], out=least)
    return buffers.mix(least + np.uint64(width))


def selected(h: np.ndarray, width: int) -> np.ndarray:
    """The different fingerprints of a whole sequence of word hashes, for reference."""
    return np.unique(winnow(h, width)[: max(0, len(h) - width + 1)])


def _pieces(data: np.ndarray, size: int):
    """(bytes, words skipped before, words that were in the piece before) of a text, cut between words. A word that is
    longer than a piece stays whole."""
    first, skipped, again, done = 0, 0, 0, 0
    while True:
        end = min(done + size, len(data))
        if end < len(data):  # past what has been done, so that every piece is new in part
            apart = np.flatnonzero(buffers.NOT_ALNUM[data[done:end]])
            if len(apart):
                end = done + int(apart[-1]) + 1
            else:
                rest = np.flatnonzero(buffers.NOT_ALNUM[data[end:]])
                end = end + int(rest[0]) + 1 if len(rest) else len(data)
        words = buffers.Words(data[first:end], np.array([0, end - first]), apart=buffers.NOT_ALNUM)
        yield words, skipped, again
        if end == len(data):
            return
        n = len(words.start)
        kept = min(WIDTH - 1, n)
        skipped, again, done = skipped + n - kept, kept, end
        first = first + int(words.start[n - kept]) if kept else end


def _parts(column, size: int):
    """(rows, words, words skipped before, repeated words) of blocks of rows, and of pieces of rows longer than a piece."""
    for first, end, data, at in buffers.blocks(column):
        if end == first + 1 and len(data) > size:
            for words, skipped, again in _pieces(data, size):
                yield first, end, words, skipped, again
        else:
            yield first, end, buffers.Words(data, at, apart=buffers.NOT_ALNUM), 0, 0


def _windows(words: buffers.Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, place among all words) of every window."""
    per = words.per_row
    row = np.repeat(np.arange(len(per)), per)
    at = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    whole = np.flatnonzero(at + width <= per[row]) if len(row) else np.zeros(0, np.int64)
    return row[whole], at[whole], whole


def _text(words: buffers.Words, at: int, width: int) -> str:
    return b" ".join(words.text(k) for k in range(at, at + width)).decode("utf-8", "replace")


_ITEM = "item string, width int, fp long, wh long, span string"


def _of_items(size: int = PIECE):
    def run(batches):
        for batch in batches:
            for first, _, words, skipped, again in _parts(batch.column(1), size):
                out: list[list] = [[], [], [], [], []]
                for width in range(1, WIDTH + 1):
                    row, at, place = _windows(words, width)
                    if width < WIDTH:  # a short item is one window
                        own = (words.per_row[row] == width) & (skipped + again == 0)
                    else:
                        own = np.ones(len(row), bool)
                    if not own.any():
                        continue
                    row, place = row[own], place[own]
                    fp, wh = winnow(words.hash, width)[place], _runs(words.hash, width, place)
                    ids = batch.column(0)
                    out[0] += [ids[first + int(r)].as_py() for r in row]
                    out[1] += [width] * len(row)
                    out[2] += fp.view(np.int64).tolist()
                    out[3] += wh.view(np.int64).tolist()
                    out[4] += [_text(words, int(p), width) for p in place]
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.string())], names=["item", "width", "fp", "wh", "span"])

    return run


_HIT = pa.struct([("width", pa.int32()), ("fp", pa.int64()), ("start", pa.int64()), ("span", pa.string())])
_DOC = "uid long, doc_id long, n_words long, hits array<struct<width: int, fp: long, start: long, span: string>>"


def hits(words: buffers.Words, width: int, fingerprints: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, place among all words, fingerprint) of the windows that may be in the benchmark: a fingerprint
    is looked up once for all windows in a row that have it, then the window itself."""
    row, at, place = _windows(words, width)
    if not len(place):
        return row, at, place, np.zeros(0, np.uint64)
    fp = winnow(words.hash, width)[place]
    new = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
    known = bloom.maybe(fingerprints, fp[new])
    hit = np.flatnonzero(np.repeat(known, np.diff(np.append(new, len(fp)))))
    hit = hit[bloom.maybe(spans, _runs(words.hash, width, place[hit]))]
    return row[hit], at[hit], place[hit], fp[hit]


def _of_documents(widths: list[int], fingerprints: np.ndarray, spans: np.ndarray, size: int = PIECE):
    def run(batches):
        part, n = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        for batch in batches:
            rows = batch.num_rows
            count, found = np.zeros(rows, np.int64), [[] for _ in range(rows)]
            for first, _, words, skipped, again in _parts(batch.column(1), size):
                count[first : first + len(words.per_row)] += words.per_row - again
                for width in widths:
                    for r, a, p, f in zip(*(x.tolist() for x in hits(words, width, fingerprints, spans)), strict=True):
                        if a + width > again:  # else the piece before had it
                            found[first + r].append({"width": width, "fp": int(np.uint64(f).view(np.int64)), "start": skipped + a, "span": _text(words, p, width)})
            uid = np.arange(n, n + rows) + (part << 40)
            n += rows
            yield pa.RecordBatch.from_arrays([pa.array(uid), batch.column(0), pa.array(count), pa.array(found, pa.list_(_HIT))], names=["uid", "doc_id", "n_words", "hits"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs`` (doc_id, text), against ``items``
    (item_id, text)."""
    short_batches(docs)
    texts = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    own = stash(texts.mapInArrow(_of_items(), _ITEM).groupBy("width", "fp", "wh", "span").agg(F.sort_array(F.collect_set("item")).alias("items")), "benchmark-windows")
    widths = [r["width"] for r in own.select("width").distinct().orderBy("width").collect()]  # ten at most
    fingerprints, spans = bloom.gather(own.select("fp").distinct()), bloom.gather(own.select("wh").distinct())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stash(rows.mapInArrow(_of_documents(widths, fingerprints, spans), _DOC), "document-windows")

    size = own.agg(F.coalesce(F.sum(F.octet_length("span") + 20 + 24 * F.size("items")), F.lit(0))).first()[0]
    windows = own.drop("wh")
    windows = F.broadcast(windows) if size <= most_broadcast else windows
    hit = found.where(F.size("hits") > 0).select("uid", F.explode("hits").alias("h")).select("uid", "h.*")
    matched = stash(hit.join(windows, ["width", "fp", "span"]).select("uid", "start", (F.col("start") + F.col("width")).alias("end"), "items"), "document-hits")
    before = F.max("end").over(Window.partitionBy("uid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    covered = matched.select("uid", "start", "end").withColumn("new", new).groupBy("uid").agg(F.sum("new").cast("long").alias("n_hit"))
    listed = matched.select("uid", F.explode("items").alias("item")).distinct().groupBy("uid").agg(
        F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256")
    )
    counted = covered.join(listed, "uid", "left")
    nothing = F.sha2(F.lit(""), 256)
    n_hit, n_items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("n_items", F.lit(0)).cast("long")
    clean = found.where(F.size("hits") == 0).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), nothing.alias("items_sha256"), F.lit(False).alias("contaminated"))
    rest = found.where(F.size("hits") > 0).select("uid", "doc_id", "n_words").join(counted, "uid", "left")
    return clean.unionByName(rest.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.coalesce("items_sha256", nothing).alias("items_sha256"), (n_hit > 0).alias("contaminated")))
