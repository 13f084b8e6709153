"""N-gram Jaccard self-join by a MinHash LSH forest.

Documents are sets of shingles of five words. A signature has TREES groups of MAX_DEPTH minima; each group is a path in a
prefix trie of its own, and a trie is its paths in sorted order (a path is one number: a hash of its first LEAST minima
and a byte of each later one, so prefixes of paths are prefixes of numbers). Paths that share no prefix of LEAST minima
with another text go at once.

Matching starts at full depth, and a text's prefixes are shortened as long as a partner could be missed: down to the
depth at which one of the least similarity that is possible for a text of its size (and at least ``threshold``) shares a
prefix in some trie with probability ``recall`` (a text of two shingles has only partners with the same two: it stays at
full depth). Texts under one prefix are verified exactly by their shingles: at full depth each with the least one of its
prefix, then, at full depth and under the shortened prefixes, all those that aren't of one class yet, in blocks of
bounded size; a prefix whose texts are all of one class by then isn't looked at again. Sets of shingle hashes travel, not
texts, and only those of texts that share a prefix.

Classes are components of verified links. In a class, links are counted by products of the shingle incidence matrices
of blocks, spread over many tasks, without being emitted. Texts of the same word sequence are one text to the join.

Defined results: a text without words is alone; one of fewer than five words has one shingle of all of them; repeated
rows are in one class; ties for the row that stays go to the least row of the least id; of null ids the class has the
least non-null one, if there is one; an empty table gives an empty result; other columns don't matter. Word sequences
and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwork.llm import bloom, buckets, buffers
from shelfwork.llm.storage import drop, short_batches, stash

WIDTH = 5
TREES = 32
MAX_DEPTH = 10
#: No text needs a shorter prefix at the thresholds and recalls that are allowed.
LEAST = 8
#: Texts of more shingles have partners of about any similarity.
SMALL = 64
THRESHOLD = (4, 5)
RECALL = 0.995
#: Texts that meet in one verification; a larger group is dealt to pairs of such blocks.
BLOCK = 400
#: Tries that are looked at first; in the others, texts that are of one class by then aren't compared again.
FIRST_TREES = 4

_A = (buffers.mix(np.arange(1, TREES * MAX_DEPTH + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (buffers.mix(np.arange(1001, TREES * MAX_DEPTH + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def depth_for(threshold: float, recall: float, trees: int = TREES, longest: int = MAX_DEPTH) -> int:
    """Shorten the prefix until texts at the threshold are found with probability ``recall``."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def least_similarity(n: int, threshold: tuple[int, int] = THRESHOLD) -> float:
    """The least similarity of at least ``threshold`` that a set of ``n`` shingles can have with any set."""
    up, down = threshold
    # of i shared shingles the union has n at least, and i * down / up at most
    return min(i / (i * down // up) for i in range(-(-up * n // down), n + 1))


def depths(threshold: tuple[int, int], recall: float) -> np.ndarray:
    """The depth that texts of 1 to SMALL distinct shingles are shortened to, and at 0 that of larger ones."""
    every = depth_for(threshold[0] / threshold[1], recall)
    if every < LEAST:
        raise ValueError(f"{TREES} tries of {LEAST} to {MAX_DEPTH} minima don't reach this recall at this threshold")
    return np.array([every] + [max(LEAST, depth_for(least_similarity(n, threshold), recall)) for n in range(1, SMALL + 1)], np.int32)


def paths(hashes: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """(rows with shingles, TREES) paths: 47 bits of a hash of the first LEAST minima, then 8 bits of each of the others."""
    starts, _ = buffers.segments(per_row)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(starts), TREES), np.uint64)
    if not len(starts):
        return out
    for tree in range(TREES):
        key = np.full(len(starts), tree + 1, np.uint64)
        for level in range(MAX_DEPTH):
            k = tree * MAX_DEPTH + level
            least = np.minimum.reduceat(x * _A[k] ^ _B[k], starts).astype(np.uint64)
            if level < LEAST:
                key = buffers.mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
            else:
                key = (key >> np.uint64(17) if level == LEAST else key) << np.uint64(8) | buffers.mix(least + np.uint64(level)) >> np.uint64(56)
        out[:, tree] = key
    return out


def _identity(words: buffers.Words) -> np.ndarray:
    """A hash of each row's word sequence."""
    a, b = buffers.sequence_hash(words)
    return buffers.mix(a ^ buffers.mix(b))


def _stops(hashes: np.ndarray, per: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The depth of each row with shingles."""
    own = per[per > 0]
    small = np.repeat(own <= SMALL, own)
    row = np.repeat(np.arange(len(own)), own)[small]
    order = np.lexsort((hashes[small], row))
    h, row = hashes[small][order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return depth[np.bincount(row[first], minlength=len(own))]


def _signed(depth: np.ndarray):
    def run(batches):
        for batch in batches:
            for first, end, data, at in buffers.blocks(batch.column(2)):
                words = buffers.Words(data, at)
                hashes, per = buffers.shingles(words, WIDTH)
                some = per > 0
                keys = paths(hashes, per).view(np.int64)
                stop = np.zeros(len(per), np.int32)
                stop[some] = _stops(hashes, per, depth)
                upto = np.concatenate([[0], np.cumsum(some * TREES)]).astype(np.int32)
                uid = pa.array(_identity(words).view(np.int64), mask=~some)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), uid, pa.array(stop), pa.array(8 * per.astype(np.int64)), pa.ListArray.from_arrays(pa.array(upto), pa.array(keys.ravel()))], names=["doc_id", "row_hash", "uid", "stop", "size", "paths"])

    return run


def signatures(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL) -> DataFrame:
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))
    return rows.mapInArrow(_signed(depths(threshold, recall)), "doc_id long, row_hash long, uid long, stop int, size long, paths array<long>")


def _prefix(depth: int):
    return F.shiftright("path", 8 * (MAX_DEPTH - depth))


def forest(signed: DataFrame) -> DataFrame:
    """uid, stop, size (bytes that its shingle set has at most), tree, path of all texts, each once, under a prefix of LEAST minima that another text has too, in the
    order of the tries."""
    rows = signed.where("uid is not null").groupBy("uid").agg(F.first("stop").alias("stop"), F.first("size").alias("size"), F.first("paths").alias("paths"))
    rows = stash(rows, "texts").select("uid", "stop", "size", F.posexplode("paths").alias("tree", "path")).withColumn("prefix", _prefix(LEAST))
    shared = rows.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = rows.join(shared, ["tree", "prefix"]).select("uid", "stop", "size", "tree", "path")
    return stash(found.sortWithinPartitions("tree", "path"), "forest")


def _sets(table):
    """(uid, payload) of texts that may be in the forest, each once in a block: sorted distinct hashes of 64 bits."""

    def run(batches):
        for batch in batches:
            for _, _, data, at in buffers.blocks(batch.column(0)):
                words = buffers.Words(data, at)
                hashes, per = buffers.shingles(words, WIDTH)
                uid = _identity(words)
                hit = np.flatnonzero(bloom.maybe(table.value, uid) & (words.per_row > 0))
                hit = hit[np.sort(np.unique(uid[hit], return_index=True)[1])]
                end = np.cumsum(per)
                if len(hit):
                    sets = [_distinct(hashes[end[i] - per[i] : end[i]]).tobytes() for i in hit.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(uid[hit].view(np.int64)), pa.array(sets, pa.binary())], names=["uid", "payload"])

    return run


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def shingle_sets(docs: DataFrame, uids: DataFrame) -> DataFrame:
    """uid, payload (sorted shingle hashes) of each text that ``uids`` (uid) has."""
    table = docs.sparkSession.sparkContext.broadcast(bloom.gather(uids.select("uid")))
    sets = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_sets(table), "uid long, payload binary")
    return stash(sets.join(uids, "uid", "left_semi").dropDuplicates(["uid"]), "sets")


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Boolean matrix: which of ``left`` and ``right`` (positions in ``sets``) are similar enough, exactly."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    rank = np.cumsum(count > 1) - 1
    column = rank[column]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    step = 2048
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [first, first + step])
        o, c = owner[a:b], column[a:b] - first
        ml, mr = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        own = place_l[o] >= 0
        ml[place_l[o[own]], c[own]] = 1
        own = place_r[o] >= 0
        mr[place_r[o[own]], c[own]] = 1
        both += ml @ mr.T
    union = size[left][:, None] + size[right][None, :] - both
    return both * threshold[1] >= union * threshold[0]


def _similar(threshold: tuple[int, int]):
    def similar(x: bytes, y: bytes) -> bool:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if min(len(a), len(b)) * threshold[1] < max(len(a), len(b)) * threshold[0]:
            return False
        both = np.concatenate([a, b])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        return common * threshold[1] >= (len(a) + len(b) - common) * threshold[0]

    return similar


def _near(threshold: tuple[int, int]):
    return lambda payloads, left, right: linked([np.frombuffer(x, np.uint64) for x in payloads], left, right, threshold)


def links(docs: DataFrame, tries: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """uid, root, links of all texts with a verified partner."""
    sets = shingle_sets(docs, stash(tries.select("uid").distinct(), "uids"))
    at = lambda rows, depth: rows.select("uid", "size", "tree", _prefix(depth).alias("prefix"))
    first = [at(tries.where(some), MAX_DEPTH) for some in (F.col("tree") < FIRST_TREES, F.col("tree") >= FIRST_TREES)]
    shortened = [at(tries.where(F.col("stop") <= depth), depth).withColumn("tree", F.col("tree") + TREES * (MAX_DEPTH - depth)) for depth in range(MAX_DEPTH, LEAST - 1, -1)]
    found = buckets.classes(first, [reduce(DataFrame.unionByName, shortened)], sets, _similar(threshold), _near(threshold), BLOCK)
    members = found.select(F.col("node").alias("uid"), F.col("root").alias("unit")).join(sets.select("uid", F.length("payload").alias("size")), "uid")
    parts = members.groupBy("unit").agg(buckets.blocks(F.count(F.lit(1)), F.sum("size"), BLOCK).alias("parts"))
    placed = members.join(parts, "unit").withColumn("own", buckets.dealt(F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = placed.select("unit", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "uid", (F.col("own") > F.col("other")).cast("int").alias("side"))
    total = buckets.met(rows, sets, _near(threshold)).groupBy("uid").agg(F.sum("links").alias("links"))
    out = stash(total.join(found, F.col("uid") == F.col("node")).select("uid", "root", "links"), "linked")
    drop(sets)
    return out


def ngram_join(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), n_links (other texts it is linked with), class_size, kept (one row
    of each class), row_hash for every row."""
    short_batches(docs)
    signed = stash(signatures(docs, threshold, recall).withColumn("row", F.monotonically_increasing_id()), "signatures")
    found = links(docs, forest(signed), threshold).withColumnRenamed("uid", "u")
    rows = signed.select("row", "doc_id", "row_hash", "uid").join(found, F.col("uid") == F.col("u"), "left")
    # a text without words is a class of its own, and named apart from all hashes
    rows = rows.select("row", "doc_id", "row_hash", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("root", "uid").alias("class"), F.when(F.col("uid").isNull(), F.col("row")).alias("alone"))
    rows = stash(rows, "classed")
    key = ["class", "alone"]
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("class_size"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("head")).where("class_size > 1")
    c, s = rows.alias("c"), sizes.alias("s")
    out = c.join(s, (F.col("c.class") == F.col("s.class")) & F.col("c.alone").isNull(), "left")
    return out.select(
        "doc_id", F.coalesce("head.doc_id", "doc_id").alias("class_id"), F.col("n_links").cast("long").alias("n_links"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.coalesce("head.row", "row") == F.col("row")).alias("kept"), "row_hash",
    )
