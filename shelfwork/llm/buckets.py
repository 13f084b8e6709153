"""Classes of texts that are similar to one another, from buckets of texts that may be.

A row (uid, tree, prefix) says that a text lies in a bucket. Every bucket's texts are verified: first each with the least
text of its bucket, in two rounds, then all those that aren't of one class by then, in blocks of bounded size. So no
link between two texts of a bucket is lost as far as classes go, a hot class costs a row for each text, and a bucket
whose texts are all of one class isn't looked at again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwork.llm.components import components
from shelfwork.llm.storage import drop, stash

#: Bytes of the texts that meet in one verification, about.
BLOCK_BYTES = 16 << 20
#: Texts that are compared with their head in one task, about.
PER_HEAD = 2000
#: Times that what texts bring along (a sketch, or the text itself) is sent at once, on average: what takes more takes more rounds, so
#: that the disk for a round grows with the texts only, however many buckets these share.
AT_ONCE = 3
#: Says of pairs of payloads which are linked.
Judge = Callable[[list[tuple[bytes, bytes]]], Iterable[bool]]


def one_by_one(similar: Callable[[bytes, bytes], bool]) -> Judge:
    return lambda pairs: [similar(x, y) for x, y in pairs]


class Sift(Protocol):
    """Parts pairs of texts that can't be linked, by sketches of ``size`` bytes."""

    size: int

    def pairs(self, pairs: DataFrame) -> DataFrame:
        """Those of (uid, head) that aren't parted."""

    def met(self, rows: DataFrame) -> DataFrame:
        """(uid, head, n, n_head, unit, lo, hi), of different classes, that aren't parted, of ``paired_blocks``; n are lengths."""


#: Gives (uid, payload) of texts (uid), and maybe of others.
Texts = Callable[[DataFrame], DataFrame]


def _texts(payloads: DataFrame | Texts) -> Texts:
    return payloads if callable(payloads) else lambda uids: payloads


def _with_head(judge: Judge):
    """Rows come sorted by (head, part), the head's own first: the links of a head with the others."""

    def run(batches):
        now, x = None, None
        for batch in batches:
            names, pairs = [], []
            for head, part, own, uid, y in zip(*(batch.column(c).to_pylist() for c in ("head", "part", "own", "uid", "payload")), strict=True):
                if own == 0:
                    now, x = (head, part), y
                elif now == (head, part):
                    names.append((uid, head))
                    pairs.append((x, y))
            found = [n for n, linked in zip(names, judge(pairs), strict=True) if linked]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def head_pairs(at: DataFrame) -> DataFrame:
    """(uid, head) of texts and the least one of their bucket, where these aren't of one class. ``at``: uid, class, tree, prefix."""
    heads = at.groupBy("tree", "prefix").agg(F.min(F.struct("uid", "class")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = heads.select("tree", "prefix", F.col("first.uid").alias("head"), F.col("first.class").alias("of_head"))
    return at.join(heads, ["tree", "prefix"]).where("class <> of_head").select("uid", "head").distinct()


def verified(pairs: DataFrame, payloads: DataFrame | Texts, judge: Judge) -> DataFrame:
    """(a, b): those of the pairs (uid, head) that are linked. ``payloads``: uid, payload."""
    payloads = _texts(payloads)(pairs.select("uid").unionByName(pairs.select(F.col("head").alias("uid"))))
    parts = pairs.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / PER_HEAD).cast("int").alias("parts"))
    members = pairs.join(parts, "head").select("head", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("own"), "uid")
    own = parts.select("head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("own"), F.col("head").alias("uid"))
    met = members.unionByName(own).join(payloads, "uid").repartition("head", "part").sortWithinPartitions("head", "part", "own")
    return met.select("head", "part", "own", "uid", "payload").mapInArrow(_with_head(judge), "a long, b long")


def _in_groups(judge: Judge):
    """Rows come sorted by (unit, lo, hi, i, j), the texts of a group first, then its pairs by head: those that are linked."""

    def run(batches):
        now, texts = None, {}
        for batch in batches:
            names, pairs = [], []
            for *group, uid, head, payload in zip(*(batch.column(c).to_pylist() for c in ("unit", "lo", "hi", "i", "j", "uid", "head", "payload")), strict=True):
                if now != group:
                    now, texts = group, {}
                if head is None:
                    texts[uid] = payload
                else:
                    names.append((uid, head))
                    pairs.append((texts[head], texts[uid]))
            found = [n for n, linked in zip(names, judge(pairs), strict=True) if linked]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def verified_in_groups(pairs: DataFrame, payloads: DataFrame | Texts, judge: Judge) -> DataFrame:
    """(a, b): as ``verified``, of pairs (uid, head, n, n_head, unit, lo, hi) that say in which block they met: a text goes to each
    of these blocks once, whatever the number of its pairs there. Texts of more than BLOCK_BYTES are dealt to parts."""
    block, key = ["unit", "lo", "hi"], ["unit", "lo", "hi", "i", "j"]
    ends = pairs.select(*block, F.explode(F.array(F.struct("uid", "n"), F.struct(F.col("head").alias("uid"), F.col("n_head").alias("n")))).alias("e")).select(*block, "e.*")
    parts = ends.distinct().groupBy(*block).agg(F.ceil(F.sum("n") / BLOCK_BYTES).cast("int").alias("parts")).where("parts > 1")
    part = lambda c: F.pmod(F.xxhash64(c), F.coalesce("parts", F.lit(1))).cast("int")
    placed = pairs.join(parts, block, "left").select(*block, part("uid").alias("i"), part("head").alias("j"), "uid", "head")
    sent = placed.select(*key, F.explode(F.array("uid", "head")).alias("uid")).distinct()
    sent = sent.join(_texts(payloads)(ends.select("uid")), "uid").select(*key, "uid", F.lit(None).cast("long").alias("head"), "payload")
    rows = sent.unionByName(placed.withColumn("payload", F.lit(None).cast("binary"))).repartition(*key)
    return rows.sortWithinPartitions(*key, F.asc_nulls_first("head")).mapInArrow(_in_groups(judge), "a long, b long")


def head_links(at: DataFrame, payloads: DataFrame | Texts, judge: Judge, sift: Sift | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b): verified links of texts with the least one of their bucket. The second table is scratch."""
    pairs = head_pairs(at)
    pairs = stash(pairs, "pairs")
    if sift:
        all_pairs, pairs = pairs, stash(sift.pairs(pairs), "pairs")
        drop(all_pairs)
    return verified(pairs, payloads, judge), pairs


def _verified(near: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]):
    """Rows come sorted by (unit, lo, hi, uid): uid, least linked uid of its group, number of links."""

    def check(key, uids, sides, payloads):
        uid, side = np.array(uids, np.int64), np.array(sides)
        left = np.flatnonzero(side == 0)
        right = left if key[1] == key[2] else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return None
        n = len(uid)
        full = np.zeros((n, n), bool)
        full[np.ix_(left, right)] = near(payloads, left, right)
        full |= full.T
        np.fill_diagonal(full, False)
        links = full.sum(axis=1)
        root = np.arange(n)
        unseen = links > 0
        while unseen.any():
            start = int(np.flatnonzero(unseen)[0])
            member, edge = np.zeros(n, bool), np.zeros(n, bool)
            member[start] = edge[start] = True
            while edge.any():
                edge = full[edge].any(axis=0) & ~member
                member |= edge
            root[member] = np.flatnonzero(member)[np.argmin(uid[member])]
            unseen &= ~member
        own = links > 0
        return (uid[own], uid[root[own]], links[own].astype(np.int64)) if own.any() else None

    def run(batches):
        key, uids, sides, payloads = None, [], [], []
        out = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("unit", "lo", "hi", "uid", "side", "payload")), strict=True):
                if row[:3] != key:
                    if len(uids) > 1 and (got := check(key, uids, sides, payloads)):
                        out.append(got)
                    key, uids, sides, payloads = row[:3], [], [], []
                uids.append(row[3])
                sides.append(row[4])
                payloads.append(row[5])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["uid", "least", "links"])
                out = []
        if len(uids) > 1 and (got := check(key, uids, sides, payloads)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["uid", "least", "links"])

    return run


def met(rows: DataFrame, payloads: DataFrame, near) -> DataFrame:
    """uid, least, links of verified blocks. ``rows``: unit, lo, hi (a block, or a pair of them), uid, side."""
    key = ["unit", "lo", "hi"]
    pairs = rows.join(payloads, "uid").repartition(*key).sortWithinPartitions(*key, "uid")
    return pairs.select(*key, "uid", "side", "payload").mapInArrow(_verified(near), "uid long, least long, links long")


def blocks(n, size, block: int):
    """Blocks of ``block`` texts for so many texts of so many bytes."""
    return F.greatest(F.ceil(n / block), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")


def dealt(parts):
    return F.pmod(F.xxhash64("uid"), parts).cast("int")


def mixed_members(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """(unit, uid, class, size) of the buckets (tree, prefix) whose texts aren't all of one class; buckets of the same texts in
    several trees are one. ``rows``: uid, class, tree, prefix; ``sized``: the same with size."""
    key = ["tree", "prefix"]
    groups = rows.groupBy(*key).agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("uid").cast("decimal(20,0)")).alias("names")).where("lo <> hi")
    groups = groups.dropDuplicates(["n", "names"]).select(*key, F.xxhash64(*key).alias("unit"))
    return stash(sized.join(groups, key).select("unit", "uid", "class", "size"), "members")


def paired_blocks(members: DataFrame, block: int) -> DataFrame:
    """(unit, lo, hi, uid, class, side): the pairs of blocks of a unit that have to meet. Of a unit, its largest class isn't
    compared with itself."""
    by_class = members.groupBy("unit", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    units = by_class.groupBy("unit").agg(F.max(F.struct("n", "class", "size")).alias("big"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    units = units.select("unit", F.col("big.class").alias("big"), blocks(F.col("big.n"), F.col("big.size"), block).alias("of_big"), blocks(F.col("n") - F.col("big.n"), F.col("size") - F.col("big.size"), block).alias("of_rest"))
    placed = members.join(units, "unit").withColumn("own", F.when(F.col("class") == F.col("big"), dealt(F.col("of_big")) + F.col("of_rest")).otherwise(dealt(F.col("of_rest"))))
    # blocks of strangers come first: each meets all blocks, those of the largest class meet only strangers
    last = F.when(F.col("own") < F.col("of_rest"), F.col("of_rest") + F.col("of_big") - 1).otherwise(F.col("of_rest") - 1)
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return pairs.select("unit", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "uid", "class", (F.col("own") > F.col("other")).cast("int").alias("side"))


def mixed_links(rows: DataFrame, payloads: DataFrame, near, block: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): verified links between texts in one bucket (tree, prefix) that aren't of one class. ``rows``: uid, class,
    tree, prefix. Of a group, its largest class isn't compared with itself, so a hot class costs a row for each
    text and stranger's block. Groups of the same texts in several trees are one. Rows that come with the ``size`` of their
    payload (at most so many bytes) don't meet the payloads before the groups are dealt to blocks."""
    sized = rows if "size" in rows.columns else rows.join(payloads.select("uid", F.length("payload").alias("size")), "uid")
    members = mixed_members(rows, sized)
    pairs = paired_blocks(members, block).drop("class")
    return met(pairs, payloads, near).select(F.col("uid").alias("a"), F.col("least").alias("b")), members


def sifted_links(rows: DataFrame, payloads: DataFrame | Texts, judge: Judge, sift: Sift, block: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): as ``mixed_links``, but only sketches of fixed size meet in the buckets. Pairs that they don't part are verified
    once each, whatever the number of buckets they share."""
    members = mixed_members(rows, rows.withColumn("size", F.lit(sift.size)))
    block_of = F.struct("unit", "lo", "hi", "n", "n_head")
    n = members.agg(F.count(F.lit(1)).alias("sent"), F.count_distinct("uid").alias("texts")).first()
    found = [stash(sift.met(paired_blocks(part, block)).groupBy("uid", "head").agg(F.min(block_of).alias("at")), "met") for part in _rounds(members, n["sent"], n["texts"])]
    drop(members)
    pairs = stash(reduce(DataFrame.unionByName, found).groupBy("uid", "head").agg(F.min("at").alias("at")).select("uid", "head", "at.*"), "pairs")
    for part in found:
        drop(part)
    ends = pairs.select("unit", "lo", "hi", F.explode(F.array(F.struct("uid", "n"), F.struct(F.col("head").alias("uid"), F.col("n_head").alias("n")))).alias("e"))
    sent = ends.distinct().agg(F.sum("e.n")).first()[0]
    texts = ends.select("e").distinct().agg(F.sum("e.n")).first()[0]
    links = [stash(verified_in_groups(part, payloads, judge), "links") for part in _rounds(pairs, sent, texts)]
    names = pairs.select("uid", "head")
    names.stashed = pairs.stashed
    return reduce(DataFrame.unionByName, links), names


def _rounds(rows: DataFrame, sent: int | None, texts: int | None) -> list[DataFrame]:
    """``rows`` by units in as many parts as keep what is sent for each below AT_ONCE times ``texts``, about."""
    count = max(1, -(-(sent or 0) // (AT_ONCE * max(texts or 0, 1))))
    return [rows.where(F.pmod(F.xxhash64("unit", F.lit(3)), F.lit(count)) == k) for k in range(count)] if count > 1 else [rows]


def _grown(found: DataFrame, links: DataFrame, scratch: DataFrame) -> DataFrame:
    """Classes (node, root) with more links between their members."""
    more = stash(links, "links")
    drop(scratch)
    return found if more.isEmpty() else components(more.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def classes(first: list[DataFrame], then: list[DataFrame], payloads: DataFrame | Texts, similar, near, block: int, sift: Sift | None = None) -> DataFrame:
    """(node, root) of all texts that have a verified link. ``first`` and ``then``: rows (uid, tree, prefix) whose texts meet
    the least one of their bucket, and those whose texts of different classes all meet; ``similar`` says of two payloads
    whether they are linked, ``near`` of many, as a matrix of (left, right). With ``sift``, sketches meet before payloads do,
    which may be given for so many texts as are asked for; ``similar`` is a judge of many pairs, and ``near`` isn't used."""
    found = then[0].select(F.col("uid").alias("node"), F.col("uid").alias("root")).where(F.lit(False))

    def at(rows: DataFrame) -> DataFrame:
        own = found.select(F.col("node").alias("uid"), F.col("root").alias("class"))
        return rows.join(own, "uid", "left").withColumn("class", F.coalesce("class", "uid"))

    for rows in first:
        found = _grown(found, *head_links(at(rows), payloads, similar if sift else one_by_one(similar), sift))
    for rows in then:
        found = _grown(found, *(sifted_links(at(rows), payloads, similar, sift, block) if sift else mixed_links(at(rows), payloads, near, block)))
    return found
