"""Exact dedup by composable polynomial fingerprints.

A text is cut into chunks; each chunk is hashed by a polynomial modulo two primes and the chunk hashes combine by
length-shifted arithmetic, ``H(a + b) = H(a) * r ** len(b) + H(b)``, so the chunks of a huge text can be hashed apart, in
any grouping: texts above LONG bytes are dealt out as rows of chunks, each task hashes what it gets and shifts it by the
bytes that follow, and Spark adds up. Texts of equal fingerprint and length then meet chunk by chunk and are compared
as they stream past; a group in which any chunk differs is split by the SHA-256 of its texts, so a collision can't remove
a text. A text is fingerprinted again only if its CRC-32 and length are those of a repeated one.

A hot group is compared with one of its own in each Arrow batch first, then inside salts, of which there are more the
larger the largest group is, and then one member of each salt with the others.

Defined results: null counts as the empty text; all empty texts are one group; of repeated rows with one ``doc_id``
each is a row of the result and one of them is kept; an empty table gives an empty result; other columns of the input
don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwork.llm import bloom, buffers
from shelfwork.llm.storage import drop, short_batches, stash

#: Two primes below 2 ** 31 and a base for each: a product of residues fits in 64 bits.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1812433253)
CHUNK = 1 << 16
#: Texts above so many bytes are hashed as rows of chunks.
LONG = 1 << 20
SALTS = 16
#: Members of a group that a salt is made for, about.
PER_SALT = 1 << 16

_TABLES: dict[int, list[np.ndarray]] = {}


def _powers(chunk: int) -> list[np.ndarray]:
    """For each prime: base ** (chunk-1) .. base ** 0, so the last ``n`` entries weigh a chunk of ``n`` bytes."""
    if chunk not in _TABLES:
        found = []
        for p, r in zip(PRIMES, BASES, strict=True):
            t = np.ones(1, np.uint64)
            while len(t) < chunk:  # doubling: r ** (n + i) = r ** n * r ** i
                t = np.concatenate([t, t * np.uint64(pow(r, len(t), p)) % np.uint64(p)])
            found.append(np.ascontiguousarray(t[:chunk][::-1]))
        _TABLES[chunk] = found
    return _TABLES[chunk]


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """(hash, hash, length) of the concatenation from those of its parts."""
    a, b = ((x * pow(r, right[2], p) + y) % p for x, y, p, r in zip(left[:2], right[:2], PRIMES, BASES, strict=True))
    return a, b, left[2] + right[2]


def chunk_hash(data: np.ndarray, chunk: int = CHUNK) -> tuple[int, int, int]:
    """Hash of at most ``chunk`` bytes. A byte counts as its value + 1, so leading zero bytes matter."""
    v = data.astype(np.uint64) + np.uint64(1)
    a, b = (int((v * t[len(t) - len(v) :]).sum() % np.uint64(p)) for t, p in zip(_powers(chunk), PRIMES, strict=True))
    return a, b, len(data)


def fingerprint(data: np.ndarray, chunk: int = CHUNK) -> tuple[int, int, int]:
    out = (0, 0, 0)
    for at in range(0, len(data), chunk):
        out = combine(out, chunk_hash(data[at : at + chunk], chunk))
    return out


def _key(a: int, b: int) -> int:
    return a << 31 | b


_UPPER = bytes(buffers.LOWER.tobytes())


def _normal(data: np.ndarray) -> bytes:
    return data.tobytes().translate(_UPPER)


def _fingerprints(batches):
    for batch in batches:
        data, at = buffers.raw(batch.column(2))
        fps, sizes, shas, crcs = [], [], [], []
        for i in range(len(at) - 1):
            low = _normal(data[at[i] : at[i + 1]])
            fps.append(_key(*fingerprint(np.frombuffer(low, np.uint8))[:2]) if len(low) <= LONG else None)
            sizes.append(len(low))
            shas.append(hashlib.sha256(low).hexdigest())
            crcs.append(zlib.crc32(low))
        cols = [pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(shas, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols, batch.column(3)], names=["uid", "doc_id", "fp", "n_bytes", "crc", "text_sha256", "row_hash"])


_CHUNK = "sha string, after long, data binary"


def _chunks(batches):
    """The chunks of each text, with the number of bytes that follow."""
    for batch in batches:
        data, at = buffers.raw(batch.column(0))
        for i in range(len(at) - 1):
            low = _normal(data[at[i] : at[i + 1]])
            sha = hashlib.sha256(low).hexdigest()
            for first in range(0, len(low), 64 * CHUNK):  # some megabytes at once
                own = [low[k : min(k + CHUNK, len(low))] for k in range(first, min(first + 64 * CHUNK, len(low)), CHUNK)]
                after = [max(0, len(low) - k - CHUNK) for k in range(first, min(first + 64 * CHUNK, len(low)), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array([sha] * len(own)), pa.array(after, pa.int64()), pa.array(own, pa.binary())], names=["sha", "after", "data"])


def _shifted(batches):
    """The hash of each chunk, times the base to the power of the bytes that follow."""
    for batch in batches:
        after, found = batch.column(1).to_pylist(), []
        for n, data in zip(after, batch.column(2).to_pylist(), strict=True):
            own = chunk_hash(np.frombuffer(data, np.uint8))
            found.append([x * pow(r, n, p) % p for x, p, r in zip(own[:2], PRIMES, BASES, strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["sha", "after", "a", "b"])


def long_fingerprints(docs: DataFrame) -> DataFrame:
    """sha, long_fp of the texts above LONG bytes: chunks are hashed wherever they are dealt to and added up."""
    rows = docs.select(F.col("text").cast("string").alias("text")).where(F.octet_length("text") > LONG).mapInArrow(_chunks, _CHUNK)
    parts = rows.repartition("sha", "after", F.crc32("data")).mapInArrow(_shifted, "sha string, after long, a long, b long")
    once = parts.groupBy("sha", "after").agg(F.first("a").alias("a"), F.first("b").alias("b"))  # copies have the same chunks
    total = once.groupBy("sha").agg(*[(F.sum(F.col(c).cast("decimal(38,0)")) % F.lit(p)).cast("long").alias(c) for c, p in zip("ab", PRIMES, strict=True)])
    return total.select("sha", F.shiftleft("a", 31).bitwiseOR(F.col("b")).alias("long_fp"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: uid, doc_id, fp (62 bits of two residues), n_bytes, crc and text_sha256 of the normalised
    text, row_hash (xxhash64 of the text as it is)."""
    text = F.col("text").cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row_hash"))
    base = stash(rows.mapInArrow(_fingerprints, "uid long, doc_id long, fp long, n_bytes long, crc long, text_sha256 string, row_hash long"), "fingerprints")
    if base.where("fp is null").isEmpty():
        return base
    shas = long_fingerprints(docs)
    long = base.where("fp is null").join(shas, F.col("text_sha256") == F.col("sha")).withColumn("fp", F.col("long_fp"))
    return stash(base.where("fp is not null").unionByName(long.select(base.columns)), "fingerprints")


def _joint(crc, n_bytes):
    """One number for a CRC and a length, for the filter; of numpy arrays."""
    return crc ^ (n_bytes << 32)


_PART = "row long, fp long, n_bytes long, part int, data binary, differs boolean"


def _rows(rows):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["row", "fp", "n_bytes", "part", "data", "differs"])


def _parts(table):
    """Chunks of the texts that may be repeated, of equal ones in a batch those of the first. ``row`` is a number of the row."""

    def cut(batches):
        from pyspark import TaskContext

        bits, row = table.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            data, at = buffers.raw(batch.column(0))
            lows = [_normal(data[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
            crc, size = np.array([zlib.crc32(x) for x in lows], np.int64), np.array([len(x) for x in lows], np.int64)
            rows, held, first = [], 0, {}
            for i in np.flatnonzero(bloom.maybe(bits, _joint(crc, size))).tolist() if len(lows) else []:
                low, n = lows[i], len(lows[i])
                key = _key(*fingerprint(np.frombuffer(low, np.uint8))[:2])
                if (key, n) in first:
                    if first[key, n] != low:
                        rows.append((row + i, key, n, 0, None, True))
                    continue
                first[key, n] = low
                for part, k in enumerate(range(0, max(n, 1), CHUNK)):
                    rows.append((row + i, key, n, part, low[k : k + CHUNK], False))
                    held += CHUNK
                    if held > 8 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
            if rows:
                yield _rows(rows)
            row += len(lows)

    return cut


def _compare(batches):
    """Rows come sorted by key and chunk: each is compared with the first of its run, which alone is passed on."""
    head = None
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("row", "fp", "n_bytes", "part", "salt", "data", "differs")), strict=True):
            run = row[1:5]
            if row[6]:
                out.append((*row[:4], None, True))
            elif head is None or head[0] != run:
                head = (run, row[5])
                out.append((*row[:4], row[5], False))
            elif head[1] != row[5]:
                out.append((*row[:4], None, True))
        if out:
            yield _rows(out)


def _compared(parts: DataFrame, salts: int) -> DataFrame:
    keys = ["fp", "n_bytes", "part", "salt"]
    return parts.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts))).repartition(*keys).sortWithinPartitions(*keys).select("row", *keys, "data", "differs").mapInArrow(_compare, _PART)


def colliding(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The keys (fp, n_bytes) under which ``docs`` has texts that are not equal. ``groups``: crc, n_bytes and number n of the
    members of repeated keys."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(bloom.gather(groups.select(F.col("crc").bitwiseXOR(F.shiftleft("n_bytes", 32)).alias("key"))))
    salts = SALTS + (groups.agg(F.max("n")).first()[0] or 0) // PER_SALT
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_parts(table), _PART)
    inside = stash(_compared(parts, salts), "compared")
    found = stash(_compared(inside, 1).where("differs").select("fp", "n_bytes").distinct(), "clash")
    drop(inside)
    return found


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and row_hash for each row; the largest doc_id of equal texts stays."""
    short_batches(docs)
    base = fingerprints(docs)
    keys = ["fp", "n_bytes", "split"]
    base = base.withColumn("split", F.lit(""))
    groups = lambda rows: rows.groupBy(*keys).agg(F.max(F.struct("doc_id", "uid")).alias("top"), F.count(F.lit(1)).alias("n"), F.collect_set("crc").alias("crcs")).where("n > 1")
    # (texts that are equal have one CRC, so a set of more than one is a collision)
    repeated = stash(groups(base), "repeated")
    clash = colliding(docs, repeated.select(F.explode("crcs").alias("crc"), "n_bytes", "n"))
    if not clash.isEmpty():
        base = base.drop("split").join(clash.withColumn("clash", F.lit(True)), ["fp", "n_bytes"], "left").withColumn("split", F.when(F.col("clash"), F.col("text_sha256")).otherwise("")).drop("clash")
        repeated = groups(base)
    return base.join(repeated, keys, "left").select(
        "doc_id", F.coalesce("top.doc_id", "doc_id").alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"),
        (F.coalesce("top.uid", "uid") == F.col("uid")).alias("kept"), "text_sha256", "row_hash",
    )

