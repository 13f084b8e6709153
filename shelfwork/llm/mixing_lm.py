"""Language-model scoring by online logistic context mixing.

Texts (A-Z lower-cased) are coded byte by byte, bit by bit, with a closing byte that UTF-8 doesn't have. Bit predictors
of orders 0 to 6 look up counts of zeros and ones under their last bytes and the bits so far. Their stretched
probabilities are summed with weights that a gate picks (the longest context seen before, and how often); the weights are
learnt online, by a gradient step after each small run of coded bits, and a further table refines the result adaptively,
by what came out before where the mixture said the same. Bits add up to the text's log-probability and bits per byte.

How it is spread. What is predicted of a byte depends on the byte sequence that ends at it alone, so all work is done
once for each distinct sequence. Rows are gathered in blocks of some megabytes; a block's distinct sequences are packed
by parts: the last three context bytes are hashed by a bijection of 24 bits, and a part is a range of the hash. There are
the more parts the more text there is, and a context with more than a part's share is split by the byte before it. Spark
brings the packs of a part together and adds up counts, so a part has all that orders 3 to 6 need, whole and exact (of
a split context order 3 is added up in a second step), sequences that occur once too; orders 0 to 2 have a table of
fixed size (2 ** 24 places) that is broadcast. To score,
blocks send their sequences to the parts, get the log-probabilities back in the same order, and sum them up by text.
Words go the same way for the base score. So no table that grows with the corpus is ever in one place.

Everything is learnt from each sequence as often as it occurs, without its own occurrence (what is left out keeps rare
contexts honest). Tasks learn weights from their share, Spark averages these by the bytes they stand for, and a second
round starts from the average. In scoring, the model stands still, so a score depends on the text alone.

Defined results: null counts as empty; an empty text has its end alone; repeated rows are scored each, and count each in
training; without training rows each bit has probability 1/2; other columns don't matter. Words count by a 64-bit hash.
A text longer than a block is a block of its own, worked through in windows.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwork.llm import buffers
from shelfwork.llm.storage import drop, short_batches, stash

#: Orders 0 to ORDERS - 1, so a bit depends on ORDERS bytes.
ORDERS = 7
END = 255
#: Bytes of text in a block, and in a window of it.
BLOCK = 16 << 20
WINDOW = 1 << 21
#: A part is a range of hashed contexts (and another one of word hashes): 2 ** LEAST_BITS at least, and so many that one stands
#: for about PART_BYTES of text.
LEAST_BITS = 10
PART_BYTES = 1 << 25
#: Bytes of text, about, that contexts with more than a part's share are looked for in, and how often these must be there.
SAMPLE, SEEN = 1 << 26, 64
#: Sequences in a row of the merged table, about; a row has all sequences of its three-byte contexts.
ROW = 1 << 16
GATES = 4 * ORDERS + 1
INPUTS = ORDERS + 1
BUCKETS = 33
_U = np.uint64
_LOW24 = _U((1 << 24) - 1)
#: An odd factor for the hash of three context bytes, and its inverse modulo 2 ** 24.
_FACTOR = _U(0x9E3779)
_INVERSE = _U(pow(0x9E3779, -1, 1 << 24))


def hashed(context: np.ndarray) -> np.ndarray:
    """A bijection of 24 bits."""
    t = (context * _FACTOR) & _LOW24
    t ^= t >> _U(12)
    return (t * _FACTOR) & _LOW24


def unhashed(t: np.ndarray) -> np.ndarray:
    t = (t * _INVERSE) & _LOW24
    t = t ^ (t >> _U(12))
    return (t * _INVERSE) & _LOW24


class Stream:
    """The bytes of some texts, lower-cased, each with its closing byte, and where each text starts."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.data = np.frombuffer((b"\xff".join(texts) + b"\xff").translate(buffers.LOWER.tobytes()), np.uint8) if texts else np.zeros(0, np.uint8)

    def windows(self):
        """(first position, code of the sequence that ends at each position) of windows of the stream.

        A code has the hashed last three context bytes, then the three before them, the nearest first, then the byte.
        Before a text's start, contexts have closing bytes.
        """
        before = ORDERS - 1
        for first in range(0, len(self.data), WINDOW):
            last = min(first + WINDOW, len(self.data))
            wide = np.full(last - first + before, END, np.uint8)
            have = min(first, before)
            wide[before - have :] = self.data[first - have : last]
            context = [wide[before - k : len(wide) - k].copy() for k in range(1, before + 1)]
            a, b = np.searchsorted(self.start, [first - before, last])
            for k in range(1, before + 1):  # context byte k of a text's first k positions
                at = (self.start[a:b, None] + np.arange(k)[None]).ravel() - first
                at = at[(at >= 0) & (at < last - first)]
                context[k - 1][at] = END
            code = context[0].astype(_U)
            for c in context[1:3]:
                code <<= _U(8)
                code |= c
            code = hashed(code)
            for c in (*context[3:], wide[before:]):
                code <<= _U(8)
                code |= c
            yield first, code

    def sums(self, first: int, values: np.ndarray, out: np.ndarray) -> None:
        """Add to ``out`` the values of a window, by text."""
        a, b = np.searchsorted(self.end, first, "right"), np.searchsorted(self.start, first + len(values))
        out[a:b] += np.add.reduceat(values, np.maximum(self.start[a:b] - first, 0))


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    keys = np.sort(keys)
    if not len(keys):
        return keys
    first = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    return keys[first]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    at = np.flatnonzero(first)
    return keys[at], np.diff(np.append(at, len(keys)))


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(at) else c


def _planes(x: np.ndarray) -> bytes:
    """Compressed bytes of numbers, the lowest bytes of all first."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).data, codec="zstd", asbytes=True)


def _unplaned(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).reshape(-1).view(kind)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, packed by their differences."""
    return _planes(np.diff(keys, prepend=_U(0)))


def unpacked_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unplaned(data, n, _U), dtype=_U)


class Layout:
    """Which part a sequence or word is in. Parts of sequences are ranges of the hash of three context bytes. A context in
    ``hot`` (hashed, sorted) has 256 parts of its own instead, by the fourth byte, so that no part grows with what one
    context has: of the last seven bytes three are left to differ there. Words come behind. Which parts there are
    decides where work is done, not what comes out."""

    def __init__(self, bits: int = LEAST_BITS, hot: np.ndarray | None = None):
        self.bits, self.hot = bits, np.zeros(0, np.uint64) if hot is None else hot
        self.first_hot = 1 << bits
        self.first_word = self.first_hot + 256 * len(self.hot)

    def part(self, keys: np.ndarray, kind: int) -> np.ndarray:
        if kind:
            return (keys >> _U(64 - self.bits)).astype(np.int64) + self.first_word
        context = keys >> _U(32)
        part = (context >> _U(24 - self.bits)).astype(np.int64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            own = np.flatnonzero(self.hot[at] == context)
            part[own] = self.first_hot + 256 * at[own] + ((keys[own] >> _U(24)) & _U(255)).astype(np.int64)
        return part

    def split(self, keys: np.ndarray, kind: int):
        """(part, places of its keys) of the parts that sorted keys of a kind (0: sequences, 1: words) fall into, by part."""
        if not len(keys):
            return
        part, order = self.part(keys, kind), None
        if not kind and len(self.hot):
            order = np.argsort(part, kind="stable")
            part = part[order]
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)], strict=True):
            yield int(part[a]), slice(a, b) if order is None else order[a:b]

    def in_order(self, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Values that come by part, in the order of the sorted sequences they belong to."""
        if not len(self.hot):
            return values
        out = np.empty_like(values)
        out[np.argsort(self.part(keys, 0), kind="stable")] = values
        return out


def _contexts(batches):
    """How often each hashed context of three bytes occurs."""
    for batch in batches:
        for _, code in Stream(_texts(batch.column(0))).windows():
            context, n = counted(code >> _U(32))
            yield pa.RecordBatch.from_arrays([pa.array(context.astype(np.int64)), pa.array(n)], names=["context", "n"])


def laid_out(docs: DataFrame, part_bytes: int = PART_BYTES, sample: int = SAMPLE, seen: int = SEEN) -> Layout:
    """Parts for ``docs`` (text): their number grows with the bytes of text; which contexts have parts of their own comes from a
    sample of texts."""
    text = F.col("text").cast("string")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text) + 1), F.lit(0))).first()[0]
    bits = min(24, max(LEAST_BITS, (total // part_bytes).bit_length()))
    rate = min(1.0, sample / max(total, 1))
    some = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 40)) < int((1 << 40) * rate))
    most = max(seen, int(rate * part_bytes))
    found = some.mapInArrow(_contexts, "context long, n long").groupBy("context").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("context").collect()  # at most sample / seen rows
    return Layout(bits, np.array(sorted(r["context"] for r in found), np.uint64))


# --- counting --------------------------------------------------------------------------------------------------------


def _texts(column: pa.Array) -> list[bytes]:
    data, at = buffers.raw(column)
    return [data[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _words(texts: list[bytes]):
    """Word hashes of texts in pieces of bounded size, with the number of each text's words; a long text comes in several
    pieces, cut at spaces where it has any in reach."""
    row = 0
    while row < len(texts):
        end, size = row, 0
        while end < len(texts) and (end == row or size + len(texts[end]) <= WINDOW):
            size += len(texts[end])
            end += 1
        if end == row + 1 and size > WINDOW:
            for piece in _cut(texts[row]):
                w = buffers.Words(np.frombuffer(piece, np.uint8), np.array([0, len(piece)]))
                yield row, w.per_row, w.hash
        else:
            at = np.concatenate([[0], np.cumsum([len(t) for t in texts[row:end]])])
            w = buffers.Words(np.frombuffer(b"".join(texts[row:end]), np.uint8), at)
            yield row, w.per_row, w.hash
        row = end


def _cut(text: bytes):
    """Pieces of a long text, of whole words; a piece is about WINDOW bytes, and more where a word is longer."""
    view, at = np.frombuffer(text, np.uint8), 0
    while at < len(text):
        end = at + WINDOW
        while end < len(text):
            gap = np.flatnonzero(buffers.SPACE[view[end : end + WINDOW]])
            if len(gap):
                end += int(gap[0])
                break
            end += WINDOW
        yield text[at:end]
        at = end


def _counts_of(texts: list[bytes], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sequences (kind 0) or words (1) of texts, and their counts."""
    found = [counted(code) for _, code in Stream(texts).windows()] if kind == 0 else [counted(h) for _, _, h in _words(texts)]
    return added([k for k, _ in found], [n for _, n in found])


_COUNTS = "part int, rows int, keys binary, n binary"


def _count(batches, layout: Layout):
    """Packed counts of a partition's blocks; sequences and words of texts that aren't learnt from have count 0."""

    def emit(held):
        rows = []
        for kind in (0, 1):
            keys, n = [], []
            for learn in (True, False):
                if held[learn]:
                    k, c = _counts_of(held[learn], kind)
                    keys.append(k)
                    n.append(c if learn else np.zeros_like(c))
            if keys:
                k, c = added(keys, n)
                rows += [(part, len(own), packed_keys(own), _planes(c[at])) for part, at in layout.split(k, kind) for own in (k[at],)]
        if rows:
            yield _table(rows, _COUNTS)

    held, size = {True: [], False: []}, 0
    for batch in batches:
        learn = batch.column(0).to_pylist()
        for one, text in zip(learn, _texts(batch.column(1)), strict=True):
            if size and size + len(text) > BLOCK:
                yield from emit(held)
                held, size = {True: [], False: []}, 0
            held[one].append(text)
            size += len(text) + 1
    if size:
        yield from emit(held)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


_MERGED = "part int, rows int, keys binary, n binary, known long, total long, context long"


def _merge(batches, layout: Layout):
    """Rows come sorted by part. The sums of each part, cut where the first three context bytes change; the parts of a context
    with parts of its own are rows, with the context."""

    def emit(part, keys, n):
        k, c = added(keys, n)
        hot = layout.first_hot <= part < layout.first_word
        if hot:
            cuts = [0]
        elif part < layout.first_hot:
            head = k >> _U(32)
            starts = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
            cuts = [0]
            for s in starts[1:].tolist():
                if s - cuts[-1] >= ROW:
                    cuts.append(s)
        else:
            cuts = list(range(0, len(k), ROW))
        cuts.append(len(k))
        context = int(k[0] >> _U(32)) if hot else None
        yield _table([(part, b - a, packed_keys(k[a:b]), _planes(c[a:b]), int((c[a:b] > 0).sum()), int(c[a:b].sum()), context) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], _MERGED)

    now, keys, n, held = None, [], [], 0
    for batch in batches:
        for part, rows, k, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if part != now and keys:
                yield from emit(now, keys, n)
                keys, n, held = [], [], 0
            now = part
            keys.append(unpacked_keys(k, rows))
            n.append(_unplaned(c, rows, np.int64))
            held += rows
            if held > 4_000_000:
                one = added(keys, n)
                keys, n, held = [one[0]], [one[1]], len(one[0]) // 2
    if keys:
        yield from emit(now, keys, n)


def _by_byte(batches):
    """context, byte, n of the rows of contexts with parts of their own."""
    for batch in batches:
        for context, (keys, n) in zip(batch.column(batch.schema.get_field_index("context")).to_pylist(), _sequences(batch), strict=True):
            sums = np.bincount((keys & _U(255)).astype(np.int64), weights=n, minlength=256)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([context] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["context", "byte", "n"])


def _dense(batches):
    """The counts of a context's bytes as 256 numbers."""
    for batch in batches:
        out = []
        for pairs in batch.column(1).to_pylist():
            table = np.zeros(256, np.float32)
            for p in pairs:
                table[p["byte"]] = p["n"]
            out.append(table.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["context", "third"])


def counts(docs: DataFrame, learn: Column, layout: Layout) -> DataFrame:
    """The merged table of all sequences and words of ``docs`` (text), counted where ``learn`` holds. Where the sequences of a
    context are in several parts, each has what order 3 counts of it in ``third``."""
    rows = docs.select(F.coalesce(learn, F.lit(False)).alias("learn"), F.col("text").cast("string").alias("text"))
    raw = rows.mapInArrow(lambda b: _count(b, layout), _COUNTS)
    merged = stash(raw.repartition("part").sortWithinPartitions("part").mapInArrow(lambda b: _merge(b, layout), _MERGED), "counts")
    if not len(layout.hot):
        return merged.withColumn("third", F.lit(None).cast("binary"))
    hot = merged.where("context is not null").select("context", "rows", "keys", "n").mapInArrow(_by_byte, "context long, byte int, n double")
    sums = hot.groupBy("context", "byte").agg(F.sum("n").alias("n")).groupBy("context").agg(F.collect_list(F.struct("byte", "n")).alias("pairs"))  # 256 at most
    third = stash(sums.mapInArrow(_dense, "context long, third binary"), "order-3")
    return merged.join(third, "context", "left").select(*merged.columns, "third")


# --- the model -------------------------------------------------------------------------------------------------------


def squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -14, 14)))


def stretched(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretched probability of a one after so many zeros and ones, and how often that is (0 to 4)."""
    n = n0 + n1
    spare = np.float32(0.05) + np.float32(0.02) * n / (n + 4)
    x = np.clip(np.log((n1 + spare) / (n0 + spare)), -9, 9)
    return x, (n > 0).astype(np.int8) + (n >= 3) + (n >= 12) + (n >= 60)


def bit_counts(context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(8, 2, entries) zeros and ones that were counted at each of the eight bits, after the bits before it, for entries
    (context, byte, n) sorted by context and byte."""
    out = np.zeros((8, 2, len(n)), np.float32)
    total = np.concatenate([[0], np.cumsum(n, dtype=np.float64)])
    for k in range(8):
        node = (context << _U(8)) | (byte >> _U(8 - k)) if k else context
        first = np.concatenate([[True], node[1:] != node[:-1]])
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(n))
        group = np.cumsum(first) - 1
        ones = np.concatenate([[0], np.cumsum(n * ((byte >> _U(7 - k)) & _U(1)), dtype=np.float64)])
        n1 = ones[end] - ones[start]
        out[k, 1] = n1[group]
        out[k, 0] = (total[end] - total[start] - n1)[group]
    return out


def small_orders(cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A dense table of 2 ** 24 counts by (nearest context byte, the one before, byte)."""
    out = np.zeros(1 << 24, np.float32)
    out[cells] = n
    return out


class Model:
    """``small``: counts of order 2 (and so of 1 and 0) by nearest context byte, the one before and the byte."""

    def __init__(self, small: np.ndarray, weights: np.ndarray | None = None, refined: np.ndarray | None = None):
        self.small = small.reshape(256, 256, 256)
        self.tables = [self.small.sum(axis=(0, 1), dtype=np.float64).astype(np.float32)[None, :], self.small.sum(axis=1, dtype=np.float64).astype(np.float32)]
        if weights is None:
            weights = np.zeros((GATES, INPUTS))
            weights[:, :ORDERS] = 0.35
        self.weights = weights
        self.refined = np.zeros((256, BUCKETS, 2)) if refined is None else refined

    def _low(self, near: np.ndarray, far: np.ndarray) -> list[tuple]:
        """For orders 0 to 2: the counts of all bytes in each context that occurs, and which is whose."""
        out = []
        for table, context in ((self.tables[0], near * 0), (self.tables[1], near), (self.small.reshape(65536, 256), near * 256 + far)):
            own, where = np.unique(context, return_inverse=True)
            out.append((table[own], where))
        return out

    def inputs(self, keys: np.ndarray, n: np.ndarray, apart: bool = False, third: np.ndarray | None = None):
        """For each of the eight bits: (bit, order-0 context, inputs, gate) of sorted sequences, all those of their
        three-byte contexts; or, with the counts of the bytes of their one three-byte context in ``third``, all those of their
        four-byte contexts. With ``apart`` what occurs is left out once of the counts."""
        byte64 = keys & _U(255)
        byte = byte64.astype(np.int64)
        last = unhashed(keys >> _U(32))
        near, far = (last >> _U(16)).astype(np.int64), ((last >> _U(8)) & _U(255)).astype(np.int64)
        held = []
        key, count, where = keys, n.astype(np.float64), None
        for order in range(ORDERS - 1, 2 if third is None else 3, -1):
            if order < ORDERS - 1:
                short = ((key >> _U(16)) << _U(8)) | (key & _U(255))
                rank = np.argsort(short, kind="stable")
                short = short[rank]
                first = np.concatenate([[True], short[1:] != short[:-1]])
                at = np.flatnonzero(first)
                back = np.empty(len(rank), np.int64)
                back[rank] = np.cumsum(first) - 1
                key, count = short[at], np.add.reduceat(count[rank], at)
                where = back if where is None else back[where]
            held.append((order, where, key & _U(255), bit_counts(key >> _U(8), key & _U(255), count)))
        low = self._low(near, far)
        if third is not None:
            low.append((third[None, :], np.zeros(len(keys), np.int64)))
        for k in range(8):
            bit = (byte >> (7 - k)) & 1
            x = np.empty((len(keys), INPUTS), np.float32)
            x[:, ORDERS] = 0.3
            often = np.zeros((ORDERS, len(keys)), np.int8)
            for order, index, own, pairs in held:
                n0, n1 = pairs[k]
                if apart:
                    one = ((own >> _U(7 - k)) & _U(1)).astype(bool)
                    n0, n1 = np.maximum(n0 - ~one, 0), np.maximum(n1 - one, 0)
                value, seen = stretched(n0, n1)
                x[:, order] = value if index is None else value[index]
                often[order] = seen if index is None else seen[index]
            at = byte >> (7 - k) & ~1
            for order, (table, where) in enumerate(low):
                node = table.reshape(len(table), 2 << k, -1).sum(axis=2)  # counts below each of the nodes of this depth
                n0, n1 = node[where, at], node[where, at | 1]
                if apart:
                    n0, n1 = np.maximum(n0 - (bit == 0), 0), np.maximum(n1 - (bit == 1), 0)
                x[:, order], often[order] = stretched(n0, n1)
            gate = np.zeros(len(keys), np.int64)
            for order in range(ORDERS):
                gate = np.where(often[order] > 0, 4 * order + often[order], gate)
            yield bit, (byte >> (8 - k)) | (1 << k), x, gate

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The weighted sum, in the stretched domain."""
        return np.einsum("ij,ij->i", self.weights.astype(np.float32).take(gate, axis=0), x).astype(np.float64)

    def _bucket(self, z: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((z + 8) * 2), 0, BUCKETS - 1).astype(np.int64)

    def log10(self, keys: np.ndarray, n: np.ndarray, third: np.ndarray | None = None) -> np.ndarray:
        """log10 of the probability of each sequence's last byte after those before it: the mixture of each bit, averaged
        with what came out before where it said the same."""
        out = np.zeros(len(keys))
        for bit, node, x, gate in self.inputs(keys, n, third=third):
            z = self.mixed(x, gate)
            p = squash(z)
            seen = self.refined[node, self._bucket(z)]
            r = (seen[:, 1] + 8 * p) / (seen[:, 0] + seen[:, 1] + 8)
            p = np.clip(0.5 * p + 0.5 * r, 1e-6, 1 - 1e-6)
            out += np.log10(np.where(bit == 1, p, 1 - p))
        return out

    def learn(self, keys: np.ndarray, n: np.ndarray, rate: float, seen: np.ndarray | None = None, third: np.ndarray | None = None) -> float:
        """Online steps over the bits of small runs of sequences; ``seen`` gathers what came out, by order-0 context and
        bucket of the mixture. Returns the bytes learnt from."""
        own = np.flatnonzero(n > 0)
        own = own[np.argsort(buffers.mix(keys[own].copy()))]  # neighbours in a run aren't neighbours in the table
        mass = n.astype(np.float64)
        for bit, node, x, gate in self.inputs(keys, n, apart=True, third=third):
            for k in range(0, len(own), 1024):
                run = own[k : k + 1024]
                xr, gr, br, m = x[run], gate[run], bit[run], mass[run]
                z = self.mixed(xr, gr)
                if seen is not None:
                    cell = (node[run] * BUCKETS + self._bucket(z)) * 2 + br
                    np.add.at(seen.reshape(-1), cell, m)
                error = (br - squash(z)) * m
                step = np.stack([np.bincount(gr, weights=error * xr[:, i], minlength=GATES) for i in range(INPUTS)], axis=1)
                self.weights += rate * step / (np.bincount(gr, weights=m, minlength=GATES) + 1)[:, None]
        return float(mass[own].sum())


_TABLES: dict[str, np.ndarray] = {}


def _shared(table: np.ndarray, spark):
    """A broadcast of the table of low orders, packed: mostly zeros where texts are few."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, zlib.compress(table.tobytes(), 1)))


def _unpacked(shared) -> np.ndarray:
    name, packed = shared.value
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = np.frombuffer(zlib.decompress(packed), np.float32)
    return _TABLES[name]


def _sequences(batch: pa.RecordBatch):
    """Keys and counts of a batch's rows (part, rows, keys, n)."""
    for rows, keys, n in zip(*(batch.column(c).to_pylist() for c in ("rows", "keys", "n")), strict=True):
        yield unpacked_keys(keys, rows), _unplaned(n, rows, np.int64)


def _thirds(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    return [None if t is None else np.frombuffer(t, np.float32) for t in batch.column(batch.schema.get_field_index("third")).to_pylist()]


def _low(batches):
    """Counts of (nearest context byte, the one before, byte) of a partition's rows."""
    for batch in batches:
        for keys, n in _sequences(batch):
            cell, count = added(*([x] for x in (unhashed(keys >> _U(32)) >> _U(8) << _U(8) | (keys & _U(255)), n)))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(count.astype(np.float64))], names=["cell", "n"])


def _learned(shared, weights: np.ndarray, rate: float, observe: bool):
    """kind 0: weights times the bytes learnt from; 1: what came out; 2: the bytes."""

    def run(batches):
        model, mass = Model(_unpacked(shared), weights.copy()), 0.0
        seen = np.zeros((256, BUCKETS, 2)) if observe else None
        for batch in batches:
            for (keys, n), third in zip(_sequences(batch), _thirds(batch), strict=True):
                mass += model.learn(keys, n, rate, seen, third)
        if mass:
            flat = np.zeros(0) if seen is None else seen.ravel()
            at = np.flatnonzero(flat)
            kinds = np.concatenate([np.zeros(model.weights.size, np.int32), np.ones(len(at), np.int32), [2]]).astype(np.int32)
            cells = np.concatenate([np.arange(model.weights.size), at, [0]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(cells), pa.array(np.concatenate([model.weights.ravel() * mass, flat[at], [mass]]))], names=["kind", "cell", "v"])

    return run


def train(merged: DataFrame, layout: Layout, rounds=(0.03, 0.01)):
    """(broadcast of the table of low orders, weights, refinement) from ``counts``."""
    spark = merged.sparkSession
    grams = merged.where(F.col("part") < layout.first_word).select("rows", "keys", "n", "third")
    got = grams.mapInArrow(_low, "cell int, n double").groupBy("cell").agg(F.sum("n").cast("float").alias("n")).toArrow()  # at most 2 ** 24 rows
    table = small_orders(got["cell"].to_numpy(), got["n"].to_numpy())
    del got
    model, shared = Model(table), _shared(table, spark)
    for turn, rate in enumerate(rounds):
        last = turn == len(rounds) - 1
        # sums of numbers from all tasks, at most 17,130 rows; rounded, so that the order of adding doesn't show
        sums = grams.mapInArrow(_learned(shared, model.weights, rate, last), "kind int, cell int, v double").groupBy("kind", "cell").agg(F.sum("v").alias("v")).toArrow()
        kind, cell, v = (sums[c].to_numpy() for c in ("kind", "cell", "v"))
        if not len(kind):
            break
        weights = np.zeros(GATES * INPUTS)
        weights[cell[kind == 0]] = v[kind == 0] / v[kind == 2][0]
        model.weights = np.round(weights, 9).reshape(GATES, INPUTS)
        if last:
            model.refined.reshape(-1)[cell[kind == 1]] = v[kind == 1]
    return shared, model.weights, model.refined


# --- scoring ---------------------------------------------------------------------------------------------------------

#: kind 0: values of a part's keys; 1: a block's keys; 2: a text. ``dest`` is the part, and for texts, which only pass on
#: their way to their block, any of some numbers above all.
_ASKED = "dest long, kind int, block long, seq long, rows int, keys binary, vals binary, doc_id long, text string"
_TEXTS = 1 << 40


def _valued(shared, weights, refined, layout: Layout):
    """The merged table with log10 of the probability of each sequence, and the count of each word, as four bytes or eight."""

    def run(batches):
        model = Model(_unpacked(shared), weights, refined)
        for batch in batches:
            out = []
            for part, rows, keys, n, third in zip(*(batch.column(c).to_pylist() for c in ("part", "rows", "keys", "n")), _thirds(batch), strict=True):
                k, c = unpacked_keys(keys, rows), _unplaned(n, rows, np.int64)
                out.append((part, 0, 0, 0, rows, keys, _planes(model.log10(k, c, third).astype(np.float32) if part < layout.first_word else c), None, None))
            if out:
                yield _table(out, _ASKED)

    return run


def _ask(batches, layout: Layout):
    """Each block's texts as they are, and its distinct keys by part."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 20
    held, size, seq = [], 0, 0

    def asked():
        stream = Stream(held)
        rows = []
        for kind, keys in ((0, _all(distinct(code) for _, code in stream.windows())), (1, _all(distinct(h) for _, _, h in _words(held)))):
            rows += [(part, 1, block, part, len(own), packed_keys(own), None, None, None) for part, at in layout.split(keys, kind) for own in (keys[at],)]
        return _table(rows, _ASKED)

    for batch in batches:
        texts = _texts(batch.column(1))
        first = 0
        for i, text in enumerate(texts):
            if held and size + len(text) > BLOCK:
                if first < i:
                    yield _passed(batch, first, i, block, seq)
                yield asked()
                held, size, seq, first, block = [], 0, 0, i, block + 1
            held.append(text)
            size += len(text) + 1
        if first < len(texts):
            yield _passed(batch, first, len(texts), block, seq)
        seq += len(texts) - first
    if held:
        yield asked()


def _all(found) -> np.ndarray:
    parts = list(found)
    return distinct(np.concatenate(parts)) if parts else np.zeros(0, _U)


def _passed(batch: pa.RecordBatch, first: int, end: int, block: int, seq: int) -> pa.RecordBatch:
    n = end - first
    text = batch.column(1).slice(first, n)
    cols = {
        "dest": pa.array(_TEXTS + (block + np.arange(seq, seq + n)) % 1009), "kind": pa.array(np.full(n, 2, np.int32)), "block": pa.array(np.full(n, block)), "seq": pa.array(np.arange(seq, seq + n)),
        "rows": pa.nulls(n, pa.int32()), "keys": pa.nulls(n, pa.binary()), "vals": pa.nulls(n, pa.binary()), "doc_id": batch.column(0).slice(first, n), "text": text,
    }
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _answer(batches, layout: Layout):
    """Rows come sorted by dest and kind: a part's values, then the blocks' keys, which get theirs; texts pass."""
    now, keys, vals, ready = None, [], [], None
    for batch in batches:
        dest, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        texts = int(np.searchsorted(dest, _TEXTS))
        out = []
        own = batch.slice(0, texts)
        for i, rows, k, v, block in zip(range(texts), own.column(4).to_pylist(), own.column(5).to_pylist(), own.column(6).to_pylist(), own.column(2).to_pylist(), strict=True):
            part = int(dest[i])
            kind_of = np.float32 if part < layout.first_word else np.int64
            if part != now:
                now, keys, vals, ready = part, [], [], None
            if kind[i] == 0:
                keys.append(unpacked_keys(k, rows))
                vals.append(_unplaned(v, rows, kind_of))
                continue
            if ready is None:
                all_, value = np.concatenate(keys), np.concatenate(vals)
                order = np.argsort(all_, kind="stable")
                ready = all_[order], value[order]
                keys, vals = [], []
            asked = unpacked_keys(k, rows)
            at = np.minimum(np.searchsorted(ready[0], asked), len(ready[0]) - 1)
            if not np.array_equal(ready[0][at], asked):
                raise ValueError("a block has keys that weren't counted: the input changed between two readings")
            out.append((part, 1, block, part, rows, None, _planes(ready[1][at]), None, None))
        if out:
            yield _table(out, _ASKED)
        if texts < batch.num_rows:
            yield batch.slice(texts)


class Lookup:
    """Values of sorted keys, found by two direct places for each key and, for what lies in neither, by search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(8, len(keys).bit_length())
        self.shift = _U(64 - bits)
        self.place = []
        for factor in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):
            place = np.zeros(1 << bits, np.int32)
            place[(keys * _U(factor)) >> self.shift] = np.arange(len(keys), dtype=np.int32)
            self.place.append((_U(factor), place))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        (f, place), (g, other) = self.place
        at = place[(keys * f) >> self.shift]
        missing = np.flatnonzero(self.keys[at] != keys)
        if len(missing):
            some = keys[missing]
            found = other[(some * g) >> self.shift]
            left = np.flatnonzero(self.keys[found] != some)
            found[left] = np.searchsorted(self.keys, some[left])
            at[missing] = found
        return self.values[at]


_SCORED = "doc_id long, n_bytes long, score double, n_words long, known long, total double"


def _score(batches, layout: Layout):
    """Rows come sorted by block and kind: values in the order of parts, then the block's texts in their order."""

    def done(values, ids, texts):
        if not texts:
            return None
        stream = Stream(texts)
        score, words = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        keys = _all(distinct(code) for _, code in stream.windows())
        look = Lookup(keys, layout.in_order(keys, np.concatenate(values[0])))
        for first, code in stream.windows():
            stream.sums(first, look(code).astype(np.float64), score)
        known, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        keys = _all(distinct(h) for _, _, h in _words(texts))
        if len(keys):
            look = Lookup(keys, np.concatenate(values[1]))
            for row, per, h in _words(texts):
                n = look(h)
                own = slice(row, row + len(per))
                words[own] += per
                known[own] += buffers.sums((n > 0).astype(np.int64), per)
                total[own] += buffers.sums(np.log10(n + 1.0), per)
        cols = [pa.array(ids, pa.int64()), pa.array(stream.end - stream.start), pa.array(score), pa.array(words), pa.array(known), pa.array(total)]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _SCORED.split(", ")])

    now, values, ids, texts = None, ([], []), [], []
    for batch in batches:
        blocks, kinds = batch.column(2).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])])).tolist()
        for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
            if blocks[a] != now:
                if (got := done(values, ids, texts)) is not None:
                    yield got
                now, values, ids, texts = blocks[a], ([], []), [], []
            own = batch.slice(a, b - a)
            if kinds[a] == 1:
                for part, rows, v in zip(*(own.column(i).to_pylist() for i in (3, 4, 6)), strict=True):
                    values[part >= layout.first_word].append(_unplaned(v, rows, np.float32 if part < layout.first_word else np.int64))
            else:
                ids += own.column(7).to_pylist()
                texts += _texts(own.column(8))
    if (got := done(values, ids, texts)) is not None:
        yield got


def score(docs: DataFrame, learn: Column, layout: Layout | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes (coded ones: the text's and its end), bits_per_byte
    of every row of ``docs`` (doc_id, text), by the texts of those rows for which ``learn`` holds."""
    short_batches(docs)
    layout = layout or laid_out(docs)
    merged = counts(docs, learn, layout)
    shared, weights, refined = train(merged, layout)
    ends = docs.where(learn).count()
    stats = merged.where(F.col("part") >= layout.first_word).agg(F.coalesce(F.sum("known"), F.lit(0)).alias("v"), F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()
    tokens, kinds = stats["n"] + ends, stats["v"] + (ends > 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = rows.mapInArrow(lambda b: _ask(b, layout), _ASKED).unionByName(merged.mapInArrow(_valued(shared, weights, refined, layout), _ASKED))
    answered = asked.repartition("dest").sortWithinPartitions("dest", "kind").mapInArrow(lambda b: _answer(b, layout), _ASKED)
    # blocks of the same and of neighbouring input partitions go to different ones, evenly
    spread = (F.shiftright("block", 20) + F.col("block").bitwiseAND((1 << 20) - 1)).cast("int")
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    out = answered.repartitionById(partitions, spread).sortWithinPartitions("block", "kind", "seq").mapInArrow(lambda b: _score(b, layout), _SCORED)
    floor = float(np.log10(tokens + kinds + 1))
    base = F.col("total") + F.lit(float(np.log10(ends + 1.0))) - (F.col("n_words") + 1) * F.lit(floor)
    return out.select(
        "doc_id", (F.col("n_words") + 1).alias("n_tokens"), (F.col("known") + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score", "n_bytes", (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
