"""Bound-certified best-fit packing of tokenised documents into sequences.

Documents become token ids with a closing 0; only those longer than a sequence are cut. Pieces that fill a sequence are
sequences of their own. The others are dealt to partitions, each packed by best-fit decreasing. A lower bound from
dual-feasible functions certifies a partition when it equals the number of its bins. Partitions with a gap keep their
full bins and put the pieces of all others in common; these are dealt anew to fewer and larger partitions and packed
again, until all are certified, one partition is left, or ROUNDS are over; an exchange that gains nothing is undone.

Defined results: null text is empty and gives one piece of one id; repeated rows are packed each; among pieces of one
length those of earlier rows go first, among bins with the same room the one opened or filled last; an empty table gives
an empty result; other columns don't matter. Numbers of sequences are unique but not consecutive.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwork.llm import buffers
from shelfwork.llm.storage import drop, short_batches, stash

CAPACITY = 2048
#: Pieces dealt to a partition; so many are packed in one task's memory, as numbers only.
PER_PARTITION = 20_000
#: Packings of what is still open; each deals twice as many pieces to a partition as the one before.
ROUNDS = 5
#: A worker remembers the ids of words in 2 ** MEMORY_BITS places, and so many ids; beyond, the memory starts anew.
MEMORY_BITS = 20
MEMORY_IDS = 4_000_000
#: Words encoded at once: an encoding is large beside its ids.
ENCODED = 8192

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Ids of words by a tokenizer whose splitter never joins characters across white space and drops it: a text's ids
    are those of its words. Where the tokenizer lower-cases and splits ASCII letters and digits from ASCII marks (but the
    apostrophe), which is tried out on all of them, words are cut there and lower-cased first, so there are fewer different ones.
    A word's ids are remembered in the place that its hash gives, until another word takes it; a remembered word is known
    by all 64 bits of its hash."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fold, self.kinds = self._tried()
        #: Texts that stand for an id of their own, as they are written.
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def _tried(self) -> tuple[bool, np.ndarray | None]:
        """(whether A-Z and a-z have the same ids, kinds of bytes that words are cut between)."""
        letters, marks = [chr(c) for c in range(128) if chr(c).isalnum()], [chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 39]
        one = {c: e.ids for c, e in zip(letters + marks, self.tokenizer.encode_batch_fast(letters + marks, add_special_tokens=False), strict=True)}
        pairs = [x + y for a in letters for m in marks for x, y in ((a, m), (m, a))]
        apart = all(e.ids == one[p[0]] + one[p[1]] for p, e in zip(pairs, self.tokenizer.encode_batch_fast(pairs, add_special_tokens=False), strict=True))
        fold = all(one[c] == one[c.lower()] for c in letters)
        kinds = np.zeros(256, np.uint8)
        kinds[[ord(c) for c in letters]], kinds[[ord(c) for c in marks]] = 1, 2
        return fold, kinds if apart else None

    def clear(self) -> None:
        self.tag = np.zeros(1 << MEMORY_BITS, np.uint64)
        self.at = np.zeros(1 << MEMORY_BITS, np.int32)
        self.size = np.zeros(1 << MEMORY_BITS, np.int32)
        self.ids = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.used = 0

    def _add(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes, ids = [], []
        for k in range(0, len(texts), ENCODED):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts[k : k + ENCODED], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter((i for x in got for i in x), self.ids.dtype, int(sizes[-1].sum())))
        size, flat = np.concatenate(sizes), np.concatenate(ids)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        return at, size

    def _marked(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The texts that hold an added token."""
        whole, at = data.tobytes(), []
        for token in self.special:
            k = whole.find(token)
            while k >= 0:
                at.append(k)
                k = whole.find(token, k + 1)
        return np.unique(np.searchsorted(offsets, at, side="right") - 1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by 0; how many each text has). Words of a text with an added token are cut at
        white space only and given to the tokenizer as they are, since it looks for such tokens first."""
        marked = self._marked(data, offsets)
        if not len(marked):
            return self._encode(data, offsets, self.fold, self.kinds)
        edges = np.unique(np.concatenate([[0], marked, marked + 1, [len(offsets) - 1]]))
        parts = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = (False, None) if a in marked else (self.fold, self.kinds)
            parts.append(self._encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], *own))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode(self, data: np.ndarray, offsets: np.ndarray, fold: bool, kinds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if self.used > MEMORY_IDS:
            self.clear()
        words = buffers.Words(data, offsets, fold=fold, kinds=kinds)
        h, n = words.hash, len(words.per_row)
        slot = (h >> np.uint64(64 - MEMORY_BITS)).astype(np.int64)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        missing = np.flatnonzero(self.tag[slot] != h)
        if len(missing):
            fresh, first, where = np.unique(h[missing], return_index=True, return_inverse=True)
            own = missing[first]
            body = words.lower.tobytes()
            texts = [body[s : s + k].decode("utf-8", "replace") for s, k in zip(words.start[own].tolist(), words.length[own].tolist(), strict=True)]
            new_at, new_size = self._add(texts)
            at[missing], size[missing] = new_at[where], new_size[where]
            self.tag[slot[own]], self.at[slot[own]], self.size[slot[own]] = fresh, new_at, new_size
        total = buffers.sums(size, words.per_row) + 1
        row = np.repeat(np.arange(n), words.per_row)
        # a text's ids follow those of the texts before, each of which has one closing id more than its words give
        put = np.cumsum(size) - size + row
        out = np.zeros(int(total.sum()), np.uint32)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(put, size) + step] = self.ids[np.repeat(at, size) + step]
        return out, total


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _pieces(path: str, capacity: int):
    def cut(batches):
        tokens = encoder(path)
        for batch in batches:
            uid, ids = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for first, _, data, at in buffers.blocks(batch.column(2)):
                flat, total = tokens.encode(data, at)
                begin = np.cumsum(total) - total
                count = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, total[row] - start)
                view = memoryview(flat.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip((begin[row] + start).tolist(), length.tolist(), strict=True)]
                cols = [pa.array(uid[first + row]), pa.array([ids[first + r] for r in row.tolist()], pa.int64()), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32 of every document."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, capacity), "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each piece by best-fit decreasing. Bins wait by what is left in them; an integer's bits say which of the
    remainders have bins, so the tightest fit is found by arithmetic on it."""
    order = np.argsort(-lengths, kind="stable")
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    has, made = 0, 0
    out = np.empty(len(lengths), np.int64)
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = has >> n
        if fit:
            left = n + (fit & -fit).bit_length() - 1
            b = waiting[left].pop()
            if not waiting[left]:
                has ^= 1 << left
            left -= n
        else:
            b, left = made, capacity - n
            made += 1
        out[i] = b
        if left:
            if not waiting[left]:
                has |= 1 << left
            waiting[left].append(b)
    return out


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of two families of dual-feasible functions: no packing has fewer bins.

    One maps sizes above capacity - k to the whole, below k to nothing and leaves the others; the other one rounds
    (p + 1) * size / capacity down to whole parts of 1 / p, where that isn't whole itself.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(count * size)])
    n = np.concatenate([[0], np.cumsum(count)])
    k = np.arange(0, capacity // 2 + 1)
    large = n[-1] - n[capacity - k + 1]
    middle = total[capacity - k + 1] - total[k]
    best = int(np.max(large + -(-middle // capacity)))
    for p in range(1, 41):
        scaled = (p + 1) * size
        whole = scaled % capacity == 0
        part = np.where(whole, size * p, scaled // capacity * capacity)  # in units of 1 / (p * capacity)
        best = max(best, int(-(-int((count * part).sum()) // (p * capacity))))
    return best


_PACKED = "uid long, piece int, length long, bin long, offset long, closed boolean, gap long"


def _pack(round_no: int, capacity: int):
    """Rows come sorted by part: the numbers of one part are held at a time, PER_PARTITION pieces in the first round."""

    def packed(part: int, held: list) -> pa.RecordBatch:
        own = pa.Table.from_batches(held).sort_by([("length", "descending"), ("uid", "ascending"), ("piece", "ascending")])
        lengths = own["length"].to_numpy()
        bins = best_fit(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        b, n = bins[order], lengths[order]
        upto = np.cumsum(n) - n
        first = np.searchsorted(b, np.arange(b[-1] + 1))
        filled = np.add.reduceat(n, first)
        gap = int(b[-1] + 1 - lower_bound(lengths, capacity))
        closed = (filled == capacity)[b] | (gap == 0)
        code = (np.int64(round_no) << 56) + (np.int64(part) << 28) + b
        return pa.RecordBatch.from_arrays(
            [pa.array(own["uid"].to_numpy()[order]), pa.array(own["piece"].to_numpy()[order]), pa.array(n), pa.array(code), pa.array(upto - upto[first][b]), pa.array(closed), pa.array(np.full(len(b), gap))],
            names=["uid", "piece", "length", "bin", "offset", "closed", "gap"],
        )

    def run(batches):
        now, held = None, []
        for batch in batches:
            part = batch.column(3).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() if len(part) else []
            for a, b in zip(edges, [*edges[1:], len(part)], strict=False):
                if part[a] != now and held:
                    yield packed(now, held)
                    held = []
                now = int(part[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield packed(now, held)

    return run


def _packed(open_pieces: DataFrame, partitions: int, round_no: int, capacity: int) -> DataFrame:
    part = F.pmod(F.xxhash64("uid", "piece", F.lit(round_no)), F.lit(partitions)).cast("int")
    rows = open_pieces.select("uid", "piece", "length", part.alias("part")).repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(_pack(round_no, capacity), _PACKED)


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> DataFrame:
    """uid, piece, sequence_id, offset, gap of ``items`` (uid, piece, length up to ``capacity``, each pair once). ``gap``: by how
    many bins the packing of its part is above the lower bound; 0 is a certificate that none can do with fewer."""
    full = items.where(F.col("length") == capacity).select("uid", "piece", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("gap"))
    rest = items.where(F.col("length") < capacity).select("uid", "piece", "length")
    done, last, bins = full, None, 0
    place = lambda rows: rows.select("uid", "piece", F.col("bin").alias("sequence_id"), "offset", "gap")
    for round_no in range(ROUNDS):
        n = rest.count()
        if not n:
            return done
        partitions = max(1, -(-n // (per_partition << round_no)))
        packed = stash(_packed(rest, partitions, round_no, capacity), "packed")
        if last is not None and packed.select("bin").distinct().count() >= bins:
            drop(packed)  # this deal gained nothing: the packing before it stays, and a larger deal is tried
            if partitions == 1:
                break
            continue
        done = done.unionByName(place(packed.where("closed")))
        last = packed.where("not closed")
        bins = last.select("bin").distinct().count()
        if partitions == 1:
            break
        rest = last.select("uid", "piece", "length")
    return done if last is None else done.unionByName(place(last))


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap for every piece of every document."""
    short_batches(docs)
    items = stash(pieces(docs, tokenizer, capacity), "pieces")
    placed = pack(items, capacity, per_partition)
    return items.join(placed, ["uid", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap")
