"""Toxicity by class-conditional Kneser-Ney models.

A toxic and an ordinary bigram model are compared by the difference of their log-likelihoods, normalised by length. Both
discount their own counts and back off to unigrams of their class and from these to one shared distribution: the
number of different words that a word follows in either class. So an expression that is rare in both classes gets
about the same probability from both. Many languages make words of one stem, most of which a sample lacks: that shared
distribution is therefore weighed, for each class, by how often words of the class start like the word, as far as such
starts (of the lengths STARTS, in bytes) were seen; the longer start is smoothed by the shorter one.

Words of little evidence would drown the few that count in a long text, so differences below a margin are kept apart
from clear ones, and a logistic regression weighs both. It is fitted on a quarter of the labelled rows, chosen by hash,
that the counts leave out. Labelled rows are a bounded sample, by hash: ``cap`` toxic and as many ordinary ones, and of
each about ``text_bytes`` bytes of text, so the table has a bound whatever the length of texts; counting is done in
Spark. All words and pairs of the sample are in the model, those seen once too. Texts are counted and scored whole. Words
and pairs are told apart by 64-bit hashes.

Words are runs of letters, digits and non-ASCII bytes, lower-cased.

Defined results: null, empty and wordless texts get the score of a difference of 0; repeated rows are scored each;
without rows of both classes all scores are the share of toxic rows (0 with no labels); other columns don't matter.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwork.llm import buffers
from shelfwork.llm.storage import sampled, short_batches, stash

DISCOUNT = 0.75
#: Differences up to this many nats are taken for noise of estimation.
MARGIN = 1.0
_PAIR = np.uint64(0xD1342543DE82EF95)
_EDGE = np.uint64(0x5851F42D4C957F2D)
#: Lengths of the starts of words, in bytes; a shorter word is its own start. What a start's share is smoothed by counts as SMOOTH words.
STARTS, SMOOTH = (4, 5, 6), 2.0


def expressions(data: np.ndarray, offsets: np.ndarray):
    """(word hashes, hashes of each word with the one before, hash of the one before, words per row)."""
    return _expressions(buffers.Words(data, offsets, apart=buffers.NOT_ALNUM))


def starts(words: buffers.Words) -> list[np.ndarray]:
    """Hashes of each word's starts, by STARTS."""
    out, total = [], np.zeros(len(words.start), np.uint64)
    factor = buffers.factors(max(STARTS))
    for k in range(max(STARTS)):
        own = np.flatnonzero(words.length > k)
        total[own] += buffers.BYTE_VALUE[words.lower[words.start[own] + k]] * factor[k]
        if k + 1 in STARTS:
            out.append(buffers.mix(total + np.uint64(k + 1) * _PAIR))
    return out


def _expressions(words: buffers.Words):
    h = words.hash
    before = np.empty_like(h)
    if len(h):
        before[1:] = h[:-1]
        before[np.cumsum(words.per_row)[words.per_row > 0] - words.per_row[words.per_row > 0]] = _EDGE
    return h, buffers.mix(before * _PAIR + h), before, words.per_row


def _counted(batches):
    """(order, key, before, word, toxic, ordinary) for each distinct word (order 1), pair (2) and start (its length) of a batch; what comes
    before a word is its longest start, before a start the next shorter one."""
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False)
        for first, end, data, at in buffers.blocks(batch.column(1), 1 << 22):
            words = buffers.Words(data, at, apart=buffers.NOT_ALNUM)
            (h, pair, before, per), begin = _expressions(words), starts(words)
            label = np.repeat(toxic[first:end], per).astype(np.int64)
            for order, key, prior in ((1, h, begin[-1]), (2, pair, before), *zip(STARTS, begin, [np.zeros_like(h), *begin[:-1]], strict=True)):
                distinct, index, where = np.unique(key, return_index=True, return_inverse=True)
                n = np.bincount(where, minlength=len(distinct))
                t = np.bincount(where, weights=label, minlength=len(distinct)).astype(np.int64)
                cols = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in (distinct, prior[index], h[index], t, n - t)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), order, np.int32)), *cols], names=["order", "key", "before", "word", "toxic", "ordinary"])


_MODELS: dict[str, Model] = {}


class Model:
    """Words, pairs and starts, sorted by hash, with their probabilities in both classes, and the calibration.

    ``start`` says for the first bits of a hash where its entries begin: about one entry for each value of them.
    """

    def __init__(self):
        self.put(np.zeros(0, np.uint64), np.zeros((0, 2), np.float32))
        self.unseen = np.ones(2)
        self.offset = 0.0
        self.weights = np.array([4.0, -1.0, 1.0, -2.0])

    def packed(self) -> tuple:
        """What goes to the workers, without the calibration."""
        return uuid.uuid4().hex, self.key.tobytes(), zlib.compress(self.value.tobytes(), 1), self.unseen, self.offset

    @staticmethod
    def unpacked(packed: tuple, weights: np.ndarray) -> Model:
        """A worker unpacks a model once."""
        name = packed[0]
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = model = Model.__new__(Model)
            model.put(np.frombuffer(packed[1], np.uint64), np.frombuffer(zlib.decompress(packed[2]), np.float32).reshape(-1, 2))
            model.unseen, model.offset = packed[3], packed[4]
        model = _MODELS[name]
        model.weights = weights
        return model

    def put(self, key: np.ndarray, value: np.ndarray) -> None:
        """All entries, by ascending key."""
        self.key, self.value = key, value
        bits = max(1, len(key).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((key >> self.shift).astype(np.int64), minlength=1 << bits), out=self.start[1:])

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is an entry, its value, or 0): keys go on along the entries of their first bits until met or passed."""
        top = (key >> self.shift).astype(np.int64)
        at, end = self.start[top].astype(np.int64), self.start[top + 1]
        known, value = np.zeros(len(key), bool), np.zeros((len(key), 2), np.float32)
        left = np.flatnonzero(at < end)
        while len(left):
            found = self.key[at[left]]
            met = found == key[left]
            known[left[met]] = True
            value[left[met]] = self.value[at[left[met]]]
            left = left[found < key[left]]
            at[left] += 1
            left = left[at[left] < end[left]]
        return known, value

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each row the sums of log P(toxic) - log P(ordinary) above MARGIN, below -MARGIN and in all, and its words."""
        words = buffers.Words(data, offsets, apart=buffers.NOT_ALNUM)
        h, pair, before, per = _expressions(words)
        known1, uni = self.get(h)
        new = np.flatnonzero(~known1)
        uni[new] = self.unseen
        begin = starts(words)
        for k in range(len(STARTS) - 1, -1, -1):  # the longest start that is known
            known, weight = self.get(begin[k][new])
            uni[new[known]] *= weight[known]
            new = new[~known]
        known2, p2 = self.get(pair)
        seen, back = self.get(before ^ _EDGE)
        both = np.where((known2 & seen)[:, None], p2, 0) + np.where(seen[:, None], back, 1.0) * uni
        d = np.log(both[:, 0]) - np.log(both[:, 1]) - self.offset
        parts = [buffers.sums(x, per, np.float64) for x in (np.maximum(d - MARGIN, 0), np.maximum(-d - MARGIN, 0), d)]
        return np.stack([*parts, per.astype(np.float64)], axis=1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = design(evidence) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def design(evidence: np.ndarray) -> np.ndarray:
    """Length-normalised evidence: clear evidence by the root of the length (its noise grows like that), all of it by length."""
    n = np.maximum(evidence[:, 3], 1)
    root = np.sqrt(n)
    return np.stack([np.log1p(evidence[:, 0] / root), np.log1p(evidence[:, 1] / root), np.clip(evidence[:, 2] / n, -2, 2), np.ones(len(n))], axis=1)


def _weights(begin: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, by key, the weights in both classes) of starts: key, before, toxic, ordinary of each length, shorter ones first. A weight
    is the class's share of the start against what it would be were classes alike."""
    keys, share = np.zeros(0, np.uint64), np.zeros(0)
    all_keys, all_shares = [], []
    for rows in begin:
        prior = np.full(len(rows["key"]), 0.5)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, rows["before"]), len(keys) - 1)
            prior = np.where(keys[at] == rows["before"], share[at], 0.5)
        toxic, ordinary = (rows[c] / max(1, rows[c].sum()) for c in ("toxic", "ordinary"))
        size = (rows["toxic"].sum() + rows["ordinary"].sum()) / 2
        found = (toxic * size + SMOOTH * prior) / ((toxic + ordinary) * size + SMOOTH)
        rank = np.argsort(rows["key"])
        keys, share = rows["key"][rank], found[rank]
        all_keys.append(keys)
        all_shares.append(share)
    keys, share = np.concatenate(all_keys), np.concatenate(all_shares)
    rank = np.argsort(keys)
    share = np.clip(share[rank], 1e-4, 1 - 1e-4)
    return keys[rank], np.stack([2 * share, 2 * (1 - share)], axis=1).astype(np.float32)


def build(words: dict, pairs: dict, begin: list[dict] = ()) -> Model:
    """Kneser-Ney estimates. words: key, follows, toxic, ordinary and, with starts, before; pairs: key, before, toxic, ordinary; begin: the
    same of the starts of each length."""
    model, classes = Model(), ("toxic", "ordinary")
    rank = np.argsort(words["key"])
    words = {k: v[rank] for k, v in words.items()}
    c1 = np.stack([words[c] for c in classes], axis=1).astype(np.float64)
    total = np.maximum(c1.sum(axis=0), 1)
    # shared backoff: how many different words come before a word, in either class
    kinds = words["follows"].sum() + len(c1) + 1
    own1 = np.maximum(c1 - DISCOUNT, 0) / total
    left = np.maximum(1 - own1.sum(axis=0), 1e-6)
    shared = left * ((words["follows"] + 1) / kinds)[:, None]
    start_keys, weights = _weights(begin) if len(begin) else (np.zeros(0, np.uint64), np.zeros((0, 2), np.float32))
    if len(start_keys):
        at = np.minimum(np.searchsorted(start_keys, words["before"]), len(start_keys) - 1)
        shared = np.where((start_keys[at] == words["before"])[:, None], shared * weights[at], shared)
    uni = (own1 + shared).astype(np.float32)
    model.unseen, model.offset = left / kinds, float(np.log(left[0] / left[1]))
    # a word's own continuations; what they leave goes to the unigrams. Pairs are many: no wide arrays of them
    at = np.minimum(np.searchsorted(words["key"], pairs["before"]), max(len(c1) - 1, 0)).astype(np.int32)
    known = np.flatnonzero(words["key"][at] == pairs["before"]) if len(c1) else np.zeros(0, np.int64)
    at = at[known]
    own2, spent = np.empty((len(known), 2), np.float32), np.zeros((len(c1), 2))
    for k, c in enumerate(classes):
        own2[:, k] = np.minimum(np.maximum(pairs[c][known].astype(np.float32) - np.float32(DISCOUNT), 0) / np.maximum(c1[:, k], 1).astype(np.float32)[at], 1)
        spent[:, k] = np.bincount(at, weights=own2[:, k], minlength=len(c1))
    heads = np.flatnonzero(spent.sum(axis=1) > 0)
    back = np.clip(1 - spent[heads], 0.01, 1).astype(np.float32)
    keys = np.concatenate([pairs["key"][known], words["key"][heads] ^ _EDGE, words["key"], start_keys])
    del at, known, spent
    value = np.concatenate([own2, back, uni, weights])
    del own2
    rank = np.argsort(keys)
    model.put(keys[rank], value[rank])
    return model


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression with 0.3 of the weight on toxic rows, by Newton's method."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.3 / max((y == 1).mean(), 1e-9), 0.7 / max((y == 0).mean(), 1e-9))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


#: Bytes of labelled text of a class that are learnt from, about. A word gives two entries of 16 bytes at most, and three for its starts.
TEXT_BYTES = 32 << 20


def train(docs: DataFrame, labels: DataFrame, cap: int = 4000, text_bytes: int = TEXT_BYTES) -> tuple[tuple | None, float]:
    """((broadcast of the model, calibration), share of toxic rows) from ``docs`` (doc_id, text) of the training fold and ``labels`` (doc_id, toxic)."""
    short_batches(docs)
    known = labels.where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = stash(known.join(texts.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")), "doc_id"), "known")
    sizes = {r["toxic"]: (r["n"], r["bytes"]) for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()}
    seen = {k: n for k, (n, _) in sizes.items()}
    share = seen.get(1, 0) / max(1, sum(seen.values()))
    if not seen.get(1) or not seen.get(0):
        return None, share
    rows_of = lambda k: min(cap, max(1, int(sizes[k][0] * text_bytes / max(1, sizes[k][1]))))
    one, other = (sampled(known.where(F.col("toxic") == k), "doc_id", seen[k], rows_of(k)).select("doc_id", "toxic") for k in (1, 0))
    chosen = one.unionByName(other)
    chosen = stash(chosen, "chosen")
    if chosen.count() <= 4 * cap:  # ``cap`` of each class, give or take what a hash does; texts stay where they are
        chosen = F.broadcast(chosen)
    rows = stash(chosen.join(texts, "doc_id").withColumn("apart", F.pmod(F.xxhash64("text", F.lit(9)), F.lit(4)) == 0), "labelled")
    counts = rows.where("not apart").select("toxic", "text").mapInArrow(_counted, "order int, key long, before long, word long, toxic long, ordinary long")
    counts = stash(counts.groupBy("order", "key").agg(F.min("before").alias("before"), F.min("word").alias("word"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "expressions")
    follows = counts.where("order = 2").groupBy(F.col("word").alias("key")).agg(F.count(F.lit(1)).alias("follows"))
    words = counts.where("order = 1").select("key", "before", "toxic", "ordinary").join(follows, "key", "left").withColumn("follows", F.coalesce("follows", F.lit(0)))
    pairs = counts.where("order = 2").select("key", "before", "toxic", "ordinary")
    begin = [_columns(counts.where(F.col("order") == k).select("key", "before", "toxic", "ordinary")) for k in STARTS]
    model = build(_columns(words), _columns(pairs), begin)
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())
    apart = _evidence(rows.where("apart").select(F.col("toxic").cast("long").alias("doc_id"), "text"), shared, model.weights).toArrow()
    y = apart["doc_id"].to_numpy()
    if (y == 0).any() and (y == 1).any():
        model.weights = calibrate(design(np.stack([apart[c].to_numpy() for c in ("above", "below", "total", "n")], axis=1)), y)
    return (shared, model.weights), share


def _columns(rows: DataFrame) -> dict:
    """Hashes and counts at the driver, counts in four bytes."""
    got = rows.select([F.col(c) if c in ("key", "before") else F.col(c).cast("int") for c in rows.columns]).toArrow()
    return {c: got[c].to_numpy().view(np.uint64) if c in ("key", "before") else got[c].to_numpy() for c in rows.columns}


def _evidence(rows: DataFrame, shared, weights: np.ndarray) -> DataFrame:
    def run(batches):
        own = Model.unpacked(shared.value, weights)
        for batch in batches:
            for first, end, data, at in buffers.blocks(batch.column(1)):
                e = own.evidence(data, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *(pa.array(e[:, k]) for k in range(4)), pa.array(own.score(e))], names=["doc_id", "above", "below", "total", "n", "score"])

    return rows.mapInArrow(run, "doc_id long, above double, below double, total double, n double, score double")


def score(docs: DataFrame, model: tuple | None, share: float) -> DataFrame:
    """doc_id, score of every row, from its whole text."""
    short_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(share).alias("score"))
    return _evidence(rows, *model).select("doc_id", "score")
