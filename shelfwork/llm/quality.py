"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text train a small network by the non-negative unbiased risk
``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))`` with the logistic loss, so its output is a
probability of good quality. When the bracket turns negative, its gradient is followed upwards instead.

The class prior is estimated from positives and unlabelled text alone, no row labelled bad is looked at: a classifier of
positives against unlabelled rows is fitted on a part of both; on the rest, the share of unlabelled rows above a score over
that of positives above it bounds the prior from above at every score, and is nearest to it at the top, where hardly
any bad row is left. The score is taken at which the bound, widened for what is left to chance, is least.

A text is described by shares of byte classes, shares of pairs of byte classes, and figures of repetition; lexical
content plays no part, so the description has a fixed size for any language.

Fitting takes bounded samples chosen by hash, ``positives`` trusted rows and ``unlabelled`` others (None: all that there are,
at the driver, some 1.2 KB each); all texts are scored whole.

Defined results: null and empty texts are scored like any other, from zeros; repeated rows are scored each; without a
positive row all scores are 0.5; rows of equal texts get equal scores; a document labelled both ways counts as good;
other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwork.llm import buffers
from shelfwork.llm.storage import sampled, short_batches

#: Byte classes: 0 white space, 1 line break, 2 lower case, 3 upper case, 4 digit, 5 other characters, 6 sentence marks, then single marks.
CLASS = np.full(256, 15, np.uint8)
CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0
CLASS[0x0A] = 1
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 2, 3, 4, 5
for _k, _marks in enumerate(("," ".", "'\"-", "!?", ":;", "|", "*#", "$%&@", "<>/\\", "()[]{}"), 6):
    CLASS[[ord(c) for c in _marks]] = _k
CLASSES = 16
FEATURES = CLASSES * CLASSES + CLASSES + 8


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, FEATURES) float32 of a block of texts."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    single, double = np.zeros(n * CLASSES, np.int64), np.zeros(n * CLASSES * CLASSES, np.int64)
    for at in range(0, len(data), buffers.BLOCK):  # of a long text some megabytes at a time, each with the byte before
        low, end = max(at - 1, 0), min(at + buffers.BLOCK, len(data))
        row = np.searchsorted(offsets, np.arange(low, end), side="right") - 1 if n > 1 else np.zeros(end - low, np.int64)
        c = CLASS[data[low:end]].astype(np.int64)
        single += np.bincount((row * CLASSES + c)[at - low :], minlength=len(single))
        inside = row[1:] == row[:-1]
        double += np.bincount((row[1:] * CLASSES * CLASSES + c[:-1] * CLASSES + c[1:])[inside], minlength=len(double))
    single, double = single.reshape(n, CLASSES), double.reshape(n, CLASSES * CLASSES)
    words = buffers.Words(data, offsets)
    per = words.per_row
    own = np.repeat(np.arange(n), per)
    some = np.maximum(per, 1)
    same = np.zeros(len(own), bool)
    if len(own):
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (own[1:] == own[:-1])
    distinct = _distinct(words.hash, own, n)
    runs, run_per = buffers.shingles(words, 3)
    distinct_runs = _distinct(runs, np.repeat(np.arange(n), run_per), n)
    last = CLASS[words.lower[words.start + words.length - 1]] if len(own) else np.zeros(0, np.uint8)
    share = lambda mask: np.bincount(own, weights=mask, minlength=n) / some
    more = np.stack([
        np.log1p(lengths), np.log1p(per), distinct / some, distinct_runs / np.maximum(run_per, 1), share(same),
        share(last >= 6), share(last >= 8), np.minimum(lengths / some, 40) / 10,
    ], axis=1)
    size = np.maximum(lengths, 1)[:, None]
    return np.concatenate([np.sqrt(single / size), np.sqrt(double / size), more], axis=1).astype(np.float32)


def _distinct(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Distinct values in each row, up to collisions of 40 bits inside a block."""
    if not len(hashes):
        return np.zeros(n, np.int64)
    key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return np.bincount((key[first] >> np.uint64(40)).astype(np.int64), minlength=n)


def _described(batches):
    for batch in batches:
        for first, end, data, at in buffers.blocks(batch.column(1)):
            f = features(data, at)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array([x.tobytes() for x in f], pa.binary())], names=["kind", "f"])


class Network:
    """One hidden layer over standardised features."""

    def __init__(self, size: int, hidden: int = 24, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(size), np.ones(size)
        self.p = [rng.normal(0, size**-0.5, (size, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def gradient(self, x, h, d) -> list[np.ndarray]:
        """Of the sum over rows of d * output."""
        back = d[:, None] * self.p[2][None] * (1 - h * h)
        return [x.T @ back, back.sum(axis=0), h.T @ d, np.array([d.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.forward(self.standard(x.astype(np.float64)))[1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 900, batch: int = 256, rate: float = 4e-3, decay: float = 1e-3, seed: int = 5) -> Network:
    """Minimise the non-negative unbiased risk by Adam; without a prior, the logistic loss of positives against unlabelled."""
    net = Network(unlabelled.shape[1])
    net.mean, net.scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 0.02
    xp, xu = net.standard(positive.astype(np.float64)), net.standard(unlabelled.astype(np.float64))
    rng = np.random.default_rng(seed)
    m, v = [np.zeros_like(q) for q in net.p], [np.zeros_like(q) for q in net.p]
    for step in range(1, steps + 1):
        a, b = xp[rng.integers(0, len(xp), batch)], xu[rng.integers(0, len(xu), 2 * batch)]
        ha, za = net.forward(a)
        hb, zb = net.forward(b)
        da, db = slopes(za, zb, prior)
        g = [x + y for x, y in zip(net.gradient(a, ha, da), net.gradient(b, hb, db), strict=True)]
        g[0] = g[0] + decay * net.p[0]
        now = rate * (0.5 + 0.5 * np.cos(np.pi * step / steps))
        for q, gq, mq, vq in zip(net.p, g, m, v, strict=True):
            mq += 0.1 * (gq - mq)
            vq += 0.01 * (gq * gq - vq)
            q -= now * (mq / (1 - 0.9**step)) / (np.sqrt(vq / (1 - 0.99**step)) + 1e-8)
    return net


def slopes(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> tuple[np.ndarray, np.ndarray]:
    """What the risk changes by with the outputs for positives and unlabelled rows."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    n, m = len(positive), len(unlabelled)
    if prior is None:
        return (sig(positive) - 1) / n, sig(unlabelled) / m
    if np.logaddexp(0, unlabelled).mean() >= prior * np.logaddexp(0, positive).mean():
        return prior * (sig(positive) - 1) / n - prior * sig(positive) / n, sig(unlabelled) / m
    # the unbiased estimate has gone below what any risk can be: step back
    return prior * sig(positive) / n, -sig(unlabelled) / m


def bounded_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives among unlabelled rows, from the scores of both."""
    at = np.unique(positive)
    above = lambda x: 1 - np.searchsorted(np.sort(x), at, side="left") / len(x)
    p, u = above(positive), above(unlabelled)
    chance = np.sqrt(np.log(4 / doubt) / 2) * (1 / np.sqrt(len(unlabelled)) + 1 / np.sqrt(len(positive)))
    best = int(np.argmin((u + chance) / p))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior by classifiers of one half, on the other half, both ways."""
    found = []
    for k in (0, 1):
        net = fit(positive[k::2], unlabelled[k::2], None, steps=400)
        found.append(bounded_prior(net.score(positive[1 - k :: 2]), net.score(unlabelled[1 - k :: 2])))
    return float(np.mean(found))


def train(docs: DataFrame, labels: DataFrame, positives: int = 6000, unlabelled: int | None = 6000) -> tuple[Network | None, float]:
    """(network, class prior) from ``docs`` (doc_id, text) of the training fold and ``labels`` (doc_id, quality)."""
    short_batches(docs)
    known = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).join(ids.distinct(), "doc_id", "left_semi")
    known = known.where("quality = 1").select("doc_id")
    good = known.count()
    if not good:
        return None, 0.5
    trusted = sampled(known, "doc_id", good, positives)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    positive = trusted.join(texts, "doc_id").select(F.lit(1).alias("kind"), "text")
    open_ = (texts if unlabelled is None else sampled(texts, "doc_id", n, unlabelled)).select(F.lit(0).alias("kind"), "text")
    got = positive.unionByName(open_).mapInArrow(_described, "kind int, f binary").orderBy("kind", "f").toArrow()
    x = np.frombuffer(b"".join(got["f"].to_pylist()), np.float32).reshape(-1, FEATURES)
    kind = got["kind"].to_numpy()
    if (kind == 0).sum() < 2 or (kind == 1).sum() < 2:
        return None, 0.5
    rng = np.random.default_rng(1)
    positive, rest = (rng.permutation(x[kind == k]) for k in (1, 0))
    prior = class_prior(positive, rest)
    return fit(positive, rest, prior), prior


def score(docs: DataFrame, net: Network | None, prior: float) -> DataFrame:
    """doc_id, score of every row, from its whole text."""
    short_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if net is None:
        return rows.select("doc_id", F.lit(prior).alias("score"))

    def run(batches):
        for batch in batches:
            for first, end, data, at in buffers.blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(np.round(net.score(features(data, at)), 9))], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")
