"""Language identification by a byte-level convolutional network, trained in numpy.

Texts are cut into fixed-length windows of bytes (a few shared with the window before, so no byte sequence is lost),
whole texts of any length. In a window, bytes are embedded, filters of several widths run over them, each filter's
maximum over the window is pooled, and a softmax layer gives the language. A document's prediction is that of the mean
of its windows' log-probabilities, weighed by their bytes.

Training takes a bounded sample: ``per_language`` documents of each language and ``windows`` windows of each, chosen by
hash. Everything else covers all rows.

Defined results: a text that is null or has no letter gets ``und`` and score 0; ties go to the first language by code
point; repeated rows are predicted each; with no labelled row every text is ``und``; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwork.llm import buffers
from shelfwork.llm.storage import short_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
UNKNOWN = "und"


class ByteCNN:
    """Embedding (256 x EMBED), filters of all widths as one matrix (longest width * EMBED x filters), softmax layer."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        #: Shares of the documents of each language that were picked to learn from.
        self.rates: dict[str, float] = {}
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.mask = np.zeros((max(WIDTHS) * EMBED, len(WIDTHS) * FILTERS), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
        self.filters = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(self.mask.shape[1], np.float32)
        self.out = rng.normal(0, 0.1, (self.mask.shape[1], len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def parameters(self):
        return [self.embed, self.filters, self.bias, self.out, self.out_bias]

    def columns(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, width * EMBED) of (windows, bytes)."""
        steps = x.shape[1] - max(WIDTHS) + 1
        e = self.embed[x]
        return np.concatenate([e[:, j : j + steps] for j in range(max(WIDTHS))], axis=2)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.out_bias

    def pooled(self, x: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Maxima of the filters; ``pairs``: embeddings of all pairs of bytes, so a column is made of two of them."""
        steps = x.shape[1] - max(WIDTHS) + 1
        two = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
        col = np.empty((len(x), steps, max(WIDTHS) * EMBED), np.float32)
        col[:, :, : 2 * EMBED] = pairs[two[:, :steps]]
        col[:, :, 2 * EMBED :] = pairs[two[:, 2 : steps + 2]]
        act = col.reshape(-1, col.shape[2]) @ self.filters
        return act.reshape(len(x), steps, -1).max(axis=1) + self.bias

    def pairs(self) -> np.ndarray:
        return np.concatenate([np.repeat(self.embed, 256, axis=0), np.tile(self.embed, (256, 1))], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 700, batch: int = 96, rate: float = 4e-3, seed: int = 11) -> ByteCNN:
        """Adam on cross-entropy. Windows are shortened at random, so that short texts are learnt as well."""
        rng = np.random.default_rng(seed)
        m = [np.zeros_like(p) for p in self.parameters()]
        v = [np.zeros_like(p) for p in self.parameters()]
        by_class = [np.flatnonzero(y == k) for k in range(len(self.classes))]
        width = max(WIDTHS)
        for step in range(1, steps + 1):
            own = np.concatenate([rng.choice(r, max(1, batch // len(by_class))) for r in by_class])
            xb, yb = x[own].copy(), y[own]
            cut = np.where(rng.random(len(xb)) < 0.5, rng.integers(12, WINDOW, len(xb)), WINDOW)
            xb[np.arange(WINDOW)[None, :] >= cut[:, None]] = 0
            col = self.columns(xb)
            act = (col.reshape(-1, col.shape[2]) @ self.filters).reshape(len(xb), col.shape[1], -1)
            at = act.argmax(axis=1)
            pooled = np.take_along_axis(act, at[:, None, :], axis=1)[:, 0] + self.bias
            z = self.logits(pooled)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p /= len(yb)
            hidden = np.maximum(pooled, 0)
            g_out, g_ob = hidden.T @ p, p.sum(axis=0)
            g = (p @ self.out.T) * (pooled > 0)
            best = col[np.arange(len(xb))[:, None], at]  # (windows, filters, columns)
            g_f = np.einsum("nf,nfc->cf", g, best) * self.mask
            g_col = g[:, :, None] * (self.filters.T)[None]
            g_e = np.zeros_like(self.embed)
            for j in range(width):
                byte = xb[np.arange(len(xb))[:, None], at + j]
                np.add.at(g_e, byte, g_col[:, :, j * EMBED : (j + 1) * EMBED])
            g_e[0] = 0
            decay = rate * (0.5 + 0.5 * np.cos(np.pi * step / steps))
            for q, gq, mq, vq in zip(self.parameters(), (g_e, g_f, g.sum(axis=0), g_out, g_ob), m, v, strict=True):
                mq += 0.1 * (gq - mq)
                vq += 0.01 * (gq * gq - vq)
                q -= (decay * (mq / (1 - 0.9**step)) / (np.sqrt(vq / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, row of each, bytes in each) of all rows that aren't empty; what a window lacks is 0."""
    lengths = np.diff(offsets)
    stride = WINDOW - max(WIDTHS) + 1
    per = np.where(lengths > 0, np.maximum(1, -(-(lengths - max(WIDTHS) + 1) // stride)), 0)
    row = np.repeat(np.arange(len(lengths)), per)
    k = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[:-1][row] + k * stride
    size = np.minimum(WINDOW, offsets[1:][row] - start)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    x = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start] if len(start) else np.zeros((0, WINDOW), np.uint8)
    x = np.where(np.arange(WINDOW)[None, :] < size[:, None], x, 0).astype(np.uint8)
    return x, row, size


def _sample_windows(per_document: int):
    def cut(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, _, data, at in buffers.blocks(batch.column(1)):
                x, row, size = windows(data, at)
                k = np.arange(len(row)) - np.searchsorted(row, row)
                n = np.bincount(row, minlength=len(at) - 1)[row]
                own = (k * per_document) // np.maximum(n, 1) != ((k - 1) * per_document) // np.maximum(n, 1)
                own |= n <= per_document
                own &= size > 3
                yield pa.RecordBatch.from_arrays([pa.array([langs[first + r] for r in row[own]], pa.string()), pa.array([w.tobytes() for w in x[own]], pa.binary())], names=["lang", "x"])

    return cut


def _picked(lang: Column, text: Column, rates: dict[str, float]) -> Column:
    rate = F.create_map(*(x for k, r in rates.items() for x in (F.lit(k), F.lit(r))))[lang]
    return F.coalesce(F.pmod(F.xxhash64(text, F.lit(5)), F.lit(1 << 40)) < rate * float(1 << 40), F.lit(False))


def learnt(model: ByteCNN) -> Column:
    """Whether the network has learnt from a row (text, lang) of those that it was given."""
    return _picked(F.col("lang").cast("string"), F.col("text").cast("string"), model.rates)


def train(docs: DataFrame, per_language: int = 1200, per_document: int = 3) -> ByteCNN | None:
    """A network for the languages of ``docs`` (text, lang), from a bounded sample of it."""
    short_batches(docs)
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    rates = {k: min(1.0, per_language / n) for k, n in counts.items()}
    chosen = rows.where(_picked(F.col("lang"), F.col("text"), rates))
    got = chosen.mapInArrow(_sample_windows(per_document), "lang string, x binary").orderBy("lang", "x").toArrow()
    if not got.num_rows:
        return None
    classes = sorted(set(got["lang"].to_pylist()))
    index = {c: i for i, c in enumerate(classes)}
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    model = ByteCNN(classes).fit(x, np.array([index[c] for c in got["lang"].to_pylist()]))
    model.rates = rates
    return model


def _predict(model: ByteCNN):
    def run(batches):
        pairs = model.pairs()
        for batch in batches:
            for first, end, data, at in buffers.blocks(batch.column(2), 1 << 19):
                x, row, size = windows(data, at)
                z = np.zeros((end - first, len(model.classes)))
                for k in range(0, len(x), 64):
                    a = model.logits(model.pooled(x[k : k + 64], pairs)).astype(np.float64)
                    a -= a.max(axis=1, keepdims=True)
                    a -= np.log(np.exp(a).sum(axis=1, keepdims=True))
                    np.add.at(z, row[k : k + 64], a * size[k : k + 64, None])
                z /= np.maximum(np.bincount(row, weights=size, minlength=end - first), 1)[:, None]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                letter = batch.column(3).slice(first, end - first).to_numpy(zero_copy_only=False)
                names = [model.classes[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)]
                score = np.where(letter, p[np.arange(len(p)), best], 0.0)
                ids = batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first)
                more = [batch.column(k).slice(first, end - first) for k in range(4, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(names, pa.string()), pa.array(score), *more], names=["doc_id", "row_hash", "lang_pred", "score", *batch.schema.names[4:]])

    return run


def has_letter(text: Column) -> Column:
    return F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))


def least_score(docs: DataFrame, model: ByteCNN, part: float = 0.5) -> float:
    """The score whose odds are ``part`` of the least odds that the network gives a labelled document with letters, by
    all ``docs``, which it hasn't learnt from; without any, 0."""
    known = docs.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    least = identify(known, model).agg(F.min("score")).first()[0]
    if least is None:
        return 0.0
    odds = part * least / max(1 - least, 1e-12)
    return odds / (1 + odds)


#: Steps of the logarithm of odds, and of how many labelled documents of like length one may be less sure than what counts as found.
_STEP, ONE_IN = 0.01, 1000


def size_class(text: Column) -> Column:
    """Texts of at most twice a length are of like length; -1: no characters."""
    n = F.length(text.cast("string"))
    return F.when(n > 0, F.floor(F.log2(n.cast("double")))).otherwise(-1).cast("int")


def _odds(score: Column) -> Column:
    return score / F.greatest(1 - score, F.lit(1e-12))


def least_odds(known: DataFrame, part: float = 0.5) -> dict[int, float]:
    """By class of lengths: ``part`` of the odds that all rows of ``known`` (size, score) of that class have, but for one in ONE_IN.

    A text of few letters tells little of its language and a long one much, so one least score of all would be that of the
    shortest texts, which no long text falls below; and the least of ever more documents would in the end be a score that
    none falls below. All rows are counted, by steps of the logarithm; fewer than ONE_IN rows all have these odds."""
    steps = known.groupBy("size", F.floor(F.log(_odds(F.col("score"))) / _STEP).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    found = {}
    for size in {r["size"] for r in steps}:
        own = sorted((r["step"], r["n"]) for r in steps if r["size"] == size)
        upto = np.cumsum([n for _, n in own])
        found[size] = part * float(np.exp(own[int(np.searchsorted(upto, upto[-1] // ONE_IN, side="right"))][0] * _STEP))
    return found


def is_found(least: dict[int, float]) -> Column:
    """Whether a language is found for rows (lang_pred, score, size), by ``least_odds``. A length without labelled documents
    asks for the odds of the next shorter one; nothing is asked of texts shorter than all labelled ones."""
    asked = F.lit(0.0)
    for size in sorted(least):
        asked = F.when(F.col("size") >= size, least[size]).otherwise(asked)
    return (F.col("lang_pred") != UNKNOWN) & (_odds(F.col("score")) >= asked)


def identify(docs: DataFrame, model: ByteCNN | None, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, row_hash (xxhash64 of the text), lang_pred, score and the columns ``more`` of every row."""
    short_batches(docs)
    text = F.col("text").cast("string")
    letter = has_letter(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), F.when(letter, text).alias("text"), letter.alias("letter"), *more)
    if model is None:
        return rows.select("doc_id", "row_hash", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), *more)
    types = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in more)
    return rows.mapInArrow(_predict(model), "doc_id long, row_hash long, lang_pred string, score double" + types)
