"""Document fingerprints by a randomised edit embedding.

A text's characters are walked by a random rule that all texts share: at step ``j`` on character ``c`` the walk either
stays or goes on, as a bit of (j, c) says. Texts that differ by few edits fall back into step soon after each, so edit
distance turns into Hamming distance of what the walks see. Of these, SAMPLES positions are kept, spread evenly over
twice the text's length rounded up to a power of two (its scale), and as many for the next scale, so that texts of
neighbouring scales can be compared. A sample is a hash of the character in 1 to 15; 0 stands past the end of the text.

The fingerprint is a string: two hexadecimal digits of the scale and two runs of SAMPLES digits. Likeness is the share
of equal samples among those in which either text has a character.

``near_classes`` finds texts a few edits apart. Bands of a walk are BANDS groups of WIDTH samples that lie close together:
where two walks are in step, they see the same characters for a while, so neighbouring samples agree or differ together. A
walk that an insertion puts out of step far from the end of a text may stay so; each text is walked from its end as well,
and for a few steps from ANCHORS places that the text picks, where the hashes of its short runs of characters are least.
Samples past a text's end tell nothing, so lengths are cut into classes, STEPS to a doubling; a class takes the bands that
its shortest texts reach, and a text is in all classes that a near text can be of. Texts that agree in a band are in one
bucket, and a bucket's texts are verified until they are of one class or known to be further apart, the least one against
all first (``buckets``): by ``sketches``, which part a near pair with a chance below 1 in 100,000, then by edit distance.
So but for that chance every two texts that share a band and are near are in one class;
whether they share one is a matter of chance, which the tests measure.

Whole texts are walked, many at a time, the longest first.

Defined results: null counts as empty; two texts without characters have likeness 1; texts more than one scale apart 0;
repeated rows follow each other in the order of documents; a single document is its own next; an empty table gives an
empty result; other columns don't matter. Documents of one doc_id are ordered by their texts. Texts are told apart by a
64-bit hash in ``near_classes``; time for edit distances grows with the square of the length at worst; texts that have too few
runs of five or eight characters in common are known to be further apart before that.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwork.llm import bloom, buckets, buffers, edit_distance, sketches
from shelfwork.llm.storage import drop, sampled, short_batches, stash

SAMPLES = 96
#: Characters walked together, about.
TOGETHER = 5 << 20
_STEPS = 1024
#: Runs of documents at most, which pass through a task piece by piece, and ids that tell where they are cut, about.
MOST_RUNS, SAMPLE = 50_000, 1_000_000
_SEED = np.uint64(0x2545F4914F6CDD1D)


def _rules(first: int) -> np.ndarray:
    """For _STEPS steps from ``first`` on and each of 64 kinds of characters: 1 to go on; kind 63 is the end and stays."""
    word = buffers.mix(np.arange(first, first + _STEPS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _SEED)
    bits = (word[:, None] >> np.arange(64, dtype=np.uint64)[None]) & np.uint64(1)
    bits[:, 63] = 0
    return bits.astype(np.int64)


def positions(scale: int) -> np.ndarray:
    """The sampled steps of a scale, one in each of SAMPLES equal parts of the walk."""
    width = (2 << scale) / SAMPLES
    u = buffers.mix(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(scale * 1000 + 17)) >> np.uint64(11)
    return ((np.arange(SAMPLES) + u / float(1 << 53)) * width).astype(np.int64)


def scale_of(n: int) -> int:
    return max(4, (max(n, 1) - 1).bit_length())


def fingerprints(texts: list[str], places=positions) -> tuple[np.ndarray, np.ndarray]:
    """(scales, (texts, 2, samples) samples); ``places`` gives the sampled steps of a scale, in order."""
    count = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, count)
    scales = np.array([scale_of(n) for n in sizes.tolist()], np.int64)
    order = np.argsort(-sizes, kind="stable")
    points = np.frombuffer(b"".join([(texts[i] + "\0").encode("utf-32-le", "surrogatepass") for i in order.tolist()]), np.uint32)
    kind, symbol = np.empty(len(points), np.int32), np.empty(len(points), np.uint8)
    for k in range(0, len(points), 1 << 20):
        h = buffers.mix(points[k : k + (1 << 20)].astype(np.uint64) + np.uint64(1))
        kind[k : k + len(h)], symbol[k : k + len(h)] = h % np.uint64(63), (h >> np.uint64(32)).astype(np.uint8) % 15 + 1
    length = sizes[order]
    last = np.cumsum(length + 1) - 1
    kind[last], symbol[last] = 63, 0
    at = last - length
    by_scale = scales[order]
    out = np.zeros((count, 2, len(places(4))), np.uint8)
    events = sorted((int(j), int(s), k) for s in range(int(by_scale.min()), int(by_scale.max()) + 2) for k, j in enumerate(places(s))) if count else []
    # rows of one scale lie together, larger scales first
    rows = {s: (int(np.searchsorted(-by_scale, -s, "left")), int(np.searchsorted(-by_scale, -s, "right"))) for s in range(0, int(by_scale.max(initial=0)) + 3)}
    walking, step, rules = count, 0, None
    c, go = np.empty(count, np.int32), np.empty(count, np.int64)
    for j, s, k in events:
        while step < j and walking:
            if step % _STEPS == 0:
                rules = _rules(step)
            upto = min(j, step - step % _STEPS + _STEPS, step + 256 - step % 256)
            place, cw, gw = at[:walking], c[:walking], go[:walking]
            for one in rules[step % _STEPS : step % _STEPS + upto - step]:
                kind.take(place, out=cw, mode="clip")
                one.take(cw, out=gw, mode="clip")
                place += gw
            step = upto
            if step % 256 == 0:
                going = np.flatnonzero(at[:walking] < last[:walking])
                walking = int(going[-1]) + 1 if len(going) else 0
        if not walking:
            break
        for level, own in ((0, s), (1, s - 1)):
            a, b = rows.get(own, (0, 0))
            b = min(b, walking)
            if a < b:
                out[a:b, level, k] = symbol[at[a:b]]
    back = np.empty_like(order)
    back[order] = np.arange(count)
    return scales, out[back]


def likeness(scale_a, a, scale_b, b) -> np.ndarray:
    """Share of equal samples of pairs of fingerprints (arrays of them)."""
    out = np.zeros(len(scale_a))
    for da, db, own in ((0, 0, scale_a == scale_b), (1, 0, scale_b == scale_a + 1), (0, 1, scale_a == scale_b + 1)):
        x, y = a[own, da], b[own, db]
        some = (x > 0) | (y > 0)
        n = some.sum(axis=1)
        out[own] = np.where(n > 0, ((x == y) & some).sum(axis=1) / np.maximum(n, 1), 1.0)
    return out


_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def as_text(scales: np.ndarray, samples: np.ndarray) -> list[str]:
    flat = _DIGITS[samples.reshape(len(samples), -1)]
    return [f"{s:02x}" + row.tobytes().decode() for s, row in zip(scales.tolist(), flat, strict=True)]


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many characters of the following one, or all it has."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _batch(ids: list, texts: list[str], following: str) -> pa.RecordBatch:
    n = len(texts)
    changed = [edited(t, f) for t, f in zip(texts, [*texts[1:], following], strict=True)]
    scales, samples = fingerprints([*texts, following, *changed])
    own, after, new = slice(0, n), slice(1, n + 1), slice(n + 1, 2 * n + 1)
    cols = [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
        pa.array(as_text(scales[own], samples[own])), pa.array(as_text(scales[new], samples[new])),
        pa.array(likeness(scales[own], samples[own], scales[new], samples[new])), pa.array(likeness(scales[own], samples[own], scales[after], samples[after])),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _OUT.split(", ")])


def _walked(batches):
    """Rows come sorted by run, then own rows in order of documents, then the row that follows the run's last."""
    run, ids, texts, size = None, [], [], 0
    for batch in batches:
        for b, ghost, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            text = text or ""
            if ghost:
                if texts and b == run:
                    yield _batch(ids, texts, text)
                    ids, texts, size = [], [], 0
                continue
            if size + len(text) > TOGETHER and texts and b == run:
                yield _batch(ids, texts, text)
                ids, texts, size = [], [], 0
            run = b
            ids.append(doc)
            texts.append(text)
            size += len(text)


def _dealt(splits: np.ndarray, heads: dict[int, int]):
    """(run, ghost, doc_id, text): each row to its run, and the first of a run to the one it follows as well."""

    def deal(batches):
        firsts = np.array(sorted(heads), np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 63)).to_numpy()
            run = np.searchsorted(splits, ids, side="left").astype(np.int32)
            again = np.flatnonzero(np.isin(ids, firsts))
            take = np.concatenate([np.arange(len(ids)), again])
            runs = np.concatenate([run, np.array([heads[int(i)] for i in ids[again]], np.int32)])
            ghost = np.arange(len(take)) >= len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(runs), pa.array(ghost), batch.column(0).take(pa.array(take)), batch.column(1).take(pa.array(take))], names=["run", "ghost", "doc_id", "text"])

    return deal


def edit_fingerprints(docs: DataFrame, runs: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Documents follow each other by descending doc_id (then by text), and the last is followed by the first. The order is
    cut in runs at quantiles of the ids, of a sample of them; what follows a run's last row is sent to it along with its own.
    """
    short_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = runs or min(2 * rows.rdd.getNumPartitions(), MOST_RUNS)
    ids = rows.select("doc_id")
    some = np.sort(sampled(ids.where("doc_id is not null"), "doc_id", ids.count(), SAMPLE).toArrow()["doc_id"].to_numpy())
    splits = np.unique(some[np.arange(1, runs) * len(some) // runs]) if len(some) else np.zeros(0, np.int64)

    def first_ids(batches):
        best: dict[int, int] = {}
        for batch in batches:
            own = batch.column(0).fill_null(-(1 << 63)).to_numpy()
            run = np.searchsorted(splits, own, side="left")
            for r in np.unique(run).tolist():
                best[r] = max(best.get(r, -(1 << 63)), int(own[run == r].max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], names=["run", "first"])

    first = {r["run"]: r["first"] for r in ids.mapInArrow(first_ids, "run int, first long").groupBy("run").agg(F.max("first").alias("first")).collect()}
    order = sorted(first)
    heads = {first[r]: order[(k + 1) % len(order)] for k, r in enumerate(order)}
    dealt = rows.mapInArrow(_dealt(splits, heads), "run int, ghost boolean, doc_id long, text string")
    placed = dealt.repartitionById(len(splits) + 1, "run").sortWithinPartitions("run", "ghost", F.desc_nulls_last("doc_id"), "text")
    return placed.mapInArrow(_walked, _OUT)


#: Bands of a walk, samples in each, and bands that are looked at first.
BANDS, WIDTH, FIRST_BANDS = 48, 16, 8
#: Places in a text where further walks start, the runs of characters that pick them, and the characters that such a walk may see.
ANCHORS, PICKING, AHEAD = 16, 6, 32
#: Classes of lengths to a doubling, and the lengths that end them.
STEPS = 4
_ENDS = np.array([int(2 ** (k / STEPS)) for k in range(40 * STEPS)], np.int64)
#: Bytes of texts that are banded together, about: a step of a walk costs little more for many texts than for few.
BANDED = 10 << 20
#: Sketches that all meet in one task.
BLOCK = 8000


def band_positions(scale: int) -> np.ndarray:
    """The sampled steps of a scale: BANDS groups of WIDTH, every second step (each step of the least scale)."""
    apart, part = (1 if scale == 4 else 2), (2 << scale) / BANDS
    u = buffers.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(scale * 1000 + 17)) >> np.uint64(11)
    starts = ((np.arange(BANDS) + u / float(1 << 53)) * part).astype(np.int64)
    return (starts[:, None] + apart * np.arange(WIDTH)[None]).ravel()


def _hashed(text: str, run: int) -> np.ndarray:
    """A hash of each run of so many characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    count = max(len(points) - run + 1, 0)
    h = np.zeros(count, np.uint64)
    for k in range(run):
        h = buffers.mix(h ^ points[k : k + count])
    return h


def _anchors(text: str) -> list[int]:
    """The first places of the runs of least hash."""
    h = _hashed(text, PICKING)
    few = np.flatnonzero(h <= np.partition(h, 8 * ANCHORS)[8 * ANCHORS]) if len(h) > 8 * ANCHORS else np.arange(len(h))
    once, first = np.unique(h[few], return_index=True)
    if len(once) < ANCHORS and len(few) < len(h):
        few = np.arange(len(h))
        once, first = np.unique(h, return_index=True)
    return few[first[:ANCHORS]].tolist()


def _anchored(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of the walks that start at anchors."""
    own, parts = [], []
    for i, t in enumerate(texts):
        at = _anchors(t)
        own += [i] * len(at)
        parts += [t[a : a + AHEAD].ljust(AHEAD) for a in at]
    _, samples = fingerprints(parts, lambda scale: np.arange(0, 2 * WIDTH, 2))
    return np.array(own, np.int64), (samples[:, 0].astype(np.uint64) << (np.arange(WIDTH, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)


def bands(texts: list[str], most: tuple[int, int] = (1, 10)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, band, key) of every band of the texts: of walks from the start, from the end, and from anchors."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    least, greatest = (np.searchsorted(_ENDS, x) for x in (n, n * most[1] // max(most[1] - most[0], 1)))
    out = []
    own, codes = _anchored(texts)
    for more in range(int((greatest - least).max(initial=-1)) + 1):
        some = least[own] + more <= greatest[own]
        kind = (least[own[some]] + more).astype(np.uint64)
        out.append((own[some], np.full(int(some.sum()), 2 * BANDS), buffers.mix(codes[some] ^ buffers.mix(kind))))
    for way, side in enumerate((texts, [t[::-1] for t in texts])):
        scales, samples = fingerprints(side, band_positions)
        codes = (samples.reshape(len(texts), 2, BANDS, WIDTH).astype(np.uint64) << (np.arange(WIDTH, dtype=np.uint64) * np.uint64(4))).sum(axis=3, dtype=np.uint64)
        for kind in range(int(least.min(initial=0)), int(greatest.max(initial=-1)) + 1):
            scale = scale_of(int(_ENDS[kind]))
            level = scale - scales
            own = np.flatnonzero((least <= kind) & (greatest >= kind) & (n > 0) & (level >= 0) & (level < 2))
            shortest = (int(_ENDS[kind - 1]) if kind else 0) * (most[1] - most[0]) // most[1]
            some = max(1, int(BANDS * 0.95 * shortest / (1 << scale)))
            key = buffers.mix(codes[own, level[own], :some] ^ buffers.mix(np.uint64(kind * 1000) + np.arange(some, dtype=np.uint64))[None])
            out.append((np.repeat(own, some), np.tile(np.arange(some) + way * BANDS, len(own)), key.ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _banded(most: tuple[int, int]):
    def banded(uid: np.ndarray, column: pa.Array):
        uid, own = np.unique(uid, return_index=True)
        text, band, key = bands([t or "" for t in column.take(pa.array(own)).to_pylist()], most)
        key = (key & ~np.uint64(127)) | band.astype(np.uint64)  # one number to send: the band is in its last bits
        return pa.RecordBatch.from_arrays([pa.array(uid[text]), pa.array(key.view(np.int64))], names=["uid", "prefix"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if held and size + batch.column(1).nbytes > BANDED:
                yield banded(np.concatenate([u for u, _ in held]), pa.concat_arrays([t for _, t in held]))
                held, size = [], 0
            held.append((batch.column(0).to_numpy(), batch.column(1)))
            size += batch.column(1).nbytes
        if held:
            yield banded(np.concatenate([u for u, _ in held]), pa.concat_arrays([t for _, t in held]))

    return run


def _common(a: str, b: str) -> int:
    """Characters at the start that are the same, found by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def within(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions and replacements make one of the other.

    A column of the table of distances is two integers whose bits say where it rises and falls, so a character is some
    operations on whole integers.
    """
    k = _common(a, b)
    a, b = a[k:], b[k:]
    k = _common(a[::-1], b[::-1])
    a, b = sorted((a[: len(a) - k], b[: len(b) - k]), key=len)
    if len(b) - len(a) > most or not a:
        return len(b) <= most if not a else False
    points = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    where = {chr(c): int.from_bytes(np.packbits(points == c, bitorder="little").tobytes(), "little") for c in np.unique(points).tolist()}
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rise, fall, distance = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        same = where.get(c, 0)
        down = same | fall
        across = (((same & rise) + rise) ^ rise) | same
        up, less = fall | (full & ~(across | rise)), rise & across
        if up & top:
            distance += 1
        elif less & top:
            distance -= 1
        if distance - left > most:
            return False
        up, less = ((up << 1) | 1) & full, (less << 1) & full
        rise, fall = less | (full & ~(down | up)), up & down
    return distance <= most


#: Characters of the runs that are counted before an edit distance is worked out.
_RUN, _LONG_RUN = 5, 8


def _runs(text: str, run: int = _RUN) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (sketches.run_hashes(points, run) >> np.uint64(42)).astype(np.int32)


def _may(a: np.ndarray, b: np.ndarray, longer: int, most: int, run: int = _RUN) -> bool:
    """Whether texts of these runs can be ``most`` edits apart: an edit changes at most ``run`` runs. Never False for those that are."""
    needed = longer - run + 1 - most * run
    if needed <= 0:
        return True
    shift = max(0, 22 - max(12, (2 * longer).bit_length()))
    bins = 1 << (22 - shift)
    return int(np.minimum(np.bincount(a >> shift, minlength=bins), np.bincount(b >> shift, minlength=bins)).sum()) >= needed


def _judge(most: tuple[int, int]):
    """``buckets.Judge``: runs in common, then edit distances. Pairs of one left text follow each other."""

    def judge(pairs: list[tuple[bytes, bytes]]) -> np.ndarray:
        out, left, x = np.zeros(len(pairs), bool), [], None
        for k, (own, other) in enumerate(pairs):
            if own is not x:
                x, a, runs = own, own.decode("utf-8", "replace"), {}
            b = other.decode("utf-8", "replace")
            longer, edits = max(len(a), len(b)), max(len(a), len(b)) * most[0] // most[1]
            if longer - min(len(a), len(b)) > edits:
                continue
            for run in (_RUN, _LONG_RUN):
                if run not in runs:
                    runs[run] = _runs(a, run)
                if not _may(runs[run], _runs(b, run), longer, edits, run):
                    break
            else:
                left.append((k, (a, b, edits)))
        if left:
            out[[k for k, _ in left]] = edit_distance.within_many([p for _, p in left], _common)
        return out

    return judge


def near_classes(docs: DataFrame, most: tuple[int, int] = (1, 10)) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), class_size of every row: classes of texts that are linked by edit distances
    of at most ``most`` (a fraction) of the longer one's characters."""
    short_batches(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("uid"), text.alias("text"))
    payloads = rows.select("uid", F.col("text").cast("binary").alias("payload"))
    # dealt out once: what follows is by this column, or by more
    at = rows.select("uid", "text").mapInArrow(_banded(most), "uid long, prefix long").repartition("prefix").distinct()
    shared = at.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    at = stash(at.join(shared, "prefix").select("uid", F.col("prefix").bitwiseAND(F.lit(127)).cast("int").alias("tree"), "prefix"), "buckets")
    known = stash(sketches.sketched(bloom.among(payloads, at.select("uid")), most).dropDuplicates(["uid", "zone"]), "sketches")
    texts = lambda uids: bloom.among(payloads, uids).dropDuplicates(["uid"])
    found = buckets.classes([at.where(F.col("tree") < FIRST_BANDS), at.where(F.col("tree") >= FIRST_BANDS)], [at], texts, _judge(most), None, BLOCK, sketches.RunSift(known, most))
    drop(at)
    drop(known)
    named = rows.select("doc_id", "uid").join(found, F.col("uid") == F.col("node"), "left").select("doc_id", F.coalesce("root", "uid").alias("root"))
    sizes = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return named.join(sizes, "root").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "class_size")
