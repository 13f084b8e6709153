"""Embedding whitening by a bidiagonal qd solver.

Vectors become whole numbers, x = floor(64 * c) + 1000000, and the fit list has each distinct one once. Tasks centre
their rows (exactly: n * x - S is a whole number) and reduce them block by block to a triangle by QR; triangles meet in
groups, level by level, until few are left. What remains is of the size of the dimensions, whatever the number of rows:
the last triangle is brought to two diagonals by Householder reflections, dqds finds the singular values to high relative
accuracy, and twisted factorisations give the vectors, which the reflections turn back. Singular values squared over n
are the eigenvalues of the covariance. How far the whitened fit list is from the identity is measured over all of it.

Defined results: rows without a vector, with an entry that is null, not finite or too large for x, and rows whose number
of dimensions isn't that of most distinct vectors (the larger one, if two are as frequent) are dropped; rows without an
id and repeated rows are rows of the result each. Components whose eigenvalue is 0 to working precision have no rows, so
a list of one distinct vector, or none, gives an empty result. ``deviation`` is null where it is beyond 64 bits. Other
columns don't matter, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwork.llm.storage import short_batches, stash

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows that are centred and reduced at once, and bytes of triangles that meet in a group.
ROWS = 2048
GROUP_BYTES = 1 << 26
_EPS = np.finfo(np.float64).eps

# --- the small solver ------------------------------------------------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, W) with r = U B W': Householder reflections from both sides, of which the right ones are kept."""
    a, d = r.copy(), len(r)
    w = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            return None
        v = x / size
        v[0] += math.copysign(1.0, v[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflector(a[k:, k].copy())
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v = reflector(a[k, k + 1 :].copy())
            if v is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
                w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _transform(q: list[float], e: list[float], s: float) -> tuple[list[float], list[float], int, float]:
    """One differential qd step with shift ``s``: (q, e, -1, _), or the place where a value went below 0 and that value."""
    n, d = len(q), q[0] - s
    qq, ee = [0.0] * n, [0.0] * (n - 1)
    for i in range(n - 1):
        if d < 0:
            return q, e, i, d
        qq[i] = d + e[i]
        t = q[i + 1] / qq[i] if qq[i] > 0 else 1.0
        ee[i] = e[i] * t
        d = d * t - s
    if d < 0:
        return q, e, n - 1, d
    qq[n - 1] = d
    return qq, ee, -1, d


def _count_below(q: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many squared singular values are below each of ``x``: signs of the pivots of the shifted matrix."""
    s, below = -x, np.zeros(len(x), np.int64)
    for i in range(len(q)):
        pivot = s + q[i]
        pivot = np.where(pivot == 0, -np.finfo(float).tiny, pivot)
        below += pivot < 0
        if i < len(e):
            s = e[i] * (s / pivot) - x
    return below


def _bisected(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    most = float((np.sqrt(q) + np.append(np.sqrt(e), 0) + np.append(0, np.sqrt(e))).max() ** 2) * 1.01 + np.finfo(float).tiny
    low, high, k = np.zeros(len(q)), np.full(len(q), most), np.arange(len(q))
    for _ in range(1100):
        middle = np.where(low > high / 4, (low + high) / 2, np.sqrt(np.maximum(low, high * 1e-12) * high))
        right = _count_below(q, e, middle) <= k
        low, high = np.where(right, middle, low), np.where(right, high, middle)
        if (high - low <= 2 * _EPS * high).all():
            break
    return (low + high) / 2


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling: differential qd steps with shifts.

    A shift comes from the last two rows; if it was too large, what the last value fell short by corrects it. Where a
    superdiagonal entry becomes negligible the matrix splits, and a part whose steps don't end is bisected.
    """
    found: list[float] = []
    q, e = (a * a).tolist(), (b * b).tolist()
    if len(q) > 1 and q[-1] > 1.5 * q[0]:  # large values first
        q, e = q[::-1], e[::-1]
    small = (4 * _EPS) ** 2
    parts = [(q, e, 0.0)]
    while parts:
        q, e, shift = parts.pop()
        steps, most = 0, 40 * len(q) + 100
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + shift)
                break
            if e[-1] <= small * (shift + q[-1]) or e[-1] == 0:
                found.append(q[-1] + shift)
                q, e = q[:-1], e[:-1]
                continue
            cut = next((i for i in range(n - 2, -1, -1) if e[i] == 0 or e[i] <= small * (shift + q[i + 1]) and e[i] <= small * (shift + q[i])), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], shift))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if steps > most:
                found += (_bisected(np.array(q), np.array(e)) + shift).tolist()
                break
            steps += 1
            # the smaller eigenvalue of the last two rows
            x, y, z = q[-2] + (e[-2] if n > 2 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
            s = 0.0 if steps == 1 else max(0.0, (x * y - z) / ((x + y) / 2 + math.sqrt(((x - y) / 2) ** 2 + z)) if x + y > 0 else 0.0)
            for _ in range(4):
                qq, ee, bad, d = _transform(q, e, s)
                if bad < 0:
                    break
                s = max(0.0, s + d) if bad == n - 1 and s + d < s else s / 4
            else:
                s = 0.0
                qq, ee, bad, d = _transform(q, e, s)
            q, e, shift = qq, ee, shift + s
    return np.sort(np.array(found))[::-1]


def _twisted(q: np.ndarray, ell: np.ndarray, value: float) -> np.ndarray:
    """The vector of an eigenvalue of L D L' (D: q, L: 1 and ell): both factorisations of the shifted matrix, twisted
    together where the remaining pivot is least."""
    n, tiny = len(q), np.finfo(float).tiny * 4
    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + q[i]
        pivot = pivot if abs(pivot) > tiny else -max(_EPS * _EPS * value, tiny)
        down[i] = q[i] * ell[i] / pivot
        s[i + 1] = down[i] * ell[i] * s[i] - value
    p[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        pivot = q[i] * ell[i] ** 2 + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else -max(_EPS * _EPS * value, tiny)
        t = q[i] / pivot
        up[i] = ell[i] * t
        p[i] = p[i + 1] * t - value
    gamma = np.abs(s + p + value)
    k = int(np.nanargmin(gamma))
    z = np.zeros(n)
    z[k] = 1
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def _apart(z: np.ndarray, others: list[np.ndarray], t: np.ndarray, value: float) -> np.ndarray:
    """``z`` made orthogonal to the vectors of close values; if little of it is left, steps of inverse iteration from other starts."""
    rng = np.random.default_rng(len(others))
    for attempt in range(6):
        for _ in range(2):
            for o in others:
                z = z - (o @ z) * o
        size = np.linalg.norm(z)
        if size > 0.1 or not others:
            return z / size
        z = rng.normal(size=len(z))
        for _ in range(3):
            for o in others:
                z = z - (o @ z) * o
            z = np.linalg.solve(t - (value * (1 + 4 * (attempt + 1) * _EPS)) * np.eye(len(t)), z)
            z /= np.linalg.norm(z)
    return z


def solve(r: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(squared singular values, falling; right singular vectors as columns; sum of all squares) of a triangle: the first ``most``
    of those that aren't 0 to working precision."""
    size = float(np.abs(r).max()) if r.size else 0.0
    if size == 0 or not np.isfinite(size):
        return np.zeros(0), np.zeros((len(r), 0)), 0.0
    a, b, w = bidiagonal(r / size)
    norm = float(np.abs(a).max() + (np.abs(b).max() if len(b) else 0))
    a = np.where(np.abs(a) < _EPS * norm / 1024, _EPS * norm / 1024, a)
    b = np.where(np.abs(b) <= _EPS * norm / 8, 0.0, b)
    edges = np.concatenate([[0], np.flatnonzero(b == 0) + 1, [len(a)]])
    known = [(float(x), int(i), int(j)) for i, j in zip(edges[:-1], edges[1:], strict=True) for x in dqds(a[i:j], b[i : j - 1])]
    known.sort(key=lambda x: (-x[0], x[1]))
    zero = (len(a) * _EPS * math.sqrt(known[0][0])) ** 2
    chosen = [x for x in known[:most] if x[0] > zero]
    vectors, inside = [], []
    for value, i, j in chosen:
        q, ell = a[i:j] ** 2, b[i : j - 1] / a[i : j - 1]
        z = _twisted(q, ell, value)
        near = [v for (x, k, _), v in zip(chosen, inside, strict=False) if k == i and abs(x - value) <= 1e-3 * known[0][0]]
        if near:
            upper = np.diag(a[i:j]) + np.diag(b[i : j - 1], 1)
            z = _apart(z, near, upper.T @ upper, value)
        inside.append(z)
        whole = np.zeros(len(a))
        whole[i:j] = z
        v = w @ whole
        vectors.append(v * math.copysign(1.0, v[np.abs(v).argmax()]))
    squares = float((r / size).ravel() @ (r / size).ravel())
    return np.array([x for x, _, _ in chosen]) * size**2, np.array(vectors).T.reshape(len(a), -1), squares * size**2


# --- whole numbers ---------------------------------------------------------------------------------------------------


def whole_numbers(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, x less SHIFT as a matrix) for each number of dimensions; rows that are dropped are in none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # nulls are NaN
    at = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(at)
    there = (~np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)) & (size > 0)
    found = []
    for d in np.unique(size[there]).tolist():
        rows = np.flatnonzero(there & (size == d))
        c = flat[at[rows][:, None] + np.arange(d)]
        with np.errstate(all="ignore"):
            y = np.floor(c * SCALE)
            good = (np.isfinite(c) & (np.abs(y) < 2.0**62)).all(axis=1)
        if good.any():
            found.append((rows[good], y[good].astype(np.int64)))
    return found


def packed(y: np.ndarray) -> list[bytes]:
    """A row as bytes, each number in as few bytes as the row allows; equal rows have equal bytes."""
    most, out = np.abs(y).max(axis=1), np.empty(len(y), object)
    width = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
    for k in np.unique(width).tolist():
        rows = np.flatnonzero(width == k)
        data, n = y[rows].astype(f"<i{k}").tobytes(), k * y.shape[1]
        for r, first in zip(rows.tolist(), range(0, len(data), n), strict=True):
            out[r] = bytes([k]) + data[first : first + n]
    return out.tolist()


def unpacked(rows: list[bytes], d: int) -> np.ndarray:
    y, width = np.empty((len(rows), d), np.int64), np.array([r[0] for r in rows])
    for k in np.unique(width).tolist():
        own = np.flatnonzero(width == k)
        y[own] = np.frombuffer(b"".join(rows[i][1:] for i in own.tolist()), f"<i{k}").reshape(-1, d)
    return y


def _distinct(batches):
    for batch in batches:
        keys, dims = [], []
        for _, y in whole_numbers(batch.column(0)):
            own = packed(y)
            keys += own
            dims += [y.shape[1]] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(dims, pa.int32())], names=["x", "dims"])


def _sums(d: int):
    def run(batches):
        total, n = np.zeros(d, np.int64), 0
        for batch in batches:
            y = unpacked(batch.column(0).to_pylist(), d)
            total, n = total + y.sum(axis=0), n + len(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d)), pa.array(np.append(n, total))], names=["place", "total"])

    return run


# --- reductions ------------------------------------------------------------------------------------------------------


def centred(y: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """y - total / n; the difference is taken in whole numbers, if these fit."""
    if float(np.abs(y).max(initial=0)) * n < 2.0**62:
        return (n * y - total) / n
    return y - total / n


def _part() -> int:
    return TaskContext.get().partitionId() if TaskContext.get() else 0


def _triangles(d: int, n: int, total: np.ndarray):
    def run(batches):
        r = np.zeros((0, d))
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for first in range(0, len(rows), ROWS):
                r = np.linalg.qr(np.vstack([r, centred(unpacked(rows[first : first + ROWS], d), n, total)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([_part()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "state"])

    return run


def _join_triangles(states: list[bytes], d: int) -> bytes:
    r = np.zeros((0, d))
    for s in states:
        r = np.linalg.qr(np.vstack([r, np.frombuffer(s).reshape(-1, d)]), mode="r")
    return r.tobytes()


def _moments(d: int, n: int, total: np.ndarray, directions: np.ndarray):
    k = directions.shape[1]

    def run(batches):
        state = None
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for first in range(0, len(rows), ROWS):
                z = centred(unpacked(rows[first : first + ROWS], d), n, total) @ directions
                mean = z.mean(axis=0)
                own = np.concatenate([[len(z)], mean, ((z - mean).T @ (z - mean)).ravel()]).tobytes()
                state = own if state is None else _join_moments([state, own], k)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_part()], pa.int64()), pa.array([state], pa.binary())], names=["part", "state"])

    return run


def _join_moments(states: list[bytes], k: int) -> bytes:
    """Number, means and centred products of the union of parts."""
    n, mean, product = 0.0, np.zeros(k), np.zeros((k, k))
    for s in states:
        x = np.frombuffer(s)
        m, own, more = x[0], x[1 : 1 + k], x[1 + k :].reshape(k, k)
        step = own - mean
        product = product + more + np.outer(step, step) * (n * m / (n + m))
        mean, n = mean + step * (m / (n + m)), n + m
    return np.concatenate([[n], mean, product.ravel()]).tobytes()


def _reduced(parts: DataFrame, join, bytes_each: int) -> bytes | None:
    """Parts (part, state) joined in groups, level by level, until one group is left."""
    fan = max(2, min(32, GROUP_BYTES // max(bytes_each, 1)))
    parts = stash(parts, "whitening")

    def merge(key, groups):
        yield from _merged(key, groups, join)

    while (n := parts.count()) > fan:
        groups = -(-n // fan)
        parts = stash(parts.groupBy(F.pmod("part", F.lit(groups)).alias("part")).applyInArrow(merge, "part long, state binary"), "whitening")
        if parts.count() == n:
            break
    rows = parts.orderBy("part").collect()  # one group
    return join([bytes(r["state"]) for r in rows]) if rows else None


def _merged(key, batches, join):
    states = [s for batch in batches for s in batch.column(1).to_pylist()]
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([join(states)], pa.binary())], names=["part", "state"])


def _whitened(d: int, n: int, total: np.ndarray, directions: np.ndarray, explained: np.ndarray, error: float):
    k = directions.shape[1]

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for rows, y in whole_numbers(batch.column(1)):
                if y.shape[1] != d:
                    continue
                z = centred(y, n, total) @ directions
                with np.errstate(over="ignore"):
                    step = n * y - total
                    size = np.abs(y.astype(np.float64) * n - total)
                    fits = (size < 2.0**62).all(axis=1) & ((size * size).sum(axis=1) < 2.0**63 * (1 - 1e-12))
                    deviation = (step * step).sum(axis=1)
                m = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(np.repeat(deviation, k), mask=np.repeat(~fits, k)),
                        pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every row of ``rows`` that isn't dropped and each
    of the first ``components`` components."""
    spark = rows.sparkSession
    short_batches(rows)
    name = lambda c: F.col(f"`{c}`")
    given = rows.select(name(key).cast("long").alias("vec_id"), name(vector).cast("array<double>").alias("c"))
    fit = stash(given.select("c").mapInArrow(_distinct, "x binary, dims int").distinct(), "whitening-fit")
    most = fit.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("dims").desc()).first()
    nothing = spark.createDataFrame([], _RESULT)
    if most is None:
        return nothing
    d = most["dims"]
    own = fit.where(F.col("dims") == d).select("x")
    sums = {r["place"]: r["total"] for r in own.mapInArrow(_sums(d), "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect()}  # a row for each dimension
    n, total = sums[-1], np.array([sums[k] for k in range(d)], np.int64)
    triangle = _reduced(own.mapInArrow(_triangles(d, n, total), "part long, state binary"), lambda s: _join_triangles(s, d), 8 * d * d)
    r = np.zeros((d, d))
    given_r = np.frombuffer(triangle).reshape(-1, d)
    r[: len(given_r)] = given_r
    squares, vectors, trace = solve(r, components)
    if not len(squares):
        return nothing
    directions = vectors / np.sqrt(squares / n)
    k = len(squares)
    state = np.frombuffer(_reduced(own.mapInArrow(_moments(d, n, total, directions), "part long, state binary"), lambda s: _join_moments(s, k), 8 * (k * k + k + 1)))
    error = float(np.abs(state[1 + k :].reshape(k, k) / n - np.eye(k)).max())
    return given.mapInArrow(_whitened(d, n, total, directions, squares / trace, error), _RESULT)
