from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from shelfwork.llm import whitening

KIND = "vec_id long, embedding array<double>, x string, dims int, n string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "x", 1, "n", 2) for a, b in rows], KIND)


def brute(rows, most=16):
    x = [(k, np.floor(np.array(c, float) * 64).astype(int) + 1_000_000) for k, c in rows]
    fit = np.unique(np.array([v for _, v in x]), axis=0)
    n, total = len(fit), fit.sum(axis=0)
    z = (n * fit - total) / n
    e, v = np.linalg.eigh(z.T @ z / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return {(k, c + 1): (n, sum(int(t) ** 2 for t in n * y - total), abs(float(((n * y - total) / n) @ v[:, c])) / np.sqrt(e[c]), e[c] / np.trace(z.T @ z / n)) for k, y in x for c in range(len(e))}


def hold(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, deviation, whitened, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation if deviation < 1 << 63 else None)
        assert abs(abs(r["whitened"]) - whitened) < 1e-7 and abs(r["explained"] / explained - 1) < 1e-9 and r["identity_error"] < 1e-8


def test_equal_to_eigenvectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 20)) * np.linspace(3, 0.2, 20) + rng.normal(size=20)
    rows = [(k, c.tolist()) for k, c in enumerate(base)] + [(1000 + k, base[5].tolist()) for k in range(40)]
    hold(whitening.whiten(frame(spark, rows).repartition(7)).collect(), brute(rows))


def test_levels_of_groups(spark, monkeypatch):
    """Many parts are joined two by two."""
    monkeypatch.setattr(whitening, "GROUP_BYTES", 1)
    rng = np.random.default_rng(5)
    rows = [(k, c.tolist()) for k, c in enumerate(rng.normal(size=(90, 5)) * [5, 4, 3, 2, 1])]
    hold(whitening.whiten(frame(spark, rows).repartition(9)).collect(), brute(rows))


def test_odd_rows(spark):
    """Nulls, entries that aren't numbers, other lengths, repeated rows, no id, large numbers."""
    rng = np.random.default_rng(6)
    good = [(k, c.tolist()) for k, c in enumerate(rng.normal(size=(40, 3)) * [1e6, 1e5, 4])]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [1.0, float("inf"), 2.0]), (104, []), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0])]
    got = whitening.whiten(frame(spark, good + bad + [(3, good[3][1]), (None, good[0][1])])).collect()
    assert len(got) == 42 * 3
    assert {r["vec_id"] for r in got} == {*range(40), None} and {r["n"] for r in got} == {40}
    hold([r for r in got if r["vec_id"] not in (None, 3)], {k: v for k, v in brute(good).items() if k[0] != 3})


def test_lists_without_components(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect() == []
    flat = whitening.whiten(frame(spark, [(1, [0.5, 1.0]), (2, [2.5, 1.0]), (3, [4.5, 1.0])])).collect()
    assert {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12


def triangle(a):
    return np.linalg.qr(a, mode="r")


def matrices():
    rng = np.random.default_rng(0)
    u, w = (np.linalg.qr(rng.normal(size=(30, 30)))[0] for _ in range(2))
    n = 21
    two = np.diag(np.abs(np.arange(n) - 10) + 20.0) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    yield from ((f"random {d}", triangle(rng.normal(size=(3 * d, d)))) for d in (1, 2, 3, 64, 150))
    yield "repeated", triangle(u @ np.diag([9.0] * 5 + [4.0] * 10 + [1e-3] * 15) @ w)
    yield "close and zero", triangle(u @ np.diag(np.r_[np.ones(15) + 1e-12 * np.arange(15), np.zeros(15)]) @ w)
    yield "graded", triangle(u @ np.diag(10.0 ** -np.arange(30)) @ w)
    yield "pairs", np.linalg.cholesky(two).T
    yield "diagonal", np.diag([5.0, 5, 5, 1, 1, 0, 0])
    yield "singular", np.triu(np.ones((4, 4))) - np.diag([0.0, 0, 1, 0])


@pytest.mark.parametrize("name,r", list(matrices()))
def test_solver(name, r):
    want = np.linalg.svd(r, compute_uv=False) ** 2
    squares, v, trace = whitening.solve(r, len(r))
    k = len(squares)
    assert k == (want > (len(r) * 2.3e-16) ** 2 * want[0]).sum() or name == "graded"
    assert np.abs(squares - want[:k]).max() < 1e-14 * want[0] * max(1, len(r) / 10)
    assert np.abs(v.T @ v - np.eye(k)).max() < 1e-11
    assert np.abs(r.T @ (r @ v) - v * squares).max() < 1e-13 * want[0]
    assert abs(trace / want.sum() - 1) < 1e-13


def test_dqds_keeps_small_values_accurate():
    """Relative errors are of the size of rounding even for values that are a ten thousand billionth of the largest."""
    a, b = 10.0 ** -np.arange(0, 24, 2.0), 10.0 ** -np.arange(1, 23, 2.0) / 3
    from fractions import Fraction

    got = whitening.dqds(a, b)
    product = np.prod([Fraction(float(x)) ** 2 for x in a])  # the product of all is that of the diagonal's squares
    assert abs(float(np.prod([Fraction(float(x)) for x in got]) / product) - 1) < 1e-13
    assert np.abs(whitening._bisected(a * a, b * b)[::-1] / got - 1).max() < 1e-12


def test_rows_as_bytes():
    y = np.array([[1, -2], [1 << 15, 0], [-(1 << 40), 7], [-32767, 32767], [1, -2]])
    rows = whitening.packed(y)
    assert [r[0] for r in rows] == [2, 4, 8, 2, 2] and rows[0] == rows[4]
    assert (whitening.unpacked(rows, 2) == y).all()
    found = whitening.whole_numbers(pa.array([[0.5, -0.01], None, [1.0], [0.1, None]], pa.list_(pa.float64())).slice(0, 4))
    assert [(r.tolist(), m.tolist()) for r, m in found] == [([2], [[64]]), ([0], [[32, -1]])]
