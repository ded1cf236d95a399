"""Whitening against numpy's eigenvectors and exact integers: nulls, repeats, lengths, rank, large entries."""

import math

import numpy as np

from costproof.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component int, n string, x string, dims int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "n", "x", 5) for i, v in rows], SCHEMA)


def check(got, rows, k=8):
    """One length: everything against numpy, up to the sign of a component."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], float)
    n, mean = len(x), x.mean(0)
    values, directions = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    values, directions = values[::-1], directions[:, ::-1]
    sums = [sum(int(a) for a in column) for column in x.T]
    by = {}
    for r in got:
        by.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(by) == list(range(1, min(k, x.shape[1]) + 1)) and all(len(v) == n for v in by.values())
    for c, found in by.items():
        want = (x - mean) @ directions[:, c - 1] / np.sqrt(values[c - 1])
        have = np.array([found[i].whitened for i, _ in rows])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6
        r = found[rows[0][0]]
        assert r.n == n and abs(r.explained - values[c - 1] / values.sum()) < 1e-12 and r.identity_error < 1e-9
        assert all(int(found[i].deviation) == sum((n * int(a) - s) ** 2 for a, s in zip(v, sums, strict=True)) for (i, _), v in zip(rows, x, strict=True))


def test_whitened(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=40) * np.linspace(2, 1, 40)) for i in range(300)]
    odd = [(900, None), (901, [None, *rows[0][1][1:]]), (902, [float("nan")] * 40), (903, [float("inf"), *rows[0][1][1:]]), (904, [])]
    check(whitening.whitened(frame(spark, rows + odd).repartition(5)).collect(), rows)


def test_block_smaller_than_spectrum(spark):
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=50)) for i in range(400)]
    check(whitening.whitened(frame(spark, rows), 3).collect(), rows, 3)


def test_lengths_repeats_and_ranks(spark):
    r = np.random.default_rng(7)
    three = [(i, r.normal(size=3)) for i in range(20)]
    two = [(100 + i, r.normal(size=2) * 5) for i in range(9)]
    got = whitening.whitened(frame(spark, [*three, *two, (500, [1.0] * 5), (500, [1.0] * 5)])).collect()
    check([x for x in got if x.dims == 3], three)
    check([x for x in got if x.dims == 2], two)
    same = [x for x in got if x.dims == 5]
    assert len(same) == 10 and all((x.n, x.deviation, x.whitened, x.explained, x.identity_error) == (2, 0, None, 0, 0) for x in same)
    flat = whitening.whitened(frame(spark, [(i, [i, 2 * i, 0, 0]) for i in range(12)])).collect()
    assert all((x.whitened is None) == (x.component > 1) for x in flat) and abs(next(x.explained for x in flat if x.component == 1) - 1) < 1e-12
    assert whitening.whitened(frame(spark, [])).count() == 0 and whitening.whitened(frame(spark, [(1, None)])).count() == 0


def test_large_entries(spark):
    rows = [(i, [1e300 * (i % 2), -1e18 * i, 3.0, i]) for i in range(8)]
    got = whitening.whitened(frame(spark, rows)).collect()
    x = [[min(max(math.floor(1024 * c), -(1 << 53)), 1 << 53) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((8 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for (i, _), v in zip(rows, x, strict=True)}
    assert {r.vec_id: int(r.deviation) for r in got} == want


def test_spectrum():
    r = np.random.default_rng(8)
    q = np.linalg.qr(r.normal(size=(120, 120)))[0]
    for values in (np.linspace(2, 1, 120), np.repeat([5.0, 5.0, 1.0, 0.0], 30), np.exp(-np.arange(120.0)), np.r_[1e9, np.ones(119)]):
        matrix = q * values @ q.T
        found, vectors = whitening.subspace(lambda b, m=matrix: m @ b, 120, 8)
        assert np.abs(found - np.sort(values)[::-1][:8]).max() <= 1e-12 * values.max() + 1e-300
        assert np.abs(matrix @ vectors - vectors * found).max() <= 1e-10 * values.max()


def test_deviations():
    r = np.random.default_rng(9)
    for low, high in ((-9, 9), (0, 1 << 20), (-(1 << 53), 1 << 53)):
        x = r.integers(low, high, (6, 5))
        sums = [int(s) for s in x.sum(0)]
        for n in (1, 50, 10**6, 10**12):
            assert whitening.deviations(x, n, sums) == [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
