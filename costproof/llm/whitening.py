"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become integers, so their number, sums and deviations are exact. The covariance V of the centred vectors is never formed:
every step is a pass that maps a block Q of a few directions to VQ = Xc'(XcQ)/n, summed inside each task and then over
tasks by dimension, so a pass brings dimensions x directions numbers to the driver whatever the number of vectors.

A round damps what lies below the block's smallest Ritz value by a Chebyshev polynomial (its recurrence, one pass per degree),
orthonormalises the block and solves the small projected problem (Rayleigh-Ritz). It ends when the residuals of the wanted
pairs certify them. Directions beyond the wanted ones guard the order and speed up the damping.

Vectors of different lengths have no common covariance: each length is fitted by itself.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from costproof.llm.tables import written

#: An entry c counts as floor(SCALE * c) + SHIFT; entries beyond LARGEST after scaling count as LARGEST.
SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 53
#: Components by default, directions of the block for each of them, highest degree, largest growth of a round, rounds.
COMPONENTS, BLOCK, DEGREE, GROWTH, ROUNDS = 8, 4, 16, 1e8, 60
#: A residual (over the largest eigenvalue) that certifies at once, and one that does when rounding lets it fall no further.
SHARP, ENOUGH = 1e-13, 1e-11
_LOW = 20
_SCHEMA = "vec_id long, component int, dims int, n long, deviation decimal(38,0), whitened double, eigenvalue double, explained double, identity_error double"


def _points(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, dims, integers as bytes) of the rows whose vector is whole."""
    for batch in rows:
        column = batch.column("embedding")
        length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry is NaN
        ends = np.cumsum(length)
        odd = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
        whole = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (odd[ends] == odd[ends - length]))
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.clip(np.nan_to_num(np.floor(flat * SCALE)), -LARGEST, LARGEST).astype(np.int64) + SHIFT
        if len(x) and np.abs(x).max() < 1 << 31:
            x = x.astype(np.int32)
        raw = [x[e - n : e].tobytes() for e, n in zip(ends[whole].tolist(), length[whole].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(whole)), pa.array(length[whole].astype(np.int32)), pa.array(raw, pa.binary())], ["vec_id", "dims", "x"])


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """Integers of a batch of one length, a row each."""
    raw = batch.column("x").to_pylist()
    if len({len(r) for r in raw}) == 1:
        return np.frombuffer(b"".join(raw), np.int32 if len(raw[0]) == 4 * dims else np.int64).reshape(len(raw), dims).astype(np.int64)
    return np.stack([np.frombuffer(r, np.int32 if len(r) == 4 * dims else np.int64).astype(np.int64) for r in raw])


def _sums(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sums of each dimension, in two halves that cannot overflow."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in rows:
            if batch.num_rows:
                x = _matrix(batch, dims)
                n, high, low = n + len(x), high + (x >> _LOW).sum(0), low + (x & ((1 << _LOW) - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array([n] * dims, pa.int64()), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    return run


def _added(points: DataFrame, dims: int, width: int, part: Callable[[np.ndarray], np.ndarray], height: int) -> np.ndarray:
    """Sum over all points of ``part`` (integers of a batch -> height x width): inside tasks first, then by row over tasks."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for batch in rows:
            if batch.num_rows:
                total += part(_matrix(batch, dims))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(height, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "part"])

    parts = points.select("x").mapInArrow(run, "i int, part array<double>")
    rows = parts.groupBy("i").agg(*[F.sum(F.col("part")[j]).alias(f"c{j}") for j in range(width)]).collect()  # height x width numbers
    out = np.zeros((height, width))
    for row in rows:
        out[row[0]] = row[1:]
    return out


def subspace(times: Callable[[np.ndarray], np.ndarray], dims: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (falling) and their unit eigenvectors (columns) of the matrix that ``times`` applies to a block."""
    q = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, min(dims, BLOCK * k))))[0]
    best, share = math.inf, 1.0
    for _ in range(ROUNDS):
        moved = times(q)
        small = q.T @ moved
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, moved = q @ turn, moved @ turn
        top = values[0]
        if top <= 0:
            return np.zeros(k), q[:, :k]
        left = np.linalg.norm(moved[:, :k] - q[:, :k] * values[:k], axis=0).max() / top
        if left <= SHARP or (left <= ENOUGH and left > best / 2) or (q.shape[1] == dims and left <= ENOUGH):
            return np.maximum(values[:k], 0), q[:, :k]
        share = 0.7 * share if left > best / 2 else share  # many directions of one eigenvalue: the block is all wanted, damp from further below
        best = min(best, left)
        cut = values[-1] * share
        if cut <= 1e-12 * top:  # nothing but rounding below the block
            q = np.linalg.qr(moved)[0]
            continue
        half = cut / 2  # the unwanted spectrum [0, cut] becomes [-1, 1]
        degree = max(2, min(DEGREE, int(math.acosh(GROWTH) / max(math.acosh(max(1.0, top / half - 1)), 1e-9))))
        before, now = q, (moved - half * q) / half
        for _ in range(degree - 1):
            before, now = now, 2 * (times(now) - half * now) / half - before
        q = np.linalg.qr(now)[0]
    raise RuntimeError(f"no certified components after {ROUNDS} rounds, residual {best:.1e}")


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums over dimensions of (n x - S)^2, a row each."""
    if not x.size:
        return [0] * len(x)
    reach = n * int(np.abs(x).max()) + max(map(abs, sums))
    if reach >= 1 << 62:
        return [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    t = np.abs(x * n - np.array(sums, np.int64))
    if int(t.max()) ** 2 * x.shape[1] < 1 << 63:
        return (t * t).sum(1).tolist()
    limb = (1 << 21) - 1
    a, b, c = t & limb, (t >> 21) & limb, t >> 42
    parts = [(a * a).sum(1), (2 * a * b).sum(1), (2 * a * c + b * b).sum(1), (2 * b * c).sum(1), (c * c).sum(1)]
    return [sum(v << (21 * i) for i, v in enumerate(row)) for row in zip(*[p.tolist() for p in parts], strict=True)]


def _fit(points: DataFrame, dims: int, k: int) -> dict:
    by_dimension = points.select("x").mapInArrow(_sums(dims), "i int, n long, high long, low long").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(20,0)")).alias("high"), F.sum(F.col("low").cast("decimal(20,0)")).alias("low")).collect()
    sums = [0] * dims
    for r in by_dimension:
        sums[r["i"]] = (int(r["high"]) << _LOW) + int(r["low"])
    n = by_dimension[0]["n"]
    mean = np.array([s / n for s in sums])

    def times(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)

        return _added(points, dims, q.shape[1], part, dims) / n

    trace = float(_added(points, dims, 1, lambda x: ((x - mean) ** 2).sum(keepdims=True), 1)[0, 0]) / n
    values, directions = subspace(times, dims, k)
    values = np.where(values > values[0] * 1e-13, values, 0.0)  # below that, rounding
    directions = directions * np.where(directions[np.abs(directions).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    found = int((values > 0).sum())
    turn = directions[:, :found] / np.sqrt(values[:found])

    def second(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ turn
        return np.vstack((white.T @ white, white.sum(0)))

    error = 0.0
    if found:
        moments = _added(points, dims, found, second, found + 1) / n
        error = float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(found)).max())
    return {"n": n, "sums": sums, "mean": mean, "values": values, "directions": directions, "trace": trace, "error": error}


def _whitened(fit: dict, dims: int, k: int):
    values, n = fit["values"], fit["n"]
    with np.errstate(divide="ignore"):
        turn = fit["directions"] * np.where(values > 0, 1 / np.sqrt(values), np.nan)
    explained = values / fit["trace"] if fit["trace"] > 0 else np.zeros(k)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            x = _matrix(batch, dims)
            each = np.repeat(np.arange(len(x)), k)
            over = [decimal.Decimal(v) if v < 10**38 else None for v in deviations(x, n, fit["sums"])]
            white = ((x - fit["mean"]) @ turn).ravel()
            fixed = lambda v, t: pa.array(np.tile(v, len(x)), t)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(each)), fixed(np.arange(1, k + 1, dtype=np.int32), pa.int32()), pa.array(np.full(len(each), dims, np.int32)),
                 pa.array(np.full(len(each), n, np.int64)), pa.array(over, pa.decimal128(38, 0)).take(pa.array(each)), pa.array(white, mask=np.isnan(white)),
                 fixed(values, pa.float64()), fixed(explained, pa.float64()), pa.array(np.full(len(each), fit["error"]))],
                [f.split()[0] for f in _SCHEMA.split(", ")])

    return run


def whitened(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per whole vector and component: vec_id, component, dims, n, deviation, whitened, eigenvalue, explained, identity_error.

    A null vector, or one with null or non-finite entries, is left out. Rows that repeat are rows of their own and weigh as such;
    a null vec_id stays null; further columns are ignored. Each vector length is a fit of its own with its own n; a length below
    ``components`` has as many components as dimensions, empty vectors have none. A component without variance (one vector, equal
    vectors, fewer directions than components) has eigenvalue and explained 0 and a null in whitened; identity_error, the largest absolute entry of
    the covariance of whitened minus the identity, then covers the others. Components of equal eigenvalues are one basis of
    their space. A deviation of 39 digits or more is null. Each component's largest entry is positive. Empty input gives no rows.
    """
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    points = written(given.mapInArrow(_points, "vec_id long, dims int, x binary"))
    out = given.sparkSession.createDataFrame([], _SCHEMA)
    for (dims,) in points.where("dims > 0").select("dims").distinct().orderBy("dims").collect():
        own, k = points.where(F.col("dims") == dims), min(components, dims)
        out = out.union(own.select("vec_id", "x").mapInArrow(_whitened(_fit(own, dims, k), dims, k), _SCHEMA))
    return out
