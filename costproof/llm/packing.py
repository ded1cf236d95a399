"""Packing along a space-filling curve.

A document's token ids are hashed into signed random directions and summed: a vector of ``DIMS`` numbers in which documents of
one language and subject lie together. Vectors are scaled by the means and deviations of all documents, laid on a grid
and numbered along a Hilbert curve. Documents are range-sorted by that number and laid end to end; every ``width`` ids of
the running stream are one sequence, so neighbours on the curve share sequences and nothing is padded but the tail. The
tail (less than one sequence) is cut into powers of two, which need no padding either.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from costproof.llm.bytehash import mix
from costproof.llm.tables import written
from costproof.llm.tokens import encoder

DIMS, BITS = 4, 12


def directions(size: int) -> np.ndarray:
    """A hashed direction for every token id: DIMS numbers, uniform between -1 and 1."""
    h = mix(np.arange(size * DIMS, dtype=np.uint64), 11)
    return ((h >> np.uint64(40)).astype(np.float32) / np.float32(1 << 23) - 1).reshape(size, DIMS)


def hilbert(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of points (rows) on a grid of ``2 ** bits`` cells a side, as int64."""
    x = grid.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of each level, from the top
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> bit) & 1)
    return place


def _encoded(path: str, end: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        table = directions(own.size)
        for batch in found:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                arrays = own.ids([t or "" for t in part.column("text").to_pylist()])
                n = np.fromiter((len(a) + 1 for a in arrays), np.int64, len(arrays))
                vectors = np.array([table[a].sum(0, dtype=np.float64) / max(1, len(a)) ** 0.5 for a in arrays]).reshape(-1, DIMS)
                raw = pa.array([np.append(a, a.dtype.type(end)).tobytes() for a in arrays], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *(pa.array(v) for v in vectors.T), raw], ["doc_id", "n", *_axes(), "ids"])

    return run


def _axes() -> list[str]:
    return [f"v{i}" for i in range(DIMS)]


def _places(mean: list[float], spread: list[float]):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            points = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in _axes()]).T.reshape(-1, DIMS)
            scaled = 1 / (1 + np.exp(-1.7 * np.clip((points - mean) / spread, -8, 8)))  # near the share of documents below
            grid = np.minimum((scaled * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(hilbert(grid)), *(batch.column(c) for c in ("doc_id", "row", "n"))], ["place", "doc_id", "row", "n"])

    return run


def _running(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, total = TaskContext.get().partitionId(), 0
    for batch in found:
        n = batch.column("n").to_numpy()
        ends = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int64)), batch.column("row"), pa.array(ends - n), pa.array(n)], ["part", "row", "before", "n"])
        total = int(ends[-1]) if len(ends) else total


def tail_cuts(total: int, width: int) -> list[int]:
    """Where the sequences begin that follow the last full one: the rest as descending powers of two."""
    at, cuts = total - total % width, []
    while at < total:
        cuts.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return cuts


def pieces_of(start: int, n: int, total: int, width: int, tail: list[int]) -> list[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset there) of a document that lies at ``start`` in the stream."""
    out, at, end = [], start, start + n
    full = total // width
    while at < end:
        if at < full * width:
            sequence, begin = divmod(at, width)[0], at - at % width
            stop = begin + width
        else:
            k = int(np.searchsorted(tail, at, side="right")) - 1
            sequence, begin = full + k, tail[k]
            stop = tail[k + 1] if k + 1 < len(tail) else total
        stop = min(stop, end)
        out.append((at - start, stop - at, sequence, at - begin))
        at = stop
    return out


def _cut(total: int, width: int, path: str):
    tail = tail_cuts(total, width)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(path).dtype
        for batch in found:
            docs, at, out = batch.column("doc_id").to_pylist(), batch.column("at").to_pylist(), []
            for doc, start, raw in zip(docs, at, batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(raw, dtype).astype("<u4")
                out += [(doc, a, n, zlib.crc32(ids[a : a + n].tobytes()), len(ids), s, o) for a, n, s, o in pieces_of(start, len(ids), total, width, tail)]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=_PIECE), schema=pa.schema([(c, pa.int64()) for c in _PIECE]), preserve_index=False)

    return run


_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str, width: int = 1024, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the tokenizer file at ``path`` without special tokens, then ``end``; a null text counts as empty and is
    that one id. Every id lies in exactly one piece, sequences are full but for the tail, and the tail's are powers of
    two. Rows that repeat, also by doc_id, are packed as rows of their own; equal places on the curve go by doc_id. A null
    doc_id stays null. Empty input gives no rows; further columns are ignored.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    axes = ", ".join(f"{a} double" for a in _axes())
    encoded = docs.mapInArrow(_encoded(path, end), f"doc_id long, n long, {axes}, ids binary")
    encoded = written(encoded.withColumn("row", F.monotonically_increasing_id()))
    scale = encoded.agg(*[f(a) for a in _axes() for f in (F.avg, F.stddev_pop)]).first()
    mean, spread = [v or 0.0 for v in scale[::2]], [v or 1.0 for v in scale[1::2]]
    placed = encoded.select("doc_id", "row", "n", *_axes()).mapInArrow(_places(mean, spread), "place long, doc_id long, row long, n long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["place", "doc_id", "row"]
    laid = written(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_running, "part long, row long, before long, n long"))
    sums = laid.groupBy("part").agg(F.sum("n").alias("n"))  # a row per partition of the range sort
    earlier = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("part", F.coalesce(earlier, F.lit(0)).alias("base"))
    total = laid.agg(F.sum("n")).first()[0] or 0
    starts = laid.join(written(bases), "part").select("row", (F.col("base") + F.col("before")).alias("at"))
    return encoded.select("row", "doc_id", "ids").join(written(starts), "row").select("doc_id", "at", "ids").mapInArrow(
        _cut(total, width, path), ", ".join(f"{c} long" for c in _PIECE))
