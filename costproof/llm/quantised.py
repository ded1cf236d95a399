"""Embedding near-duplicates: inverted lists with residual product quantisation, exact cosine rerank.

Equal vectors of a label form one class. Unit vectors go to the inverted list of their nearest coarse centroid, coded by the
nearest codeword of their residual in each of ``SUBSPACES`` parts, with the length of what the code leaves out. A vector is
compared with the stored vectors of its own list and of every list whose boundary with its own (the plane between both centroids)
is at most half of ``reach`` away. Linked vectors are at most ``reach`` apart, so of two on both sides of a plane one is that
near to it, and none are missed; when both are, the one of the lower list asks. Distances come
from a table of the query's residual against all codewords; what they cannot exclude, given what each code leaves out, is
compared exactly, in double precision.

Every vector length has an index of its own, fitted on a sample of its own; lengths beyond the ``LENGTHS`` most frequent are one list
without codes, compared exactly. Lists are cut into blocks of bounded size on both sides, so a list that holds a third of all
vectors is many tasks. A pair of blocks returns numbers of links per class and only as many links as connect its classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from costproof.llm.bytehash import mix
from costproof.llm.components import components
from costproof.llm.tables import written

#: Rows that an index is fitted on (smallest key first), lists, parts, codewords of a part, rows of a block.
SAMPLE, LISTS, SUBSPACES, CODES, BLOCK = 8192, 64, 8, 128, 1024
#: Vector lengths with an index.
LENGTHS = 16


def _read(vectors: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in vectors:
        keys, raws, dims = [], [], []
        for label, v in zip(batch.column("label").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            x = np.array(v, np.float64) if v is not None and label is not None and None not in v else np.zeros(0)
            if not len(x) or not np.isfinite(x).all() or not (norm := np.linalg.norm(x)) > 0 or not np.isfinite(norm):
                keys.append(None), raws.append(None), dims.append(0)
                continue
            words = np.append(x + 0.0, 0.0).view(np.uint64)
            words[-1] = hash(label) & 0xFFFFFFFFFFFFFFFF
            at = mix(np.arange(len(words), dtype=np.uint64), 21)
            keys.append(np.array([mix(words ^ at, s).sum(dtype=np.uint64) for s in (22, 23)], np.uint64).tobytes())
            raws.append(x.tobytes()), dims.append(len(x))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(raws, pa.binary()), pa.array(dims, pa.int32())],
                                         ["vec_id", "label", "key", "raw", "dims"])


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)


def _means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spaced rows; empty centres keep their place."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, d], len(centres)) for d in range(x.shape[1])], axis=1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(sample: np.ndarray) -> dict:
    """Coarse centroids and codewords from unit vectors (rows)."""
    coarse = _means(sample, LISTS)
    rest = sample - coarse[_nearest(sample, coarse)]
    parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
    return {"coarse": coarse, "parts": parts, "words": [_means(rest[:, p], CODES) for p in parts]}


def _whole(dims: int) -> dict:
    """One list and one codeword, both zero: excludes no pair."""
    return {"coarse": np.zeros((1, dims)), "parts": [np.arange(dims)], "words": [np.zeros((1, dims))]}


def _placed(indexes: dict[int, dict], reach: float):
    """(key, label, dims, raw) -> rows for the side that asks (one for each list probed) and the side that is stored."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mixed in rows:
            dims = mixed.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                yield placed(mixed.filter(pa.array(dims == d)), indexes.get(d) or _whole(d))

    def placed(batch: pa.RecordBatch, index: dict) -> pa.RecordBatch:
        coarse = index["coarse"]
        between = np.sqrt(np.maximum(((coarse[:, None] - coarse[None]) ** 2).sum(2), 1e-12))
        x = np.frombuffer(b"".join(batch.column("raw").to_pylist())).reshape(batch.num_rows, -1)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        away = ((unit[:, None] - coarse[None]) ** 2).sum(2)
        own = away.argmin(1)
        probed = away - away[np.arange(len(own)), own][:, None] <= reach * between[own] + 1e-9  # twice the distance to the plane, times between
        rest, left, codes = unit - coarse[own], np.zeros(len(own)), []
        for part, words in zip(index["parts"], index["words"], strict=True):
            code = _nearest(rest[:, part], words)
            codes.append(code)
            left += ((rest[:, part] - words[code]) ** 2).sum(1)
        raw = np.stack(codes, 1).astype(np.uint8)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("key", "label", "dims", "copies", "raw")), pa.array(own.astype(np.int32)), pa.array([r.tobytes() for r in raw], pa.binary()),
             pa.array(np.sqrt(left)), pa.array([np.flatnonzero(p).astype(np.int32).tolist() for p in probed], pa.list_(pa.int32()))],
            ["key", "label", "dims", "copies", "raw", "list", "code", "left", "probes"])

    return run


def _linked(indexes: dict[int, dict], least: float, reach: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy(bool)
        q, s = rows[asks].reset_index(drop=True), rows[~asks].reset_index(drop=True)
        none = pd.DataFrame({"a": [], "b": [], "n": []})
        if not len(q) or not len(s):
            return none
        at, dims = int(s["list"].iloc[0]), int(s["dims"].iloc[0])
        index = indexes.get(dims) or _whole(dims)
        x, y = (np.frombuffer(b"".join(t["raw"])).reshape(len(t), -1) for t in (q, s))
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        unit = x / nx[:, None] - index["coarse"][at]
        codes = np.frombuffer(b"".join(s["code"]), np.uint8).reshape(len(s), -1)
        far = np.zeros((len(q), len(s)))
        for k, (part, words) in enumerate(zip(index["parts"], index["words"], strict=True)):
            table = ((unit[:, part][:, None] - words[None]) ** 2).sum(2)  # distances of a part to all its codewords
            far += table[:, codes[:, k]]
        keys = [np.frombuffer(b"".join(t["key"]), "S16") for t in (q, s)]
        maybe = np.sqrt(far) <= reach + s["left"].to_numpy()[None] + 1e-9
        own, back = q["list"].to_numpy(), np.zeros((len(s), LISTS), bool)
        for row, lists in enumerate(s["probes"]):
            back[row, lists] = True
        once = np.where((own == at)[:, None], keys[0][:, None] < keys[1][None], (own < at)[:, None] | ~back.T[own])
        maybe &= once  # inside a list and across lists every pair once
        i, j = np.nonzero(maybe)
        ok = np.zeros(len(i), bool)
        for b in range(0, len(i), 1 << 15):
            p, r = i[b : b + (1 << 15)], j[b : b + (1 << 15)]
            ok[b : b + (1 << 15)] = (x[p] * y[r]).sum(1) / (nx[p] * ny[r]) >= least
        i, j = i[ok], j[ok]
        if not len(i):
            return none
        kq, ks, cq, cs = list(q["key"]), list(s["key"]), q["copies"].to_numpy(), s["copies"].to_numpy()
        out = [(kq[k], None, n) for k, n in enumerate(np.bincount(i, cs[j], len(kq)).astype(int)) if n]
        out += [(ks[k], None, n) for k, n in enumerate(np.bincount(j, cq[i], len(ks)).astype(int)) if n]
        parent = list(range(len(kq) + len(ks)))

        def top(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for a, b in zip(i.tolist(), (j + len(kq)).tolist(), strict=True):
            if (u := top(a)) != (v := top(b)):
                parent[u] = v
                out.append((kq[a], ks[b - len(kq)], 0))
        return pd.DataFrame(out, columns=["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.93, sample: int = SAMPLE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other vectors linked), component_id, kept.

    Vectors of one label link when their cosine is ``least`` or more. A null label, a null or zero vector, null or non-finite components
    link with nothing; vectors of different lengths do not link. Equal vectors are linked copies of one class. A
    null vec_id counts as a vector, but names no component and is not kept; a component without any vec_id has a null
    component_id. Empty input gives no rows; further columns are ignored.
    """
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = written(given.mapInArrow(_read, "vec_id long, label long, key binary, raw binary, dims int"))
    classes = written(rows.where("key is not null").groupBy("key").agg(
        F.first("label").alias("label"), F.first("raw").alias("raw"), F.first("dims").alias("dims"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("lowest")))
    reach, indexes = (2 - 2 * least) ** 0.5, {}
    for (dims,) in classes.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(LENGTHS).select("dims").collect():
        seen = classes.where(F.col("dims") == dims).select("key", "raw").orderBy("key").limit(sample).collect()
        x = np.stack([np.frombuffer(r["raw"]) for r in seen])
        indexes[dims] = fit(x / np.linalg.norm(x, axis=1, keepdims=True))
    links = written(_block_links(classes, indexes, least, reach))
    counts = links.where("n > 0").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    edges = links.where("b is not null").select("a", "b").distinct()
    own = classes.select("key", "copies", "lowest").join(counts, "key", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("n", F.lit(0)))
    own = own.withColumn("component_id", F.col("lowest"))
    if not edges.isEmpty():
        rooted = written(components(edges)).withColumnRenamed("node", "key")
        smallest = written(rooted.join(classes.select("key", "lowest"), "key").groupBy("root").agg(F.min("lowest").alias("least")))
        reached = written(rooted.join(smallest, "root").select("key", F.col("least").alias("reached")))
        own = own.join(reached, "key", "left").withColumn("component_id", F.coalesce("reached", "lowest"))
    own = written(own.select("key", "n_links", "component_id"))
    linked = rows.where("key is not null").select("vec_id", "key").join(own, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _block_links(classes: DataFrame, indexes: dict[int, dict], least: float, reach: float) -> DataFrame:
    """(a, null, n): links of a class found in a pair of blocks; (a, b, 0): links that connect them."""
    placed = classes.select("key", "label", "dims", "copies", "raw").mapInArrow(
        _placed(indexes, reach), "key binary, label long, dims int, copies long, raw binary, list int, code binary, left double, probes array<int>")
    placed = written(placed)
    asked = placed.select("key", "label", "dims", "copies", "raw", "list", F.explode("probes").alias("at"))
    stored = placed.select("key", "label", "dims", "copies", "raw", "list", "code", "left", "probes", F.col("list").alias("at"))
    blocks = lambda df, n: df.groupBy("label", "dims", "at").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n))
    sizes = written(blocks(asked, "q_blocks").join(blocks(stored, "s_blocks"), ["label", "dims", "at"]))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pick = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    columns = ["label", "dims", "at", "q", "s", "key", "copies", "raw", "list", "code", "left", "probes", "asks"]
    one = asked.join(sizes, ["label", "dims", "at"]).withColumn("q", pick("q_blocks")).withColumn("s", spread("s_blocks"))
    one = one.withColumns({"asks": F.lit(True), "code": F.lit(None).cast("binary"), "left": F.lit(0.0), "probes": F.lit(None).cast("array<int>")}).select(*columns)
    two = stored.join(sizes, ["label", "dims", "at"]).withColumn("s", pick("s_blocks")).withColumn("q", spread("q_blocks")).withColumn("asks", F.lit(False)).select(*columns)
    return one.union(two).groupBy("label", "dims", "at", "q", "s").applyInPandas(_linked(indexes, least, reach), "a binary, b binary, n long")
