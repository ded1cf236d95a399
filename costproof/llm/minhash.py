"""MinHash near-duplicates: fast similarity sketching, banding, exact verification.

The sketch has ``BANDS * ROWS`` bins. In round i every shingle throws itself into one hashed bin with the value (i, hash);
a bin keeps its smallest value. After as many rounds as bins, round i puts every shingle into bin i, so each bin is
filled after twice that many rounds at most; with many shingles one or two rounds are enough. Two sketches agree in a
bin with the probability of the sets' Jaccard similarity, concentrated as with independent hash functions.

Documents with equal shingle sets form one class. Classes that share a band (``ROWS`` bins) are candidates; a pair at a
similarity of 0.85 shares none of the bands with a probability under 1e-6. No bucket emits all its pairs unless it is small:

1. A bucket pairs its members with its hub, the member that meets most others over all bands. In a bucket of at most
   ``SMALL`` members all pairs are candidates.
2. Candidates pass a size test and an estimate from the sketches, eight standard deviations below the threshold; then both
   whole texts are compared exactly.
3. Large buckets whose members are not all in one component yet go on: members outside the hub's component are compared
   exactly with all members, block against block, and a pair of blocks hands on no more links than it needs to connect its
   rows. Blocks are bounded in rows and shingles, however large a bucket is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from costproof.llm.bytehash import batches, mix, shingles
from costproof.llm.components import components
from costproof.llm.tables import written

BANDS, ROWS, SMALL = 26, 5, 8
#: Smallest similarity in percent: below it the bands would miss more than a pair in 30,000.
LEAST = 80
BINS = BANDS * ROWS
#: Rows and shingles of a block, and columns of a block's incidence matrix held at once.
BLOCK_ROWS, BLOCK_ITEMS, COLUMNS = 512, 1 << 19, 4096


def sketch(items: np.ndarray) -> np.ndarray:
    """The fast similarity sketch of distinct 64-bit hashes: BINS values, the round in the top byte."""
    bins = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    rounds, n = 0, len(items)
    while rounds < BINS and bins.max() == np.iinfo(np.uint64).max:
        step = min(BINS - rounds, max(1, 1024 // n))  # small sets throw in several rounds at once; later rounds never win
        for_round = np.arange(rounds, rounds + step, dtype=np.uint64)[:, None]
        h = mix(items[None, :] ^ mix(for_round, 1), 2)
        place = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
        value = (for_round << np.uint64(56)) | (mix(h, 3) >> np.uint64(8))
        np.minimum.at(bins, place.ravel(), value.ravel())
        rounds += step
    for i in np.flatnonzero(bins == np.iinfo(np.uint64).max):  # the second half: every shingle into this one bin
        bins[i] = (np.uint64(min(255, BINS + i)) << np.uint64(56)) | (mix(items ^ np.uint64(i), 4) >> np.uint64(8)).min()
    return bins


def set_key(items: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    parts = np.array([mix(items, 5).sum(dtype=np.uint64), mix(items, 6).sum(dtype=np.uint64) + np.uint64(len(items))], np.uint64)
    return parts.tobytes()


def _bands(bins: np.ndarray) -> np.ndarray:
    h = mix(np.arange(BANDS, dtype=np.uint64), 7)
    for column in bins.reshape(BANDS, ROWS).T:
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + column, 8)
    return h.view(np.int64)


def _features(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        n, keys, marks, bands = [], [], [], []
        for a, b in batches(texts):
            for items in shingles(texts[a:b]):
                n.append(len(items))
                if len(items):
                    bins = sketch(items)
                    keys.append(set_key(items))
                    marks.append(mix(bins, 9).astype(np.uint8).tobytes())
                    bands.append(_bands(bins).tolist())
                else:
                    keys.append(None), marks.append(None), bands.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("print"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "print", "n", "cls", "marks", "bands"])


@F.pandas_udf(T.IntegerType())
def _equal_bins(a: pd.Series, b: pd.Series) -> pd.Series:
    if a.empty:
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, BINS) for s in (a, b))
    return pd.Series((x == y).sum(1, dtype=np.int32))


def _confirmed(percent: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        for batch in found:
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")]
            keep = []
            if len(held) > 64:
                held.clear()
            missing = {k: t.encode() for k, t in [*zip(columns[0], columns[2]), *zip(columns[1], columns[3])] if k not in held}
            for row, (a, b, *_) in enumerate(zip(*columns)):
                for k in (a, b):
                    if k not in held:  # a run of rows has the same first text
                        held[k] = shingles([missing[k]])[0]
                x, y = held[a], held[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if set_key(x) == a and set_key(y) == b and 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(row)
                if b != a and len(held) > 4096:
                    held.pop(b, None)
            yield pa.RecordBatch.from_arrays([pa.array([c[r] for r in keep], pa.binary()) for c in columns[:2]], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs without white space, A-Z lower-cased; a document's set has its distinct 5-word shingles, or its whole
    word sequence when it has fewer. Rows link when ``100 * intersection >= percent * union``; component_id is the
    smallest doc_id that links reach, kept marks the row that carries it.

    A null or wordless text has no shingles and links with nothing. A null doc_id gets the component of an equal text, if
    any, is never kept and links nothing further. Rows that repeat a doc_id are rows of their own and kept alike. Empty
    input gives no rows; further columns of ``docs`` are ignored. Shingles are 64-bit hashes, sets 128-bit keys.
    """
    if percent < LEAST:
        raise ValueError(f"the bands find pairs from {LEAST} percent on")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("print"))
    features = written(docs.mapInArrow(_features, "doc_id long, print long, n long, cls binary, marks binary, bands array<long>"))
    first = F.min_by(F.struct("print", "n", "marks", "bands"), F.struct("doc_id", "print")).alias("f")  # a text of the class, also where a doc_id has several
    classes = written(features.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), first).select("cls", "doc_id", "f.*"))
    labels = classes.select("cls", F.col("doc_id").alias("component_id"))
    links = _links(docs, classes, percent)
    if links is not None:
        rooted = written(components(links)).withColumnRenamed("node", "cls")
        lowest = written(rooted.join(labels, "cls").groupBy("root").agg(F.min("component_id").alias("lowest")))
        reached = written(rooted.join(lowest, "root").select("cls", "lowest"))
        labels = labels.join(reached, "cls", "left").select("cls", F.coalesce("lowest", "component_id").alias("component_id"))
    joined = features.where("n > 0").select("doc_id", "n", "cls").join(written(labels), "cls", "left").select("doc_id", "n", "component_id")
    empty = features.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return joined.union(empty).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, and of equal rows one; a row without doc_id stays if no equal text has one."""
    found = written(near_duplicates(docs, percent, doc_id, text))
    kept = found.where("kept").select(F.col("doc_id").alias("__id")).distinct()
    named = docs.join(kept, F.col(doc_id).cast("long") == F.col("__id"), "left_semi")
    out = named.groupBy(F.col(doc_id).alias("__id"), F.xxhash64(F.col(text)).alias("__hash")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row")).select("__row.*")
    nameless = docs.where(F.col(doc_id).isNull())
    if nameless.isEmpty():
        return out
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(text).alias("__text")).distinct()
    return out.union(nameless.dropDuplicates([text]).join(texts, F.col(text).eqNullSafe(F.col("__text")), "left_anti"))


def _links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame | None:
    """Confirmed links (a, b) between classes whose components are those of all links; None without any."""
    members = classes.select("cls", "n", F.explode("bands").alias("key"))
    sizes = written(members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("items")).where("size > 1"))
    grouped = written(members.join(sizes, "key"))
    met = written(grouped.groupBy("cls").agg(F.sum("size").alias("met")))
    hubs = grouped.join(met, "cls").groupBy("key").agg(F.max(F.struct("met", "cls"))["cls"].alias("hub"))
    grouped = written(grouped.join(written(hubs), "key"))
    stars = grouped.where("cls <> hub").select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b"))
    near = grouped.where((F.col("size") > 2) & (F.col("size") <= SMALL))
    every = near.select("key", F.col("cls").alias("a")).join(near.select("key", F.col("cls").alias("b")), "key").where("a < b").select("a", "b")
    likely = written(_likely(classes, stars.union(every).distinct(), percent))
    large = grouped.where(F.col("size") > SMALL)
    needed = likely.select(F.col("a").alias("cls")).union(likely.select(F.col("b").alias("cls"))).union(large.select("cls")).distinct()
    needed = written(needed.join(classes.select("cls", "doc_id", "print"), "cls"))
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id", "print"])  # one text a class, however often a row repeats
    texts = written(once.join(needed.hint("merge"), ["doc_id", "print"]).select("cls", "text"))  # their number grows with the input: one shuffle at every size
    links = written(_confirm(likely, texts, percent))
    if not large.isEmpty():
        links = _rest(large, links, texts, percent)
    return None if links.isEmpty() else links


def _rest(large: DataFrame, links: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``links`` and those that large buckets still miss."""
    if not links.isEmpty():
        root = written(components(links))
        for c in ("cls", "hub"):
            own = root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
            large = large.join(own, c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
        large = large.withColumn("outside", F.col("root_cls") != F.col("root_hub"))
    else:
        large = large.withColumn("outside", F.col("cls") != F.col("hub"))
    large = written(large.select("key", "cls", "n", "size", "items", "outside"))
    left = written(large.where("outside").groupBy("key").agg(F.count(F.lit(1)).alias("rows_out"), F.sum("n").alias("items_out")))
    if left.isEmpty():
        return links
    blocks = lambda rows, items: F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(items) / BLOCK_ITEMS)).cast("int")
    again = large.join(left, "key").withColumn("q_blocks", blocks("rows_out", "items_out")).withColumn("d_blocks", blocks("size", "items"))
    again = again.withColumn("at", F.xxhash64("cls"))
    full = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    query = again.where("outside").select("key", "cls", F.pmod("at", "q_blocks").alias("q"), full("d_blocks").alias("d"), F.lit(True).alias("asks"))
    data = again.select("key", "cls", F.pmod("at", "d_blocks").alias("d"), full("q_blocks").alias("q"), F.lit(False).alias("asks"))
    rows = query.select("key", "q", "d", "cls", "asks").union(data.select("key", "q", "d", "cls", "asks")).join(texts, "cls")
    found = rows.groupBy("key", "q", "d").applyInPandas(_compared(percent), "a binary, b binary")
    return written(links.union(found).distinct())


def _compared(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["cls", "asks"])
        keys, sets = list(rows["cls"]), []
        texts = [t.encode() for t in rows["text"]]
        for a, b in batches(texts):
            sets += shingles(texts[a:b])
        true = np.array([set_key(x) == bytes(k) for x, k in zip(sets, keys)], bool)  # another row of a repeated doc_id
        asks = rows["asks"].to_numpy(bool)
        q, d = np.flatnonzero(asks & true), np.flatnonzero(~asks & true)
        n, parent, out = np.array([len(x) for x in sets]), {}, []
        if not len(q) or not len(d):
            return pd.DataFrame({"a": [], "b": []})

        def top(k: bytes) -> bytes:
            while (up := parent.setdefault(k, k)) != k:
                parent[k] = parent[up] if up in parent else up
                k = up
            return k

        both = _shared([sets[i] for i in q], [sets[i] for i in d])
        for i, j in zip(*np.nonzero(100 * both >= percent * (n[q][:, None] + n[d][None, :] - both)), strict=True):
            a, b = keys[q[i]], keys[d[j]]
            if (x := top(a)) != (y := top(b)):
                parent[x] = y
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as products of their incidence matrices."""
    flat = [np.concatenate(x) for x in (left, right)]
    known = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    at = [(np.repeat(np.arange(len(x)), [len(s) for s in x]), np.searchsorted(known, f), f) for x, f in zip((left, right), flat)]
    for start in range(0, len(known), COLUMNS):
        held = []
        for size, (row, place, f) in zip((len(left), len(right)), at, strict=True):
            inside = (place >= start) & (place < min(start + COLUMNS, len(known)))
            inside[inside] = known[place[inside]] == f[inside]
            marks = np.zeros((size, COLUMNS), np.float32)
            marks[row[inside], place[inside] - start] = 1
            held.append(marks)
        out += held[0] @ held[1].T
    return out.astype(np.int64)


def _likely(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the candidate pairs that sizes and sketches do not exclude."""
    for c in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("marks").alias(f"marks_{c}")), c)
    enough = int(BINS * (percent / 100 - 8 * (percent / 100 * (1 - percent / 100) / BINS) ** 0.5))
    near = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).where(_equal_bins("marks_a", "marks_b") >= enough)
    return near.select("a", "b")


def _confirm(likely: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the candidate pairs whose whole texts link."""
    both = likely.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(percent), "a binary, b binary")
