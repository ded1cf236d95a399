"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: its distinct words hashed into ``WORDS`` places with the logarithm of their counts, scaled to unit
length, then shares and means of its structure, then its declared length. The score is a logistic function of a
bias, linear weights and low-rank pairwise interactions, in linear time: the pairs' sum is half the difference of
(sum v x)^2 and sum (v x)^2 for each of ``RANK`` factors.

Weights are fitted by AdaGrad on at most ``TRAIN`` labelled rows and ``TRAIN_BYTES`` bytes, those of the smallest id hash, whose features are gathered; scoring runs
where the documents are, with the weights (a fixed number) broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from costproof.llm.bytehash import batches, words

BITS, RANK, TRAIN, TRAIN_BYTES, EPOCHS, BATCH, RATE, DECAY = 15, 8, 12_000, 64 << 20, 6, 128, 0.08, 1e-4
WORDS = 1 << BITS
STRUCTURE = ["log_words", "word_bytes", "symbols", "exclaims", "capitals", "digits", "words_per_line", "distinct", "repeats", "other_bytes", "bars"]
META = ["log_chars", "chars_missing"]
SIZE = WORDS + len(STRUCTURE) + len(META)
_SETS = {"symbols": b"#*$%&|<>", "exclaims": b"!", "capitals": bytes(range(65, 91)), "digits": b"0123456789", "lines": b"\n", "other": bytes(range(128, 256)), "bars": b"|"}


def features(texts: list[bytes], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of the non-zero features, rows ascending."""
    n = len(texts)
    hashes, first = words(texts, lower=False)
    row = np.repeat(np.arange(n), np.diff(first))
    keys, counts = np.unique((row.astype(np.uint64) << np.uint64(BITS)) | (hashes >> np.uint64(64 - BITS)), return_counts=True)
    rows, place = (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64(WORDS - 1)).astype(np.int64)
    value = np.log1p(counts)
    value /= np.sqrt(np.bincount(rows, value * value, n))[rows]
    size = np.fromiter(map(len, texts), np.int64, n)
    buffer, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size)
    count = {}
    for name, of in _SETS.items():
        table = np.zeros(256, np.int64)
        table[list(of)] = 1
        sums = np.concatenate(([0], np.cumsum(table[buffer])))
        count[name] = (sums[ends] - sums[ends - size]).astype(float)
    w = np.diff(first).astype(float)
    per = lambda a, b: a / np.maximum(b, 1)
    again = np.bincount(row[1:][(hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])], minlength=n) if len(row) else np.zeros(n)
    dense = np.stack([
        np.log1p(w) / 8, np.minimum(per(size, w), 40) / 20, np.minimum(per(count["symbols"], w), 3), np.minimum(per(count["exclaims"], w), 3), per(count["capitals"], size),
        per(count["digits"], size), np.log1p(per(w, count["lines"] + 1)) / 4, per(np.bincount(rows, minlength=n), w), per(again, w), per(count["other"], size),
        np.minimum(per(count["bars"], w), 1), np.log1p([max(0, c or 0) for c in n_chars]) / 10, [float(c is None) for c in n_chars]], axis=1)
    at = np.broadcast_to(np.arange(WORDS, SIZE), dense.shape)
    rows = np.concatenate((rows, np.repeat(np.arange(n), dense.shape[1])))
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate((place, at.ravel()))[order], np.concatenate((value, dense.ravel()))[order].astype(np.float32)


def margins(model: dict, n: int, row: np.ndarray, place: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score before the logistic function, factor sums) of each row."""
    vx = model["v"][place] * value[:, None]
    starts = np.searchsorted(row, np.arange(n))
    both = np.add.reduceat(np.concatenate((vx, vx * vx, (model["w"][place] * value)[:, None]), axis=1), starts, axis=0)  # every row has dense features
    sums, squares = both[:, :RANK], both[:, RANK : 2 * RANK]
    return model["b"] + both[:, -1] + 0.5 * (sums * sums - squares).sum(1), sums


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> dict:
    """Weights from (places, values) and labels of each row."""
    seed = np.random.default_rng(7)
    model = {"b": np.float32(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else np.float32(0.0), "w": np.zeros(SIZE, np.float32), "v": seed.normal(0, 0.05, (SIZE, RANK)).astype(np.float32)}
    seen = {"w": np.full(SIZE, 1e-4, np.float32), "v": np.full((SIZE, RANK), 1e-4, np.float32)}
    for _ in range(EPOCHS if 0 < y.sum() < len(y) else 0):
        order = seed.permutation(len(y))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            row = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            place, value = (np.concatenate([rows[i][k] for i in part]) for k in (0, 1))
            score, sums = margins(model, len(part), row, place, value)
            error = ((1 / (1 + np.exp(-score)) - y[part]) / len(part)).astype(np.float32)
            model["b"] -= np.float32(RATE * error.sum())
            e = error[row] * value
            used, back = np.unique(place, return_inverse=True)
            gradient = {"w": np.bincount(back, e, len(used))}
            each = e[:, None] * (sums[row] - model["v"][place] * value[:, None])
            gradient["v"] = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(RANK)], axis=1)
            for k, g in gradient.items():
                g = (g + DECAY * model[k][used] / len(order)).astype(np.float32)
                seen[k][used] += g * g
                model[k][used] -= RATE * g / np.sqrt(seen[k][used])
    return model


def _sparse(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        chars, y = batch.column("n_chars").to_pylist(), batch.column("quality")
        for a, b in batches(texts):
            row, place, value = features(texts[a:b], chars[a:b])
            cuts = np.searchsorted(row, np.arange(b - a + 1))
            yield pa.RecordBatch.from_arrays([
                y.slice(a, b - a), pa.array([place[i:j].astype(np.int32).tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
                pa.array([value[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())], ["quality", "place", "value"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN) -> dict:
    """Weights from documents (doc_id, text, n_chars) and labels (doc_id, quality), held-out rows left out.

    At most ``rows`` labelled ids and ``TRAIN_BYTES`` bytes of their texts, in the order of the ids' hashes; one row of each id, its shortest text.
    """
    usable = labels.where("quality is not null and doc_id is not null").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    named = docs.join(chosen, "doc_id")
    sizes = named.groupBy("doc_id").agg(F.min(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))  # at most ``rows`` rows, as from here on
    within = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)) <= TRAIN_BYTES
    fitting = sizes.where(F.col("size") <= TRAIN_BYTES).withColumn("within", within).where("within").select("doc_id")
    once = named.join(fitting, "doc_id").groupBy("doc_id", "quality").agg(
        F.min_by(F.struct("text", "n_chars"), F.struct(F.coalesce(F.octet_length("text"), F.lit(0)), F.xxhash64("text", "n_chars"))).alias("d"))
    marked = once.select("d.text", "d.n_chars", "quality").mapInArrow(_sparse, "quality int, place binary, value binary")
    found = sorted(marked.collect(), key=lambda r: (r["quality"], r["place"], r["value"]))  # the same order in every run
    return fit([(np.frombuffer(r["place"], np.int32), np.frombuffer(r["value"], np.float32)) for r in found], np.array([r["quality"] for r in found], np.float32))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold).

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out: their labels are never read for learning. Only text and n_chars enter a score. A
    null or empty text is scored by its structure (no words). A null doc_id stays null and is not held out; repeated rows
    are rows of their own; a doc_id that labels repeat counts once, with its lower label. Without labels of both kinds the
    score is the base rate, or one half. Further columns are ignored.
    """
    chars = F.col(n_chars).cast("long") if n_chars else F.lit(None).cast("long")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), chars.alias("n_chars"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            chars, scores = batch.column("n_chars").to_pylist(), []
            for a, b in batches(texts, 1 << 21):
                score = margins(model.value, b - a, *features(texts[a:b], chars[a:b]))[0]
                scores.append(1 / (1 + np.exp(-score.astype(np.float64))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return docs.mapInArrow(run, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
