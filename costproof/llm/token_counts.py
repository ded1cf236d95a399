"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of frequent pre-tokens with their numbers of tokens, broadcast to every task. Its rows come from
all documents: each task counts pre-tokens in a bounded table and hands on its ``TOP`` most frequent, and their sums give
the ``FREQUENT`` rows of the table. Tier two is each worker's cache of the pre-tokens it has encoded itself. Which
pre-tokens are frequent changes the speed only, never a count. No occurrence of a pre-token is ever shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from costproof.llm.bytehash import batches
from costproof.llm.tokens import LONGEST, Encoder, cut, encoder

TOP, FREQUENT, COUNTED = 4096, 32_768, 200_000


def _frequent(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for batch in found:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for a, b in batches(texts):
            for text in texts[a:b]:
                counts.update(cut(text)[1:])
            if len(counts) > COUNTED:  # rare ones go; a frequent one comes back with the next batch
                counts = Counter(dict(counts.most_common(COUNTED // 4)))
    rows = [(c, n) for c, n in counts.most_common(TOP) if n > 1 and len(c) <= LONGEST]
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["token", "n"])


def frequent_pre_tokens(docs: DataFrame, path: str, rows: int = FREQUENT) -> dict[str, int]:
    """Frequent pre-tokens of a text column named text with their numbers of tokens; at most ``rows``."""
    top = docs.select("text").mapInArrow(_frequent, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    tokens = [r["token"] for r in top.orderBy(F.desc("n"), "token").limit(rows).collect()]
    own = Encoder(path)
    if own.pieces is None:
        return {}
    own.learn(tokens, own.known, True)
    return dict(own.known)


def token_counts(docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens by the tokenizer file at ``path``, over_limit (n_tokens > limit).

    A null text counts as empty: no bytes, no tokens. Rows that repeat stay rows of their own; a null doc_id stays null. Texts are
    encoded whole, without special tokens added. Empty input gives no rows; further columns are ignored.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent_pre_tokens(docs, path))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, "lengths")
        own.frequent = table.value
        for batch in found:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = pa.array(own.lengths(texts), pa.int64())
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            over = pa.array([x > limit for x in n.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, n, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
