"""The corpus pipeline: rules, near-duplicates, secrets, mix, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; all but the last return
the columns of documents. Between stages the rows are a Parquet table: a stage's result is written before the next stage is
called in the same thread, which therefore begins by removing the intermediate tables of the one before. Those of the last stage
stay with the checkpoint folder, so a result of ``run`` can be read after any later run.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from costproof.llm import minhash, mixing, packing, quality_rules, secrets
from costproof.llm.tables import collecting, drop, written

TOKENIZER = "byte_bpe_50k.json"
#: Percent of equal five-word shingles from which documents are near-duplicates.
SIMILAR = 80
#: Tables behind results of this thread's last stage call, unless that was the last stage, whose result nobody writes here.
_LEFT: ContextVar[tuple[str, ...]] = ContextVar("left", default=())


def _stage(last: bool = False):
    def wrap(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
        @functools.wraps(fn)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            drop(spark, list(_LEFT.get()))
            with collecting() as made:
                found = fn(spark, docs, sf_dir)
            _LEFT.set(() if last else tuple(made))
            return found

        return run_stage

    return wrap


@_stage()
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules keep."""
    return quality_rules.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage()
def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return minhash.deduplicated(docs, SIMILAR)


@_stage()
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.masked(docs)


@_stage()
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


@_stage(last=True)
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, neighbours along the curve together."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality_rules", clean), ("minhash_near_dedup", deduplicated), ("secret_scan", without_secrets), ("source_mix", mix), ("curve_packing", packed)]

#: Learned rules, hashed rounding and token ids have no SQL form; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        with collecting() as now:
            docs = written(found)
        drop(spark, read)
        read = now
    return STAGES[-1][1](spark, docs, sf_dir)
