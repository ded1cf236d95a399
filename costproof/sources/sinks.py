"""Result sinks: correction lines, rename manifest and partitioned result tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

MARKER, BUCKET = "_current.json", "project_bucket"


def correction_lines(corrections: DataFrame) -> DataFrame:
    """One JSON line (value) per correction; absent values are left out."""
    return corrections.select(F.to_json(F.struct(*corrections.columns), {"ignoreNullFields": "true"}).alias("value"))


def write_corrections(corrections: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; absent values are left out of a record."""
    correction_lines(corrections).write.mode(mode).text(path)


def _manifest(renames: DataFrame) -> list[Column]:
    return [F.col("old_name").alias("alter Name"), F.col("new_name").alias("neuer Name"), F.col("note").alias("Hinweis")]


_CSV = {"sep": ";", "emptyValue": ""}


def rename_lines(renames: DataFrame) -> DataFrame:
    """The manifest's lines (value) without its header."""
    return renames.select(F.to_csv(F.struct(*_manifest(renames)), _CSV).alias("value"))


def write_rename_manifest(renames: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``alter Name;neuer Name;Hinweis`` per file."""
    renames.select(*_manifest(renames)).write.mode(mode).options(header="true", **_CSV).csv(path)


def project_bucket(buckets: int) -> Column:
    """The bucket of a row's project; a reader prunes with the same expression."""
    return F.pmod(F.xxhash64("project_id"), F.lit(buckets)).cast("int")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _committed(spark: SparkSession, path: str) -> dict:
    """What the marker names: {table: {"schema": JSON, "buckets": number or null, "runs": {bucket: run}}}; nothing before the first commit."""
    jvm, fs = _file_system(spark, path)
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/{MARKER}")
    if not fs.exists(marker):
        return {}
    stream = fs.open(marker)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, run: str, state: dict) -> None:
    """The marker changes in one rename: readers see the state before or the one after."""
    jvm, fs = _file_system(spark, path)
    new, marker = (jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in (f"_{run}.json", MARKER))
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    renames = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    renames[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, marker, renames)


def write_result_tables(tables: dict[str, DataFrame], path: str, buckets: int = 256, run: str | None = None, only: Sequence[int] | None = None) -> str:
    """Each table as parquet in a folder of this run, split into a fixed number of project buckets; returns the run's name.

    Nothing counts until the marker names it, and the marker changes once, when all tables are written: a write that fails leaves
    the old tables, one that is repeated under the same ``run`` gives the same state. ``only`` rewrites some buckets and keeps the others of earlier
    runs; tables without project_id are always whole. Folders of runs that the marker no longer names may be removed at any time.

    A directory per project would mean millions of small files; a bucket keeps a project's rows
    in one directory. Rows spread over all tasks, so the largest project does not become one file written by one task.
    """
    run = run or uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    state = _committed(spark, path)
    for name, df in tables.items():
        target = f"{path}/runs/{run}/{name}"
        if "project_id" not in df.columns:
            df.write.mode("overwrite").parquet(target)
            state[name] = {"schema": df.schema.json(), "buckets": None, "runs": {"0": run}}
            continue
        before = state.get(name)
        if only is not None and (before is None or before["buckets"] != buckets or before["schema"] != df.schema.json()):
            raise ValueError(f"{name} has no earlier buckets of this form to keep")
        bucketed = df.withColumn(BUCKET, project_bucket(buckets))
        if only is not None:
            bucketed = bucketed.where(F.col(BUCKET).isin(list(only)))
        bucketed.write.mode("overwrite").partitionBy(BUCKET).parquet(target)
        kept = {} if only is None else before["runs"]
        state[name] = {"schema": df.schema.json(), "buckets": buckets, "runs": kept | {str(b): run for b in (range(buckets) if only is None else only)}}
    _commit(spark, path, run, state)
    return run


def read_result_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table as the last complete write left it."""
    table = _committed(spark, path)[name]
    schema = StructType.fromJson(json.loads(table["schema"]))
    if table["buckets"] is None:
        return spark.read.schema(schema).parquet(f"{path}/runs/{table['runs']['0']}/{name}")
    by_run: dict[str, list[int]] = {}
    for bucket, run in table["runs"].items():
        by_run.setdefault(run, []).append(int(bucket))
    parts = [
        spark.read.schema(StructType([*schema.fields, StructField(BUCKET, IntegerType())])).parquet(f"{path}/runs/{run}/{name}").where(F.col(BUCKET).isin(own)).drop(BUCKET)
        for run, own in sorted(by_run.items())]
    return reduce(DataFrame.unionByName, parts)
