"""Typed readers for extracted records, project settings and job logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from costproof import schemas
from costproof.functions.text import truncate_name
from costproof.scale import rank_within
from costproof.session import materialize


_LENIENT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def read_extractions(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, positions, rejected) from JSON lines of extracted invoices or offers.

    Unreadable lines, records without a mandatory value and offers whose binding line lacks a
    total go to ``rejected`` with a reason; nothing is dropped. ``short_name`` is the printed form of a description.
    """
    schema, _ = schemas.extraction(kind)
    raw = spark.read.schema(schema.add("_corrupt", "string")).options(**_LENIENT).json(path)
    return judge_extractions(raw, kind)


def parse_extractions(lines: DataFrame, kind: str) -> DataFrame:
    """Records of JSON lines (value), with _corrupt where a line is none. A generator parses: no filter or column behind it moves
    before it, so that a line is made and parsed once, not once for each column that a condition names."""
    schema, _ = schemas.extraction(kind)
    return lines.select(F.inline(F.array(F.from_json("value", schema.add("_corrupt", "string"), _LENIENT))))


def judge_extractions(raw: DataFrame, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, positions, rejected) of parsed records, as ``read_extractions`` returns them."""
    schema, required = schemas.extraction(kind)
    key = f"{kind}_id"
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in required]))
    empty = F.array().cast(schema["positions"].dataType)
    untotalled = F.lit(False) if kind == "invoice" else F.exists(
        F.coalesce("positions", empty), lambda p: ~F.coalesce(p["optional"], F.lit(False)) & p["line_total_net"].isNull())
    if kind == "invoice":
        untotalled = F.exists(F.coalesce("positions", empty), lambda p: p["line_total_net"].isNull())
    reason = (
        F.when(F.col("_corrupt").isNotNull(), "unreadable record")
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
        .when(untotalled, "binding position without total"))
    judged = raw.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull())
    rejected = judged.where(F.col("reason").isNotNull()).select(key, "reason", F.coalesce("_corrupt", F.to_json(F.struct(*[c for c in schema.fieldNames() if c != "_corrupt"]))).alias("record"))
    lines = good.select(key, F.posexplode("positions").alias("at", "p")).select(key, (F.col("at") + 1).cast("bigint").alias("pos_seq"), "p.*")
    lines = lines.withColumn("short_name", truncate_name(F.col("description")))
    return good.drop("positions", "reason", "_corrupt"), lines, rejected


def read_projects(spark: SparkSession, path: str, project_ids: DataFrame | None = None) -> DataFrame:
    """Project settings; projects without a record get one of nulls."""
    settings = spark.read.schema(schemas.project()).json(path)
    return settings if project_ids is None else complete_projects(settings, project_ids)


def complete_projects(settings: DataFrame, project_ids: DataFrame) -> DataFrame:
    """One row of settings for every project, of nulls where there is no record."""
    return project_ids.select("project_id").distinct().join(settings, "project_id", "left")


def _numbered_lines(spark: SparkSession, path: str, streaming: bool) -> DataFrame:
    """(log_file, line_no, value): the lines of text files, numbered from 1 in each file.

    A batch reads files in splits; the place of a split and the order of lines inside it give the number, whichever tasks
    read them. A stream takes a file as one row, since files arrive whole and a line's place is only known within its file.
    """
    file = F.col("_metadata.file_path").alias("log_file")
    if streaming:
        whole = spark.readStream.format("text").option("wholetext", "true").load(path).select("value", file)
        return whole.select("log_file", F.posexplode(F.split("value", "\r\n|\n|\r", -1)).alias("_at", "value")).select("log_file", (F.col("_at") + 1).cast("bigint").alias("line_no"), "value")
    lines = spark.read.text(path).select("value", file, F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"))
    return rank_within(materialize(lines), ["log_file"], ["log_file", "_split", "_id"], "line_no").select("log_file", "line_no", "value")


def read_audit_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Job events from JSON lines, with their file and line. A line that is no JSON becomes a row with a null event. Equal timestamps resolve
    by file name and line, in a batch as in a stream."""
    return parse_audit_lines(_numbered_lines(spark, path, streaming))


def parse_audit_lines(lines: DataFrame) -> DataFrame:
    """Job events of (log_file, line_no, value); blank lines are left out."""
    schema = schemas.audit()
    parsed = lines.where(F.trim("value") != "").withColumn("e", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    known = [f for f in schema.fieldNames() if f != "ts"]
    payload = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, _: ~k.isin(schema.fieldNames()))
    return parsed.select(F.try_to_timestamp("e.ts").alias("ts"), *[F.col(f"e.{c}").alias(c) for c in known], payload.alias("payload"), "log_file", "line_no")
