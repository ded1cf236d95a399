"""Document scans, line tables and content identity."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from costproof import fixed_values as fx
from costproof.functions.german import strip
from costproof.operators.classify import is_candidate
from costproof.session import materialize


def _listed(folders: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of each folder, whatever their names."""
    for batch in folders:
        for folder in batch.column("folder").to_pylist():
            if ":" in folder.split("/")[0]:
                fs, base = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else folder.replace(":/", ":///", 1))
            else:
                fs, base = pyarrow.fs.LocalFileSystem(), folder
            found = fs.get_file_info(pyarrow.fs.FileSelector(base))
            prefix = folder.rstrip("/")
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{prefix}/{i.base_name}" for i in found], pa.string()), pa.array([i.size for i in found], pa.int64()),
                 pa.array([i.mtime for i in found], pa.timestamp("us", tz="UTC")), pa.array([i.type == pyarrow.fs.FileType.Directory for i in found], pa.bool_())],
                ["path", "bytes", "modified", "is_folder"])


def manifest_from_paths(files: DataFrame) -> DataFrame:
    """PDF and image files of a listing (path, bytes, modified): suffixes in any case; hidden files and locks are left out."""
    parts = F.split("path", "/")
    manifest = files.select("path", F.element_at(parts, -2).alias("parent_name"), F.element_at(parts, -1).alias("name"), "bytes", "modified")
    return manifest.where(is_candidate(F.col("name")))


def scan_documents(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Manifest of the PDF and image files below a folder; file contents are not read.

    Folders are rows: each level is listed by tasks, one round per level of depth. Spark's own file index is not
    used, because it passes over names that begin with an underscore.
    """
    level, found = spark.createDataFrame([(root,)], "folder string"), []
    while True:
        listed = materialize(level.mapInArrow(_listed, "path string, bytes long, modified timestamp, is_folder boolean"))
        found.append(listed.where(~F.col("is_folder")).drop("is_folder"))
        level = listed.where("is_folder").select(F.col("path").alias("folder"))
        if not recursive or level.isEmpty():
            break
        level = level.repartition("folder")
    files = found[0]
    for more in found[1:]:
        files = files.union(more)
    return manifest_from_paths(files)


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line, numbered from 1."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("_at", "line"))
    return lines.select(key, (F.col("_at") + 1).alias("line_no"), "line")


def text_layer_status(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose pages hold next to no text (scans)."""
    chars = F.sum(F.length(strip(F.col("text"))))
    return pages.groupBy(key).agg((F.coalesce(chars, F.lit(0)) < fx.MIN_TEXT_CHARS).alias("text_layer_empty"))


def content_hash(content) -> object:
    return F.sha2(content.cast("binary"), 256)


def dedupe_by_content(docs: DataFrame, key: str, content: str) -> DataFrame:
    """Content hash, first document per hash and number of copies on every row.

    The hash aggregate combines map-side, and only hashes travel to it; a content with very
    many copies is one row on the small side of the join back.
    """
    hashed = docs.withColumn("content_hash", content_hash(F.col(content)))
    firsts = hashed.groupBy("content_hash").agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return hashed.join(firsts, "content_hash").withColumn("is_first", F.col(key) == F.col("first_id"))


def fan_out(results: DataFrame, hashed: DataFrame, key: str) -> DataFrame:
    """Results of the first documents handed to all their copies."""
    return hashed.select(key, F.col("first_id")).join(
        results.withColumnRenamed(key, "first_id"), "first_id").drop("first_id")
