"""Written intermediate tables and small plan helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from costproof.session import ensure_checkpoint_dir

#: White space between words: space, and tab to carriage return. All other code points belong to words.
WORD = "[^\\x20\\x09-\\x0D]+"


#: The folders that the innermost ``collecting`` of this thread has seen made.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names; every executor and the driver see it."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(folder)
    return folder


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The folders made inside, by this thread, as a list."""
    folders: list[str] = []
    before = _MADE.set(folders)
    try:
        yield folders
    finally:
        _MADE.reset(before)


def drop(spark: SparkSession, folders: list[str]) -> None:
    """Remove folders, through the file system that Spark uses for them."""
    jvm = spark.sparkContext._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and a lost executor loses nothing of it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that a caller's extra columns cannot clash with an operator's own names."""
    return df.select(*columns)
