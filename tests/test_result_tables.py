"""Result tables: a reader sees the last complete write, whatever failed or was repeated since."""

import pytest
from pyspark.sql import functions as F

from costproof.sources import sinks


def table(spark, n, value):
    return spark.range(n).select(F.col("id").alias("project_id"), F.lit(value).alias("value"))


def rows(spark, path, name="t"):
    return sorted(tuple(r) for r in sinks.read_result_table(spark, path, name).collect())


def test_commit(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_result_tables({"t": table(spark, 50, 1), "u": spark.createDataFrame([(7,)], "x int")}, path, buckets=8, run="a")
    assert rows(spark, path) == [(i, 1) for i in range(50)] and rows(spark, path, "u") == [(7,)]
    broken = table(spark, 50, 2).withColumn("value", F.when(F.col("project_id") == 49, F.raise_error(F.lit("no"))).otherwise(2).cast("int"))
    with pytest.raises(Exception):
        sinks.write_result_tables({"u": spark.createDataFrame([(8,)], "x int"), "t": broken}, path, buckets=8, run="b")
    assert rows(spark, path) == [(i, 1) for i in range(50)] and rows(spark, path, "u") == [(7,)]
    for _ in range(2):  # the same run again
        sinks.write_result_tables({"t": table(spark, 60, 3)}, path, buckets=8, run="c")
        assert rows(spark, path) == [(i, 3) for i in range(60)] and rows(spark, path, "u") == [(7,)]


def test_some_buckets(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_result_tables({"t": table(spark, 50, 1)}, path, buckets=4)
    bucket = {r[0]: r[1] for r in spark.range(50).select(F.col("id").alias("project_id")).select("project_id", sinks.project_bucket(4)).collect()}
    old = sinks.read_result_table(spark, path, "t")
    sinks.write_result_tables({"t": table(spark, 50, 2)}, path, buckets=4, only=[1, 3])
    assert rows(spark, path) == [(i, 2 if bucket[i] in (1, 3) else 1) for i in range(50)]
    assert sorted(tuple(r) for r in old.collect()) == [(i, 1) for i in range(50)]  # whoever read before still reads that
    sinks.write_result_tables({"t": table(spark, 0, 2)}, path, buckets=4)
    assert rows(spark, path) == []
    with pytest.raises(ValueError):
        sinks.write_result_tables({"t": table(spark, 5, 2)}, path, buckets=16, only=[1])
