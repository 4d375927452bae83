"""Shuffle files go with the write that made them, and the session's setting stays the caller's."""

import os

from pyspark.sql import functions as F

from fraudloom.session import TIDY, materialize, together


def shuffled(spark) -> int:
    """Bytes of shuffle files in the executors' folders."""
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    names = [os.path.join(d, f) for i in range(len(top)) for d, _, files in os.walk(top[i].getPath()) for f in files if f.startswith("shuffle_")]
    return sum(os.path.getsize(f) for f in names if os.path.exists(f))


def test_shuffle_files_go_with_the_write(spark):
    rows = spark.range(300_000).withColumn("k", F.xxhash64("id")).repartition(5, "k")
    before, setting = shuffled(spark), spark.conf.get(TIDY, None)
    tables = together(*[lambda: materialize(rows.groupBy("k").count()) for _ in range(3)])
    assert shuffled(spark) - before < 100_000 and [t.count() for t in tables] == [300_000] * 3
    assert spark.conf.get(TIDY, None) == setting
