"""Kernel similarity: the middle distance and its tasks."""

import numpy as np
from pyspark.sql import functions as F

from tidewire.operators import similarity as SI


def test_middle_distance():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 40, 700):
        a = rng.integers(0, 9, (n, 2)) / 7
        every = ((a[:, None] - a[None]) ** 2).sum(axis=2)
        wanted = np.median(every[every != 0]) if (every != 0).any() else np.nan
        assert np.array_equal(SI.middle_distance(a), wanted, equal_nan=True)
        assert np.allclose(SI.middle_distance(a, few=100), wanted, equal_nan=True)


def test_batches_keep_the_parallelism(spark):
    df = spark.range(2_000).selectExpr("id % 50 AS batch_id", "sin(id) AS a", "cos(id * id) AS b")
    found = SI.kernel_cka(df, ["a"], ["b"]).withColumn("_task", F.spark_partition_id()).collect()
    assert len(found) == 50
    assert len({r["_task"] for r in found}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
