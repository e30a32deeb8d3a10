"""Settings that keep a task's share apart from the input's size."""

import os
import time

from pyspark.sql import functions as F

from lakestate.session import TASK_MB, _mb, passing, pinned, prepare, run_dir, written


def test_a_task_takes_no_more_than_its_size(spark):
    held = {s: spark.conf.get(s) for s in TASK_MB}
    try:
        for given, want in (("64MB", None), ("134217728b", None), ("1g", None), ("8m", 8.0), ("512k", 0.5), ("1048576", 1.0)):
            for setting in TASK_MB:
                spark.conf.set(setting, given)
            prepare(spark)
            for setting, most in TASK_MB.items():
                assert _mb(spark.conf.get(setting)) == (most if want is None else want)
    finally:
        for setting, value in held.items():
            spark.conf.set(setting, value)
        prepare(spark)


def shuffles(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def settles(now, want):
    """Spark removes what is let go of in a thread of its own."""
    for _ in range(100):
        if now() == want:
            return True
        time.sleep(0.1)
    return False


def test_what_a_written_table_was_made_of_leaves_the_disk(spark):
    summed = lambda: spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    written(spark.range(1), "none")
    time.sleep(1)
    before = shuffles(spark)
    kept = [pinned(summed()), written(summed(), "sums")]
    written(spark.range(1), "next")
    assert settles(lambda: shuffles(spark), before)
    assert sorted(kept[0].collect()) == sorted(kept[1].collect()) and kept[0].count() == 7


def test_tables_of_a_passing_step_leave_the_disk(spark):
    made = lambda: {f for f in os.listdir(os.path.dirname(run_dir(spark, "x").removeprefix("file:"))) if f.startswith("t-")}
    written(spark.range(2), "t-outer")
    outer = made()
    with passing(spark):
        one = written(spark.range(3), "t-inner")
        with passing(spark):
            written(spark.range(4), "t-inmost")
            assert len(made()) == len(outer) + 2
        assert len(made()) == len(outer) + 1
        got = pinned(one)
    assert made() == outer and got.count() == 3
