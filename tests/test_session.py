"""Staged tables and what they leave on disk."""

from pyspark.sql import functions as F

from inkprobe import session


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {line for line in blocks.split("\n") if "shuffle_" in line}


def test_staging_leaves_no_shuffle_files(spark):
    before, conf = shuffle_files(spark), spark.conf.get(session._CLEANUP, None)
    staged = session.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not shuffle_files(spark) - before and spark.conf.get(session._CLEANUP, None) == conf
    assert sorted(r["count"] for r in staged.collect()) == [142] + [143] * 6


def test_cleanup_holds_while_any_write_runs(spark):
    conf = spark.conf.get(session._CLEANUP, None)
    with session.shuffles_removed(spark):
        with session.shuffles_removed(spark):
            pass
        assert spark.conf.get(session._CLEANUP) == "true"
    assert spark.conf.get(session._CLEANUP, None) == conf


def test_discard(spark, tmp_path):
    one, two = (session.stage(spark.range(3), name) for name in ("one", "two"))
    session.discard(one)
    assert two.count() == 3 and one.staged_at not in session._staged and two.staged_at in session._staged
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(one.staged_at)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
