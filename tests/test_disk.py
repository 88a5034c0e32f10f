"""Steps that are done leave the disk before a job ends."""

import datetime
import glob

from pyspark.sql import functions as F

from terrace import scale
from terrace.operators import ratings, training
from terrace.sources import files


def _kept(spark, pattern):
    scale.ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    return set(glob.glob(f"{root}/{pattern}"))


def test_checkpoints_that_nothing_reads_are_deleted(spark):
    before = _kept(spark, "rdd-*")
    first, second = scale.checkpoint(spark.range(100)), scale.checkpoint(spark.range(50))
    assert len(_kept(spark, "rdd-*") - before) == 2
    del first
    for _ in range(10):  # the cleaner has a thread of its own
        scale.release(spark)
        if len(_kept(spark, "rdd-*") - before) == 1:
            break
    assert len(_kept(spark, "rdd-*") - before) == 1
    assert second.filter("id < 10").count() == 10


def test_folded_chunks_are_dropped(spark, matches):
    before, seen = _kept(spark, "rating-chunks-*"), _kept(spark, "rating-chunks-*/_chunk=*")
    rated = ratings.rate_matches(matches, max_rows=60)
    assert len(_kept(spark, "rating-chunks-*") - before) == 1
    assert _kept(spark, "rating-chunks-*/_chunk=*") == seen
    assert rated.count() == matches.count() == rated.select("match_id").distinct().count()


def test_feature_rows_are_written_where_they_are(spark, tmp_path):
    rows = spark.range(0, 600, 1, 6).select(F.col("id").alias("match_id"), F.lit("PL").alias("competition"), F.lit(datetime.date(2020, 1, 5)).alias("match_date"))
    files.write_features(rows, f"{tmp_path}/out")
    assert len(glob.glob(f"{tmp_path}/out/competition=PL/*.parquet")) == 6  # one month of one league, without a shuffle
    assert spark.read.parquet(f"{tmp_path}/out").count() == 600


def test_features_are_not_kept_with_out_of_fold_scores(spark):
    s = training.Settings(["a"], ["match_id"], inner_folds=2)
    data = spark.range(20).select(F.col("id").alias("match_id"), F.lit(1).alias("features"))
    out = training.out_of_fold(data, lambda d: [training.Expressions(names=["p"], formulas=["features + 1"], dropped=[])], s, salt=1)
    assert out.columns == ["match_id", "p"] and out.count() == 20
