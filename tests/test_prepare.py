import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from murmur.operators import prepare
from murmur.operators.rank import ntile_within, rank_within


def test_sample_fewer_rows_than_cap(spark):
    df = spark.range(5).withColumnRenamed("id", "comment_id")
    assert prepare.sample_n(df, 10).count() == 5
    with pytest.raises(ValueError):
        prepare.sample_n(df, 10, exact=True)


def test_sample_partition_independent(spark):
    df = spark.range(1000).withColumnRenamed("id", "comment_id")
    a = sorted(r[0] for r in prepare.sample_n(df.repartition(1), 37, seed=3).collect())
    b = sorted(r[0] for r in prepare.sample_n(df.repartition(8), 37, seed=3).collect())
    assert a == b and len(a) == 37


def test_split_fractions_and_independence(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("videoID"))
    a = prepare.split_bucket(df.repartition(1), seed=1)
    b = prepare.split_bucket(df.repartition(7), seed=1)
    assert sorted(a.collect()) == sorted(b.collect())
    n = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert abs(n["train"] / 20000 - 0.6) < 0.02 and abs(n["test"] / 20000 - 0.2) < 0.02


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_rank_within_equals_plain_window(spark, parts):
    df = spark.range(500).select(
        F.col("id").alias("comment_id"),
        (F.col("id") % 3).cast("string").alias("videoID"),
        ((F.col("id") * 7919) % 11).cast("double").alias("value"))
    ours = rank_within(df.repartition(parts), ["videoID"], "value", "comment_id").select("comment_id", "rn")
    w = Window.partitionBy("videoID").orderBy(F.desc("value"), F.asc("comment_id"))
    plain = df.select("comment_id", F.row_number().over(w).cast("int").alias("rn"))
    assert sorted(ours.collect()) == sorted(plain.collect())


def test_single_label_folds_and_ntile(spark):
    df = spark.range(103).select(F.col("id").alias("k"), F.lit("1").alias("label"))
    ours = ntile_within(df, ["label"], "k", 8, col="fold")
    plain = df.select("k", F.ntile(8).over(Window.partitionBy("label").orderBy("k")).alias("t"))
    assert sorted((r["k"], r["fold"]) for r in ours.collect()) == sorted(tuple(r) for r in plain.collect())


def test_filters(spark):
    df = spark.createDataFrame([(1, "ch1", 1), (2, "Ch1", 0), (3, "ch1", -1)], "id long, channel string, sentimentBucket int")
    assert [r["id"] for r in prepare.filter_equals(df, "channel", "ch1").orderBy("id").collect()] == [1, 3]
    assert [r["id"] for r in prepare.filter_sentiment(df, "-1.0").collect()] == [3]


def test_join_titles_fans_out_duplicates(spark):
    c = spark.createDataFrame([(1, "v")], "comment_id long, videoID string")
    t = spark.createDataFrame([("v", "a"), ("v", "b")], "videoID string, title string")
    assert prepare.join_titles(c, t).count() == 2


def test_project_unknown_column(spark):
    with pytest.raises(KeyError):
        prepare.project(spark.range(1), ["nope"])


def test_ntile_fewer_rows_than_tiles(spark):
    df = spark.range(5).select(F.col("id").alias("k"), F.lit("a").alias("label"))
    got = sorted((r["k"], r["fold"]) for r in ntile_within(df, ["label"], "k", 8, col="fold").collect())
    assert got == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]


def test_rank_string_tie_equals_plain_window(spark):
    # one hot label holding most rows, string ids
    df = spark.range(3000).select(
        F.format_string("v%05d", (F.col("id") * 7919) % 3000).alias("videoID"),
        F.when(F.col("id") % 10 == 0, "1").otherwise("2").alias("label"),
        ((F.col("id") * 31) % 7).cast("double").alias("value"))
    ours = rank_within(df, ["label"], "value", "videoID", col="rn").select("videoID", "rn")
    w = Window.partitionBy("label").orderBy(F.desc("value"), F.asc("videoID"))
    plain = df.select("videoID", F.row_number().over(w).cast("int").alias("rn"))
    assert sorted(ours.collect()) == sorted(plain.collect())
    folds = prepare.stratified_folds(df, "label", "videoID", 8)
    ref = df.select("videoID", F.ntile(8).over(Window.partitionBy("label").orderBy("videoID")).alias("f"))
    assert sorted((r["videoID"], r["fold"]) for r in folds.collect()) == sorted(tuple(r) for r in ref.collect())


def test_sample_threshold_equals_full_sort(spark):
    from murmur.functions.scalar import md5_key

    df = spark.range(20000).withColumnRenamed("id", "comment_id").repartition(13)
    for n in (1, 10, 500, 7000):
        ours = sorted(r[0] for r in prepare.sample_n(df, n, seed=5).collect())
        ref = sorted(r[0] for r in df.orderBy(md5_key(F.col("comment_id"), 5), "comment_id").limit(n).collect())
        assert ours == ref


def test_spread_only_when_coarse(spark):
    from murmur.operators.common import spread_if_coarse

    par = spark.sparkContext.defaultParallelism
    wide = spark.range(1000).repartition(par * 2)
    assert spread_if_coarse(wide) is wide
    narrow = spark.range(1000).coalesce(1)
    assert spread_if_coarse(narrow).rdd.getNumPartitions() >= par


def test_rank_and_folds_keep_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0, 1), (None, 2.0, 2), (None, None, 3), ("a", 5.0, 4)], "k string, v double, id long")
    ours = sorted((r["id"], r["rn"]) for r in rank_within(df, ["k"], "v", "id").collect())
    assert ours == [(1, 2), (2, 1), (3, 2), (4, 1)]
    folds = sorted((r["id"], r["fold"]) for r in ntile_within(df, ["k"], "id", 2, col="fold").collect())
    assert folds == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_sample_keeps_a_null_key(spark):
    df = spark.range(20000).select(F.col("id").alias("comment_id")).unionByName(
        spark.createDataFrame([(None,)], "comment_id long"))
    from murmur.functions.scalar import md5_key

    ours = {r[0] for r in prepare.sample_n(df, 100, seed=5).collect()}
    ref = {r[0] for r in df.orderBy(md5_key(F.col("comment_id"), 5), "comment_id").limit(100).collect()}
    assert ours == ref and None in ours
