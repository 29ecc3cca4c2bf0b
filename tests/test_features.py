from pyspark.sql import functions as F

from murmur.operators import features
from murmur.schemas import DEFAULT_RANKS


def _measures(spark, sizes):
    rows = []
    cid = 0
    for vid, n in sizes.items():
        for i in range(n):
            rows.append((cid, vid, "quantity", float(i % 7)))
            cid += 1
    return spark.createDataFrame(rows, "comment_id long, videoID string, measure string, value double")


def test_rank_limit_41(spark):
    m = _measures(spark, {"a": 40, "b": 41, "c": 45})
    piv = features.rank_pivot(m, ["quantity"])
    out = features.drop_short(piv, ["quantity_41"])
    assert sorted(r["videoID"] for r in out.collect()) == ["b", "c"]
    assert "quantity_39" not in out.columns and "quantity_40" in out.columns
    assert len(out.columns) == 1 + len(DEFAULT_RANKS)


def test_pivot_values_are_sorted_desc(spark):
    m = _measures(spark, {"b": 45})
    row = features.rank_pivot(m, ["quantity"]).first()
    vals = sorted([float(i % 7) for i in range(45)], reverse=True)
    for r in DEFAULT_RANKS:
        assert row[f"quantity_{r}"] == vals[r - 1]


def test_window_group_limit_in_plan(spark):
    m = _measures(spark, {"a": 50})
    plan = features.rank_pivot(m, ["quantity"])._jdf.queryExecution().executedPlan().toString()
    # a partial limit below the shuffle (per task) and a final one after it
    assert plan.count("WindowGroupLimit") >= 2
    below = plan[plan.rfind("Exchange"):]
    assert "WindowGroupLimit" in below


def test_training_table_labels(spark):
    m = _measures(spark, {"a": 41, "b": 41, "c": 41})
    m = m.union(m.withColumn("measure", F.lit("other")))
    feats = features.video_features(m, ("quantity", "other"))
    videos = spark.createDataFrame([("a", 2 ** 20 - 1, 1), ("b", 2 ** 20, 2), ("c", 2 ** 20 + 1, 3), ("c", 5, 3)],
                                   "videoID string, views long, categoryID int")
    t = features.training_table(videos, feats)
    got = {r["videoID"]: r["viewsBucket"] for r in t.collect()}
    assert got == {"a": "1", "c": "2"}   # b sits exactly on 2^20; c keeps its max views
    keep = features.training_table(videos, feats, keep_all=True)
    assert sorted(r["viewsBucket"] for r in keep.collect()) == ["1", "1", "2"]


def test_drop_short_treats_blank_as_missing(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "  "), ("c", None)], "videoID string, x_41 string")
    assert [r["videoID"] for r in features.drop_short(df, ["x_41"]).collect()] == ["a"]


def test_sort_positions_equal_a_row_number(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.range(500).select(F.col("id").alias("comment_id"), (F.col("id") % 5).cast("string").alias("videoID"),
                                 (F.col("id") % 3).cast("double").alias("value")).repartition(6)
    w = Window.orderBy("videoID", F.desc("value"), "comment_id")
    want = sorted((r["comment_id"], r["p"]) for r in df.withColumn("p", F.row_number().over(w)).collect())
    assert sorted((r["comment_id"], r["position"]) for r in features.sort_positions(df).collect()) == want
