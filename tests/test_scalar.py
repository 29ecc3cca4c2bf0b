import math

from pyspark.sql import functions as F

from murmur import functions as MF


def test_views_edges(spark):
    df = spark.createDataFrame([(0,), (1048575,), (1048576,), (1048577,)], "views long")
    rows = df.select("views", MF.log2_or_neg_inf("views").alias("l"),
                     MF.views_bucket("views").alias("b")).orderBy("views").collect()
    assert math.isinf(rows[0]["l"]) and rows[0]["l"] < 0
    assert [r["b"] for r in rows] == ["1", "1", None, "2"]


def test_views_bucket4_edges(spark):
    vals = [0, 2 ** 18, 2 ** 18 + 1, 2 ** 20, 2 ** 20 + 1, 2 ** 22, 2 ** 22 + 1]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "views long")
    got = {r["views"]: r["b"] for r in df.select("views", MF.views_bucket4("views").alias("b")).collect()}
    assert [got[v] for v in vals] == ["1", "1", "2", "2", "3", "3", "4"]
    assert got[None] is None


def test_round_half_away_ties(spark):
    df = spark.createDataFrame([(0.125,), (-0.125,), (0.004,), (-0.004,), (0.575,)], "x double")
    rows = df.select("x", MF.round_half_away("x", 2).alias("r")).collect()
    got = {r["x"]: r["r"] for r in rows}
    assert got[0.125] == 0.13 and got[-0.125] == -0.13
    assert got[0.004] == 0 and got[-0.004] == 0
    b = df.select(MF.sentiment_bucket(MF.round_half_away("x", 2)).alias("b")).collect()
    assert sorted(r["b"] for r in b) == [-1, 0, 0, 1, 1]


def test_quote_keeps_null(spark):
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    assert sorted(df.select(MF.quote("t").alias("q")).collect(), key=str) == sorted(
        [(None,), ('"a b"',)], key=str)


def test_md5_bucket_matches_python(spark):
    import hashlib

    df = spark.range(50).select(F.col("id"), MF.md5_bucket("id", 1).alias("b"))
    for r in df.collect():
        h = hashlib.md5(f"{r['id']}|1".encode()).hexdigest()
        assert r["b"] == int(h[:8], 16) % 100
