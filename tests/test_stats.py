import numpy as np

from murmur.operators import stats


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.gamma(2.0, 3.0, 5000), 2)
    df = spark.createDataFrame([(float(x),) for x in v], "value double")
    got = {r["bin"]: r["count"] for r in stats.histogram(df, "value", 70).collect()}
    counts, _ = np.histogram(v, bins=70)
    assert [got.get(i + 1, 0) for i in range(70)] == counts.tolist()


def test_histogram_all_equal(spark):
    df = spark.createDataFrame([(3.0,)] * 9, "value double")
    rows = stats.histogram(df, "value").collect()
    assert len(rows) == 1 and rows[0]["count"] == 9


def test_describe_distinct_matches_pandas(spark):
    import pandas as pd

    vals = [1.0, 2.0, 2.0, 5.0, 9.0, 9.0, 10.5]
    df = spark.createDataFrame([(x,) for x in vals], "v double")
    r = stats.describe_distinct(df, "v").first()
    d = pd.Series(vals).drop_duplicates().describe()
    assert r["count"] == d["count"] and abs(r["q25"] - d["25%"]) < 1e-9 and abs(r["std"] - d["std"]) < 1e-6


def test_pearson_p_value(spark):
    # t = 2.228, df = 10 -> two-sided p = 0.05 (Student's t table)
    assert abs(stats.t_two_sided_p(spark, 2.228, 10) - 0.05) < 5e-4
    assert abs(stats.t_two_sided_p(spark, 1.0, 1) - 0.5) < 1e-9  # Cauchy: P(|T| > 1) = 1/2
    assert stats.t_two_sided_p(spark, float("inf"), 3) == 0.0 and stats.t_two_sided_p(spark, None, 3) is None
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    y = 0.3 * x + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    r = stats.pearson(df, [("x", "y")]).first()
    assert abs(r["r"] - np.corrcoef(x, y)[0, 1]) < 1e-6 and r["n"] == 200 and 0 <= r["p_value"] < 0.01


def test_kurtosis_biased_fisher(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 10.0]
    df = spark.createDataFrame([(x,) for x in vals], "v double")
    a = np.array(vals)
    m2, m4 = ((a - a.mean()) ** 2).mean(), ((a - a.mean()) ** 4).mean()
    assert abs(stats.kurtosis_of(df, "v").first()["kurtosis"] - round(m4 / m2 ** 2 - 3, 6)) < 1e-6


def test_describe_distinct_equals_numpy_on_many_partitions(spark):
    vals = np.round(np.random.default_rng(3).lognormal(0, 2, 3000), 3)
    df = spark.createDataFrame([(float(x),) for x in vals], "v double").repartition(7)
    r = stats.describe_distinct(df, "v").first()
    d = np.unique(vals)
    for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
        assert abs(r[name] - np.quantile(d, q)) < 1e-6
    assert r["count"] == len(d)


def test_describe_distinct_with_infinities_and_nan(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, float("inf"), float("-inf"), float("nan"), None)], "v double")
    r = stats.describe_distinct(df, "v").first()
    assert r["count"] == 6 and r["min"] == float("-inf") and r["q50"] == 2.5
    assert stats.describe_distinct(df.filter("v is null"), "v").first()["count"] == 0


def test_values_at_ranks(spark):
    vals = [float(x) for x in np.random.default_rng(9).normal(size=2000)]
    df = spark.createDataFrame([(x,) for x in vals], "v double")
    s = sorted(vals)
    assert stats.values_at(df, "v", [0, 17, 999, 1999]) == {k: s[k] for k in (0, 17, 999, 1999)}
