"""Distribution statistics (#42-#45): distributed aggregations.

min/max for the histogram come from scalar subqueries, so no row is joined
to an aggregate and nothing is collected before the plan runs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.session import cut_lineage, spark_context


#: Accuracy of the sketch that proposes brackets, and rows of a bracket that the driver takes.
ACCURACY, HELD = 10_000, 10_000


def values_at(values: DataFrame, col: str, ranks: Sequence[int], held: int = HELD) -> dict[int, float]:
    """The values at the given 0-based ranks in ascending order (NaN last, ranks beyond the rows left out).

    Nothing is sorted: a quantile sketch proposes a value on either side of a
    rank, one pass counts exactly what lies below and inside that bracket, and
    the search goes on inside (or beside, where the sketch was off) until a
    bracket holds one value or at most ``held`` rows, which the driver takes.
    Each pass narrows a bracket by about ``ACCURACY``."""
    v = values.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    inf = float("inf")
    row = v.agg(F.count_if(F.col("v") == -inf).alias("low"), F.count_if(F.col("v") == inf).alias("high"), F.count_if(F.isnan("v")).alias("nan"),
                F.count("*").alias("n"), F.min(F.when((F.col("v") > -inf) & (F.col("v") < inf), F.col("v"))).alias("least"),
                F.max(F.when((F.col("v") > -inf) & (F.col("v") < inf), F.col("v"))).alias("most")).first()
    finite = row["n"] - row["low"] - row["high"] - row["nan"]
    out: dict[int, float] = {}
    open_: dict[tuple, list[int]] = {}
    for r in sorted(set(ranks)):
        if r < row["low"]:
            out[r] = -inf
        elif r < row["low"] + finite:
            open_.setdefault((row["least"], row["most"], row["low"], finite), []).append(r)
        elif r < row["n"]:
            out[r] = inf if r < row["low"] + finite + row["high"] else float("nan")
    while open_:
        found: dict[tuple, list[int]] = {}
        for (lo, hi, below, n), wanted in open_.items():
            inside = v.filter(F.col("v").between(lo, hi))
            if lo == hi:
                out.update(dict.fromkeys(wanted, lo))
                continue
            if n <= held:
                rows = sorted(x["v"] for x in inside.collect())
                out.update({r: rows[r - below] for r in wanted})
                continue
            step = 2.0 / ACCURACY
            shares = [min(1.0, max(0.0, (r - below) / n + d)) for r in wanted for d in (-step, step)]
            cuts = inside.agg(F.percentile_approx("v", shares, ACCURACY).alias("c")).first()["c"]
            edges = sorted({lo, hi, *cuts})
            # Exact rows at each edge and between each two: one aggregation.
            cells = [F.count_if(F.col("v") == x) for x in edges] + [F.count_if((F.col("v") > x) & (F.col("v") < y)) for x, y in zip(edges, edges[1:])]
            counts = inside.agg(*cells).first()
            at, between = counts[:len(edges)], counts[len(edges):]
            for r in wanted:
                start = below
                for i, x in enumerate(edges):
                    if r < start + at[i]:
                        found.setdefault((x, x, start, at[i]), []).append(r)
                        break
                    start += at[i]
                    if i < len(between) and r < start + between[i]:
                        found.setdefault((math.nextafter(x, inf), math.nextafter(edges[i + 1], -inf), start, between[i]), []).append(r)
                        break
                    start += between[i] if i < len(between) else 0
        open_ = found
    return out


def describe_distinct(df: DataFrame, col: str) -> DataFrame:
    """count, mean, std (n-1), min, quartiles (linear interpolation), max of
    the distinct non-null values of ``col``; infinities and NaN are values."""
    d = cut_lineage(df.select(F.col(col).cast("double").alias("v")).distinct().filter(F.col("v").isNotNull()))
    n = d.count()
    places = [q * (n - 1) for q in (0.25, 0.5, 0.75)] if n else []
    at = values_at(d, "v", sorted({r for h in places for r in (math.floor(h), math.ceil(h))})) if n else {}

    def between(h):
        a, b = at[math.floor(h)], at[math.ceil(h)]
        return a if a == b or h == math.floor(h) else a + (b - a) * (h - math.floor(h))

    quartiles = [F.round(F.lit(float(between(h))), 6) for h in places] or [F.lit(None).cast("double")] * 3
    return d.agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("v"), 6).alias("mean"),
                 F.round(F.stddev_samp("v"), 6).alias("std"), F.min("v").alias("min"),
                 *[x.alias(name) for x, name in zip(quartiles, ("q25", "q50", "q75"))], F.max("v").alias("max"))


def kurtosis_of(df: DataFrame, col: str) -> DataFrame:
    """Fisher (excess) kurtosis, biased (population moments)."""
    return df.agg(F.count(F.col(col)).alias("n"),
                  F.round(F.kurtosis(F.col(col).cast("double")), 6).alias("kurtosis"))


def t_two_sided_p(spark, t: float | None, dof: float) -> float | None:
    """Two-sided p-value of Student's t, by the commons-math that Spark ships."""
    if t is None or dof <= 0 or math.isnan(t):
        return None
    if math.isinf(t):
        return 0.0
    jvm = spark_context(spark)._jvm
    return 2.0 * jvm.org.apache.commons.math3.distribution.TDistribution(float(dof)).cumulativeProbability(-abs(float(t)))


def pearson(df: DataFrame, pairs: Sequence[tuple[str, str]], with_p: bool = True) -> DataFrame:
    """Pearson r, n and t = r * sqrt((n-2)/(1-r^2)) for each column pair,
    all pairs in one aggregation; optional two-sided p-value."""
    aggs = []
    for x, y in pairs:
        aggs.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"),
                             F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"),
                             F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n")))
    row = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    t = F.col("r") * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), F.lit(1.0) - F.col("r") * F.col("r")))
    out = row.withColumn("t", t)
    if with_p:
        rows = out.collect()  # one row per pair
        spark = df.sparkSession
        out = spark.createDataFrame([(*r, t_two_sided_p(spark, r["t"], r["n"] - 2)) for r in rows],
                                    "x string, y string, r double, n long, t double, p_value double")
    return out.withColumn("r", F.round("r", 6)).withColumn("t", F.round("t", 6))


def histogram(df: DataFrame, col: str, bins: int = 70) -> DataFrame:
    """Equal-width histogram over [min, max], last bin closed, with numpy's
    rules: a first guess ((v - lo) / (hi - lo)) * bins, corrected against the
    edges i * ((hi - lo) / bins) + lo (last edge = hi), so values that sit
    on an edge land where numpy puts them.

    Output: bin (1..bins), lower and upper edge, count; empty bins omitted.
    All values equal -> a single bin holding every row. lo and hi are scalar
    subqueries (no join, nothing collected).
    """
    v = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    lo = v.select(F.min("v")).scalar()
    hi = v.select(F.max("v")).scalar()
    width = hi - lo
    step = width / F.lit(float(bins))

    def edge(i):
        return F.when(i == bins, hi).otherwise(i.cast("double") * step + lo)

    x = F.col("v")
    i1 = F.least(F.floor(F.try_divide(x - lo, width) * F.lit(float(bins))).cast("long"), F.lit(bins - 1))
    counts0 = v.select(x, i1.alias("_i1"))
    i2 = F.when(x < edge(F.col("_i1")), F.col("_i1") - 1).otherwise(F.col("_i1"))
    counts1 = counts0.select(x, i2.alias("_i2"))
    i3 = F.when((F.col("_i2") != bins - 1) & (x >= edge(F.col("_i2") + 1)), F.col("_i2") + 1).otherwise(F.col("_i2"))
    b = F.when(width > 0, i3 + 1).otherwise(F.lit(1)).cast("int")
    counts = counts1.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    return counts.select(
        "bin",
        F.round(edge((F.col("bin") - 1).cast("long")), 6).alias("bin_lo"),
        F.round(edge(F.col("bin").cast("long")), 6).alias("bin_hi"),
        "count",
    )
