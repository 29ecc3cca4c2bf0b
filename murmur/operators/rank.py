"""Row numbers within groups, exact and safe for one very hot group.

A plain ``row_number().over(Window.partitionBy(key))`` sends a whole group
to one task. When a single video holds a third of all comments that task
sorts a third of the data. Here the rows are range-partitioned and sorted on
(keys, value, tie), so even a hot group is spread over many tasks; a row's
number is its place in its partition plus the group's rows in earlier
partitions, which a small count table holds. The result equals the plain
window's row numbers, for any type of tie column and for NULL keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.session import cut_lineage, spark_context


def sorted_places(df: DataFrame, order: Sequence, part: str = "_pid", place: str = "_li") -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with the partition
    number and the place within it (from 0) as columns.

    A reliable checkpoint fixes both, so a rerun of a lost task cannot
    change them."""
    sc = spark_context(df.sparkSession)
    parts = max(sc.defaultParallelism, df.rdd.getNumPartitions()) if sc is not None else 200
    s = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
         .withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()))
    return cut_lineage(s).withColumn(place, F.col(place) - F.shiftleft(F.col(part).cast("long"), 33))


def rank_within(df: DataFrame, keys: Sequence[str], value: str | None, tie: str,
                descending: bool = True, col: str = "rn") -> DataFrame:
    """``row_number`` within ``keys`` ordered by ``value`` (desc by default,
    NULLs last) then ``tie`` ascending. Adds column ``col`` (long, from 1)."""
    keys = list(keys)
    order = [F.col(k).asc() for k in keys]
    if value is not None:
        order.append(F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last())
    order.append(F.col(tie).asc())
    s = sorted_places(df, order)
    counts = s.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_c"), F.min("_li").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(F.col("_pid").alias("_opid"), *[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)],
                         "_first", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    same = F.col("_pid") == F.col("_opid")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_o{i}"))
    return s.join(offs, same).select(*df.columns, (F.col("_off") + F.col("_li") - F.col("_first") + 1).alias(col))


def top_n_within(df: DataFrame, keys: Sequence[str], value: str, tie: str, n: int,
                 descending: bool = True, col: str = "rn") -> DataFrame:
    """Rows ranked 1..n within each group.

    Planned as WindowGroupLimit: each map task keeps its own top n per group
    before the shuffle, so a hot group ships at most n rows per task.
    """
    o = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    w = Window.partitionBy(*keys).orderBy(o, F.col(tie).asc())
    return df.withColumn(col, F.row_number().over(w)).filter(F.col(col) <= n)


def ntile_within(df: DataFrame, keys: Sequence[str], order: str, k: int, col: str = "ntile") -> DataFrame:
    """SQL ``ntile(k)`` within ``keys`` ordered by the unique column ``order``,
    computed from an exact row number and the group size."""
    ranked = rank_within(df, keys, None, order, descending=False, col="_r")
    sizes = df.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n"))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    j = ranked.join(sizes, same)
    size = F.floor(F.col("_n") / k)
    rem = F.col("_n") - size * k
    big = rem * (size + 1)
    r = F.col("_r")
    tile = (F.when(r <= big, F.floor((r - 1) / (size + 1)) + 1)
            .otherwise(rem + F.floor(F.try_divide((r - 1 - big).cast("double"), size.cast("double"))) + 1))
    return j.select(*df.columns, tile.cast("int").alias(col))
