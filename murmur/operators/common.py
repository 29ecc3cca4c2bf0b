"""Size checks for anything that is broadcast or held by the driver, and
constant lookup tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest dimension table (word list, category list) that is broadcast, in
# bytes as counted below; a larger one is joined by a shuffle that AQE plans.
MAX_BROADCAST_BYTES = 64 << 20
# Largest caller-supplied lexicon (a parameter, not data), in words.
MAX_LEXICON_WORDS = 1_000_000


def small_side(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when its rows hold at most ``max_bytes``, else ``df``.

    The check is one aggregation over the (small) dimension side: 16 bytes a
    cell plus the length of its text form. The join's result is the same."""
    cell = [F.lit(16) + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns]
    size = df.agg(F.sum(sum(cell[1:], cell[0]).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def constant_lookup(table: DataFrame, key: str, max_rows: int = MAX_LEXICON_WORDS):
    """A function Column -> Column that finds a key's row in a constant table.

    The table (a caller's lexicon, checked to have at most ``max_rows`` rows
    and no key twice) becomes one literal: an array of small maps, picked by
    the key's hash. A lookup hashes once and scans one map of about one entry,
    so its cost does not grow with the table; nothing is shuffled or joined.
    The result is a struct of the other columns, NULL for an unknown key."""
    rows = table.withColumn("_bin_hash", F.xxhash64(F.col(key))).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"the lexicon has more than {max_rows} rows (max_rows)")
    values = [f for f in table.schema.fields if f.name != key]
    if not rows:
        return lambda c: F.lit(None).cast(T.StructType(values))
    bins = 1 << max(0, (len(rows) - 1).bit_length())
    maps: list[dict] = [{} for _ in range(bins)]
    for r in rows:
        own = maps[r["_bin_hash"] % bins]
        if r[key] is None or r[key] in own:
            raise ValueError(f"{key} must be unique and not missing")
        own[r[key]] = {f.name: r[f.name] for f in values}
    # Foldable, so the optimizer makes it one literal.
    kind = T.ArrayType(T.MapType(T.StringType(), T.StructType(values)))
    slots = F.from_json(F.lit(json.dumps(maps)), kind)
    return lambda c: F.get(slots, F.pmod(F.xxhash64(c), F.lit(bins)).cast("int"))[c]


def word_list_df(spark, words, col: str = "token") -> DataFrame:
    """A one-column DataFrame from a caller's word list (distinct)."""
    return spark.createDataFrame([(w,) for w in sorted(set(words))], f"{col} string")


def spread_if_coarse(df: DataFrame, factor: int = 4, key: str | None = None) -> DataFrame:
    """Round-robin a source that arrives in fewer partitions than the
    cluster runs tasks at once (one big file, one row group).

    Per-row text work (regex tokenisation of long comments) is CPU-bound,
    so a single scan task would leave the other cores idle. A large input
    already has many more partitions than cores and is returned as is, so
    at scale this adds no shuffle. With a ``key`` the spread hash-partitions
    on it (deterministic on retry without the local sort a keyless
    round-robin needs)."""
    from murmur.session import spark_context

    sc = spark_context(df.sparkSession)
    if sc is None:
        return df
    target = sc.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target * factor, F.col(key)) if key else df.repartition(target * factor)
