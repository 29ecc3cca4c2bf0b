import zlib

import numpy as np
from murmur.llm import histogram_sort
from pyspark.sql import functions as F


def test_below_counts_exactly(spark):
    keys = np.random.default_rng(0).integers(0, 1000, 3000)
    df = spark.createDataFrame([(int(k), int(k) % 7 + 1) for k in keys], "k long, w long").repartition(6)
    cuts = np.array([0, 1, 500, 500, 999, 2000])
    want = [int(((keys % 7 + 1) * (keys < c)).sum()) for c in cuts]
    assert histogram_sort.below(df, "k", "w", cuts).tolist() == want


def test_splitters_meet_their_tolerance_or_a_tie(spark):
    keys = np.random.default_rng(1).integers(-(1 << 61), 1 << 61, 5000)
    df = spark.createDataFrame([(int(k), 1) for k in keys], "k long, w long").repartition(4)
    for key, n in histogram_sort.splitters(df, "k", "w", [100, 2500, 2501, 4999], [0, 0, 0, 0]):
        assert int((keys < key).sum()) == n
    got = [n for _, n in histogram_sort.splitters(df, "k", "w", [100, 2500, 4999], [0, 0, 0])]
    assert got == [100, 2500, 4999]
    ties = spark.createDataFrame([(5, 1)] * 100 + [(6, 1)], "k long, w long")
    assert [n for _, n in histogram_sort.splitters(ties, "k", "w", [40, 80], [0, 0])] == [0, 100]


def check(df, shards, **options):
    out = histogram_sort.shard(df, shards, **options).cache()
    rows = out.collect()
    assert len(rows) == df.count()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r["size"] == len((r.text or "").encode()) + 8 for r in rows)
    return rows


def test_bytes_are_near_equal_and_slots_gapless(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"))
    for options in ({}, {"part_bytes": 8000}):
        rows = check(df, 24, **options)
        size = [sum(r["size"] for r in rows if r.shard == s) for s in range(24)]
        assert max(size) - min(size) <= (0.002 + 4 * histogram_sort.GROUP_TOLERANCE) * sum(size) / 24 + 2 * 98


def test_equal_texts_stand_together_and_a_hot_text_is_split(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the hot text")
                                  .otherwise(F.concat(F.lit("text "), F.col("id") % 500)).alias("text"))
    rows = check(df, 10)
    hot = {r.shard for r in rows if r.text == "the hot text"}
    assert len(hot) >= 3 and max(hot) - min(hot) == len(hot) - 1
    cut = [t for t in {r.text for r in rows} - {"the hot text"} if len({r.shard for r in rows if r.text == t}) > 1]
    assert cut == []


def test_given_documents_part_no_group_and_many_parts_keep_to_their_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    for options in ({}, {"part_bytes": 20_000, "most_parts": 24 * 40}):
        out = histogram_sort.shard(docs, 24, **options).groupBy("text", "shard").agg(F.sum("size").alias("size")).collect()
        assert len({r.text for r in out}) == len(out)
        size = np.bincount([r.shard for r in out], weights=[r["size"] for r in out])
        assert len(size) == 24 and np.abs(size / size.mean() - 1).max() <= 2 * histogram_sort.GROUP_TOLERANCE


def test_parts_and_probes_are_bounded(spark, monkeypatch):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    probes, below = [], histogram_sort.below
    monkeypatch.setattr(histogram_sort, "below", lambda t, k, w, c: probes.append(len(c)) or below(t, k, w, c))
    rows = check(df, 5, part_bytes=10, most_parts=50)
    assert len({r.shard for r in rows}) == 5 and max(probes) <= 50 * histogram_sort.PROBES


def test_edge_rows(spark, edge, none):
    rows = check(edge, 3)
    assert set(rows[0].__fields__) == set(edge.columns) | {"shard", "slot"}
    assert histogram_sort.shard(none, 3).count() == 0
    d = histogram_sort.shard_digest(edge, 3).collect()
    texts = {r.doc_id: r.text for r in edge.collect()}
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None for r in d)
