"""Sharding by histogram sort.

The order is that of a 63-bit key: the text's hash, then the id's hash, so
equal texts stand together and the order is otherwise random. To cut the
order into shards of equal bytes, candidate keys are probed: every pass counts
the exact bytes below each candidate across all partitions (one small sum per
task), and the next candidates lie between the two that enclose each wanted
cut, until every cut is within tolerance. Only then are the rows exchanged,
once, straight to their final place.

A cut between shards is first sought between texts, by counting below values
of the text's hash alone, so that equal texts share a shard; only where no
such cut lies within ``GROUP_TOLERANCE`` of a shard (one text's rows are too
many bytes) it goes through that text's rows.

Each shard consists of many parts, cut by the same histogram, so no task
holds a shard. A row's slot is its part's first slot plus its rank there. The
driver holds a few numbers per part, and PROBES candidate keys per open cut;
beyond ``PARTS`` parts it is their size that grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import fresh, stored, utf8_size, without

#: Candidate keys per wanted cut and pass, bytes a part should hold, and parts at most.
PROBES, PART_BYTES, PARTS = 32, 32 << 20, 12_000
#: How far a cut may lie from its place to keep equal texts together, as a share of a shard's bytes.
GROUP_TOLERANCE = 0.025
#: Bits of the key that tell rows of one text hash apart.
ID_BITS = 24


def below(table: DataFrame, key: str, weight: str, candidates: np.ndarray) -> np.ndarray:
    """Exact total weight of rows with key < c, for each of the sorted candidates c."""
    schema = pa.schema([("place", pa.int32()), ("weight", pa.int64())])

    def count(batches):
        total = np.zeros(len(candidates) + 1, np.int64)
        for batch in batches:
            place = np.searchsorted(candidates, batch.column(0).to_numpy(), side="right")
            np.add.at(total, place, batch.column(1).to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], schema=schema)

    sums = table.select(key, weight).mapInArrow(count, "place int, weight long").groupBy("place").agg(F.sum("weight").alias("weight"))
    found = np.zeros(len(candidates) + 1, np.int64)
    for row in sums.collect():  # at most one row per candidate
        found[row["place"]] = row["weight"]
    return np.cumsum(found)[:-1]


def splitters(table: DataFrame, key: str, weight: str, wanted: list[int], tolerance: list[int],
              probes: int = PROBES) -> list[tuple[int, int]]:
    """(key, weight below it) nearest to each wanted weight (ascending), within its
    tolerance or as near as rows of one key allow."""
    ends = table.agg(F.min(key), F.max(key), F.sum(weight)).first()
    if ends[0] is None:
        return [(0, 0)] * len(wanted)
    low = [(int(ends[0]), 0)] * len(wanted)
    high = [(int(ends[1]) + 1, int(ends[2]))] * len(wanted)

    def nearest(i):
        return min(low[i], high[i], key=lambda x: abs(x[1] - wanted[i]))

    while True:
        open_ = [i for i, w in enumerate(wanted) if abs(nearest(i)[1] - w) > tolerance[i] and high[i][0] - low[i][0] > 1]
        if not open_:
            return [nearest(i) for i in range(len(wanted))]
        probe = {low[i][0] + (high[i][0] - low[i][0]) * j // (probes + 1) for i in open_ for j in range(1, probes + 1)}
        candidates = np.array(sorted(probe), np.int64)
        counted = below(table, key, weight, candidates)
        for i in open_:
            at = int(np.searchsorted(counted, wanted[i], side="right"))
            for c, n in zip(candidates[max(0, at - 1):at + 1].tolist(), counted[max(0, at - 1):at + 1].tolist()):
                if n <= wanted[i] and c > low[i][0]:
                    low[i] = (c, n)
                elif n > wanted[i] and c < high[i][0]:
                    high[i] = (c, n)


def shard(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES,
          tolerance: float = 0.001, most_parts: int = PARTS) -> DataFrame:
    """``docs`` with size, shard and slot; all columns are kept.

    A row's size is its text's UTF-8 bytes (null: none) plus 8. Shard sizes
    differ from the mean by at most ``tolerance`` of it on either side, or by
    one row where a row is larger than that; where equal texts would be parted,
    by up to twice ``GROUP_TOLERANCE``, and only a text whose rows leave no such
    cut lies in more than one shard. Null ids and texts hash as such;
    repeated rows are placed each, side by side; long texts count their bytes
    alone. An empty table gives an empty result. Columns named size, shard or slot are replaced.
    """
    docs = without(docs, "size", "shard", "slot")
    key, part = fresh(docs, "sort_key", "part")
    text_hash = F.shiftrightunsigned(F.xxhash64(F.col(text)), 25)  # 39 bits
    id_hash = F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col(doc_id)), 64 - ID_BITS)
    keyed = docs.withColumn(key, F.shiftleft(text_hash, ID_BITS).bitwiseOR(id_hash)).withColumn("size", utf8_size(F.col(text)) + 8)
    table = stored(keyed.select(F.col(key).alias("key"), "size"), "keys")
    total = int(table.agg(F.sum("size")).first()[0] or 0)
    each = max(1, min(-(-total // (shards * part_bytes)), most_parts // shards))  # parts per shard
    n = shards * each
    wanted = [total * i // n for i in range(1, n)]
    # Cuts between shards are fine, those between a shard's parts need not be.
    slack = [int(tolerance * total / shards / 2) if i % each == 0 else total // n // 8 for i in range(1, n)]
    found = [c for c, _ in splitters(table, "key", "size", wanted, slack)] if wanted else []
    borders = [i for i in range(1, n) if i % each == 0]
    texts = table.select(F.shiftright("key", ID_BITS).alias("text"), "size")
    near = GROUP_TOLERANCE * total / shards
    for i, (text_key, below_it) in zip(borders, splitters(texts, "text", "size", [wanted[i - 1] for i in borders], [slack[i - 1] for i in borders])):
        if abs(below_it - wanted[i - 1]) <= near:
            found[i - 1] = text_key << ID_BITS
    bounds = np.maximum.accumulate(np.array(found, np.int64)) if found else np.empty(0, np.int64)
    if borders:
        # The cuts between a shard's parts stay inside it, wherever its borders have moved to.
        edges = np.r_[np.iinfo(np.int64).min, np.maximum.accumulate([found[i - 1] for i in borders]), np.iinfo(np.int64).max]
        for i in range(1, n):
            s = i // each
            bounds[i - 1] = edges[s] if i % each == 0 else min(max(found[i - 1], edges[s]), edges[s + 1])

    @F.pandas_udf("int")
    def part_of(k: pd.Series) -> pd.Series:
        """The number of bounds at or below each key."""
        return pd.Series(np.searchsorted(bounds, k.to_numpy(), side="right").astype("int32"))

    rows = np.zeros(n, np.int64)
    for r in table.groupBy(part_of("key").alias("part")).agg(F.count("*").alias("rows")).collect():  # a row per part
        rows[r["part"]] = r["rows"]
    before = np.cumsum(rows) - rows
    first = before - np.repeat(before[::each], each)  # each part's first slot in its shard

    @F.pandas_udf("long")
    def first_slot(p: pd.Series) -> pd.Series:
        return pd.Series(first[p.to_numpy()])

    # The exchange: every row straight to its part, one part a task, so the ranks need no other.
    placed = keyed.withColumn(part, part_of(key)).repartitionById(n, part)
    rank = F.row_number().over(Window.partitionBy(part).orderBy(key, doc_id))
    return (placed.withColumn("slot", rank - 1 + first_slot(part))
            .withColumn("shard", F.floor(F.col(part) / each).cast("int")).drop(part, key))


def shard_digest(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Nulls, empty and long texts, ties, repeated rows and empty tables as in ``shard``.
    """
    out = shard(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shards)
    return out.select("doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
                      F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))
