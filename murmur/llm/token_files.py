"""Token ids in fixed-width bit-packed segments.

File format: a folder with two Parquet tables.

``segments``: one row per segment, a run of whole documents in id order.
    part, segment   position in the corpus order
    bits            width of an id: the least that holds vocabulary_size - 1
    n_ids           ids in the segment
    block_ids       ids per block (a multiple of 8, so blocks start at whole bytes)
    block_offsets   byte offset of each block in ``payload``
    payload         ids packed little-endian, lowest bit first
    doc_ids, firsts each document's id and its first id's place in the segment
``parts``: part, n_ids, start (ids of all parts before it)

Any id range is found by offsets alone: the blocks that hold it are sliced
from the payload and unpacked by numpy shifts, eight ids at a time. Spark
writes both tables with its commit protocol, so a lost executor or a repeated
task leaves no partial or doubled segment, and any file system will do.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm.byte_bpe import character_classes, encoder
from murmur.llm.common import byte_slices, texts_of, utf8_size
from murmur.session import scratch_path

BLOCK_IDS = 4096
#: Text that one written part holds, in bytes.
PART_BYTES = 16 << 20


def width(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, lowest bit first; eight ids fill ``bits`` bytes."""
    n = len(ids)
    rows = np.zeros((-(-n // 8), 8), np.uint64)
    rows.ravel()[:n] = ids
    out = np.zeros((len(rows), bits), np.uint8)
    for k in range(8):
        first, shift = divmod(k * bits, 8)
        value = rows[:, k] << np.uint64(shift)
        for j in range((shift + bits + 7) // 8):
            out[:, first + j] |= ((value >> np.uint64(8 * j)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: -(-n * bits // 8)]


def unpack(payload: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a packed run."""
    groups = -(-n // 8)
    raw = np.zeros(groups * bits, np.uint8)
    got = np.frombuffer(payload, np.uint8)[: len(raw)]
    raw[: len(got)] = got
    raw = raw.reshape(groups, bits)
    out = np.zeros((groups, 8), np.uint32)
    keep = np.uint64((1 << bits) - 1)
    for k in range(8):
        first, shift = divmod(k * bits, 8)
        value = np.zeros(groups, np.uint64)
        for j in range((shift + bits + 7) // 8):
            value |= raw[:, first + j].astype(np.uint64) << np.uint64(8 * j)
        out[:, k] = (value >> np.uint64(shift)) & keep
    return out.ravel()[:n]


def slice_ids(payload: bytes, bits: int, block_ids: int, block_offsets, a: int, b: int) -> np.ndarray:
    """Ids a to b of a segment, from the blocks that hold them alone."""
    if b <= a:
        return np.empty(0, np.uint32)
    first, last = a // block_ids, (b - 1) // block_ids
    start = int(block_offsets[first])
    end = int(block_offsets[last + 1]) if last + 1 < len(block_offsets) else len(payload)
    return unpack(payload[start:end], bits, b - first * block_ids)[a - first * block_ids:]


SEGMENT = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("bits", pa.int32()), ("n_ids", pa.int64()),
                     ("block_ids", pa.int32()), ("block_offsets", pa.list_(pa.int64())), ("payload", pa.binary()),
                     ("doc_ids", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int64()))])
SEGMENT_DDL = ("part int, segment int, bits int, n_ids long, block_ids int, block_offsets array<long>, payload binary, "
               "doc_ids array<long>, firsts array<long>")


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int, vocabulary_size: int,
                      doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> None:
    """Encode every text, append ``end_id``, and write the ids in ascending doc_id order.

    Null texts count as empty (their only id is ``end_id``); null ids sort
    first; repeated ids keep all their rows. An empty table writes empty
    files. The rows are range partitioned once by id (equal ids by their
    text's hash as well), so each part is a contiguous run of the order.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared = spark.sparkContext.broadcast((spec, character_classes(spec)))
    bits = width(vocabulary_size)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(utf8_size(F.col("text")))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    order = ["doc_id", F.xxhash64("text")]
    placed = rows.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)

    def segments(batches):
        enc = encoder(*shared.value)
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in byte_slices(batch.column("text"), 2 << 20):
                ids, offsets = enc.encode(texts_of(batch.column("text").slice(a, b - a)))
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
                blocks = np.arange(0, max(1, len(ids)), BLOCK_IDS) * bits // 8
                row = [part, number, bits, len(ids), BLOCK_IDS, blocks.tolist(), pack(ids, bits),
                       batch.column("doc_id").slice(a, b - a).to_pylist(), offsets[:-1].tolist()]
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SEGMENT)], schema=SEGMENT)

    placed.mapInArrow(segments, SEGMENT_DDL).write.parquet(f"{path}/segments")
    sizes = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    # One row per part: the running sum is over a table that is the corpus divided by part_bytes.
    start = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes.withColumn("start", F.coalesce(start, F.lit(0))).write.parquet(f"{path}/parts")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the ids' crc32, unpacked from the files segment by segment."""
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("first", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def check(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                n, firsts = row["n_ids"], np.asarray(row["firsts"], np.int64)
                ids = slice_ids(row["payload"], row["bits"], row["block_ids"], row["block_offsets"], 0, n).astype("<u4")
                raw, ends = memoryview(ids.tobytes()), np.r_[firsts[1:], n]
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(firsts.tolist(), ends.tolist())]
                k = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip(([row["part"]] * k, [row["segment"]] * k, row["doc_ids"], firsts,
                                                          ends - firsts, crc), schema)], schema=schema)

    whole = spark.read.parquet(f"{path}/segments")
    docs = whole.mapInArrow(check, "part int, segment int, doc_id long, first long, n_tokens long, ids_crc32 long")
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    places = (whole.select("part", "segment", "n_ids").withColumn("before", F.coalesce(before, F.lit(0)))
              .join(spark.read.parquet(f"{path}/parts").select("part", "start"), "part")
              .select("part", "segment", (F.col("start") + F.col("before")).alias("base")))
    return (docs.join(places, ["part", "segment"])
            .select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"))


def read_range(spark: SparkSession, path: str, start: int, n: int) -> np.ndarray:
    """The ``n`` ids from global place ``start`` on, reading only the segments that hold them.

    Returns to the caller what it asked for, so ``n`` bounds the memory.
    """
    end = start + n
    parts = spark.read.parquet(f"{path}/parts").filter((F.col("start") < end) & (F.col("start") + F.col("n_ids") > start)).collect()
    out = []
    for p in sorted(parts, key=lambda r: r["start"]):
        own = spark.read.parquet(f"{path}/segments").filter(F.col("part") == p["part"])
        at, wanted = p["start"], []
        for s in own.select("segment", "n_ids").orderBy("segment").collect():
            if at < end and at + s["n_ids"] > start:
                wanted.append((s["segment"], max(0, start - at), min(s["n_ids"], end - at)))
            at += s["n_ids"]
        held = {r["segment"]: r for r in own.filter(F.col("segment").isin([w[0] for w in wanted])).collect()}
        for k, a, b in wanted:
            r = held[k]
            out.append(slice_ids(bytes(r["payload"]), r["bits"], r["block_ids"], r["block_offsets"], a, b))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary_size: int) -> DataFrame:
    """Write the files into shared scratch, then describe each document from what they hold.

    Null, empty and long texts, null and repeated ids and empty tables as in ``write_token_files``.
    """
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer_path, path, end_id, vocabulary_size)
    return read_documents(docs.sparkSession, path)
