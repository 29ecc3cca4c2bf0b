"""Token counts without a shuffle of pre-tokens.

Two tiers on the map side. Tier one is a compact open-addressing table
(64-bit hash -> token count) of the pre-tokens that are frequent in the whole
corpus, broadcast to every worker; its size is fixed by ``table_size``, not
by the corpus. Tier two is the worker's own bounded cache, filled from the
tokenizers library for the pre-tokens that tier one lacks.

The frequent pre-tokens come from mergeable frequent-items sketches, one per
map task, merged in two steps; only sketches travel. What the table holds
changes the speed, never a count: the library counted each entry.

A null text counts as empty. An empty table gives an empty result. Very long
texts are passes of their own; nothing is cut. Working columns avoid clashes
because only the id and the text are read. Repeated rows are counted each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.byte_bpe import PIECE, Encoder, Pretokens, character_classes, library_tokenizer
from murmur.llm.common import per_slice, texts_of, utf8_size, worker_state
from murmur.llm.flat import hash_spans, mix64, code_points

#: Frequent pre-tokens in the broadcast table, and items each sketch tracks (a bound on both sizes).
TABLE_SIZE, TRACKED = 10_000, 40_000
#: The splitter's pattern, for candidate strings only; the exact split is byte_bpe's.
CANDIDATES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def frequent_pretokens(docs: DataFrame, text: str = "text", size: int = TABLE_SIZE, tracked: int = TRACKED,
                       groups: int = 64) -> list[str]:
    """About the ``size`` most frequent pre-tokens of all texts (at most ``size`` strings)."""
    pre = docs.select(F.spark_partition_id().alias("task"),
                      F.explode(F.regexp_extract_all(F.col(text), F.lit(CANDIDATES), F.lit(0))).alias("pre"))
    sketches = pre.groupBy("task").agg(F.expr(f"approx_top_k_accumulate(pre, {tracked})").alias("s"))
    some = sketches.groupBy((F.col("task") % groups).alias("g")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))
    # A grouping key, though constant, keeps empty partitions from making empty sketches.
    row = (some.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))
           .select(F.expr(f"approx_top_k_estimate(s, {size})").alias("top")).first())
    return [x["item"] for x in row["top"]] if row else []


class HashTable:
    """Open addressing with linear probing over two numpy arrays; zero marks a free place."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, probes: int):
        self.keys, self.values, self.probes = keys, values, probes
        self.mask = np.int64(len(keys) - 1)

    @classmethod
    def of(cls, hashes: np.ndarray, values: np.ndarray) -> HashTable:
        """A table at most half full of the given (non-zero) hashes."""
        size = 1 << max(4, (2 * len(hashes) - 1).bit_length())
        keys, held, probes = np.zeros(size, np.uint64), np.zeros(size, np.int32), 1
        for h, v in zip(hashes.tolist(), values.tolist()):
            at, step = h & (size - 1), 1
            while keys[at] not in (0, h):
                at, step = (at + 1) & (size - 1), step + 1
            keys[at], held[at] = h, v
            probes = max(probes, step)
        return cls(keys, held, probes)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Values, and -1 where a hash is not held."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        at = (hashes & np.uint64(self.mask)).astype(np.int64)
        for _ in range(self.probes):
            key = self.keys[at[left]]
            hit = key == hashes[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (key != 0)]
            if not len(left):
                break
            at[left] = (at[left] + 1) & self.mask
        return out


def frequent_table(spec: str, strings: list[str]) -> HashTable:
    """The library's token count of each string, keyed by the string's hash."""
    strings = [s for s in dict.fromkeys(strings) if s]
    counts = [len(x.ids) for x in library_tokenizer(spec).encode_batch_fast(strings, add_special_tokens=False)]
    cps, offsets = code_points(strings)
    return HashTable.of(hash_spans(mix64(cps.astype(np.uint64)), offsets[:-1], offsets[1:]), np.asarray(counts, np.int32))


class Counter(Encoder):
    """An encoder that keeps only how many ids a pre-token has."""

    def count(self, texts: list[str], table: HashTable) -> np.ndarray:
        if len(texts) == 1 and len(texts[0]) > PIECE and not self.has_special(texts[0]):
            return sum(self.count_batch([p], table) for p in self.pieces(texts[0]))
        return self.count_batch(texts, table)

    def count_batch(self, texts: list[str], table: HashTable) -> np.ndarray:
        plain, whole = self.split(texts)
        pre = Pretokens(plain, self.classes)
        each = table.lookup(pre.hashes)
        missed = np.flatnonzero(each < 0)
        uniq, index, place = np.unique(pre.hashes[missed], return_index=True, return_inverse=True)
        each[missed] = self.counts_of(uniq, pre, missed[index])[place]
        out = np.bincount(pre.owner, weights=each, minlength=len(texts)).astype(np.int64)
        for i, ids in whole.items():
            out[i] = len(ids)
        return out

    def counts_of(self, hashes: np.ndarray, pre: Pretokens, index: np.ndarray) -> np.ndarray:
        keys = hashes.tolist()
        out = self.known.get(keys)
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            for i, ids in zip(missing, self.library(pre.strings(index[missing]))):
                out[i] = len(ids)
                self.known.put(keys[i], len(ids))
        return np.asarray(out, np.int64)


def count_tokens(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
                 limit: int = 1024, table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens exceeds ``limit``, for every row.

    ``tokenizer_path`` is a tokenizers .json with a byte-level BPE; the driver
    reads it (its size is that of a vocabulary) and ships it with the tasks.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    runs = character_classes(spec)
    table = frequent_table(spec, frequent_pretokens(docs, text, table_size))
    shared = spark.sparkContext.broadcast((spec, runs, table.keys, table.values, table.probes))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batch):
        spec, runs, *arrays = shared.value
        counter = worker_state(f"count-{hash(spec)}", lambda: Counter(spec, runs))
        return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"),
                "n_tokens": counter.count(texts_of(batch.column("text")), HashTable(*arrays))}

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       utf8_size(F.col(text)).alias("n_bytes"))
    out = rows.mapInArrow(per_slice(count, schema, limit=2 << 20), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
