"""Target-distribution importance resampling through an Aho-Corasick dictionary.

Features are runs of 1 to ``order`` neighbouring words; a feature's bucket is
the CRC-32 of its words joined by one space, modulo ``buckets``. Texts become
bytes in which every non-word byte is the delimiter, so the dictionary holds
frequent words between two delimiters, each with its CRC and byte length as
payload. One scan of the automaton emits the payloads of a text's words in
order; a word that the dictionary lacks leaves a gap, and its payload is
computed on the spot. Payloads of neighbours compose: the CRC of two joined
strings follows from their CRCs and the length of the second (a linear map per
power of two), so longer runs never touch their bytes again.

Three passes over the texts: distinct words are counted (summed in each task
before the shuffle) and the most frequent ones broadcast, at most
``DICTIONARY``; the buckets of the corpus and of the target are counted; every
document is scored and the drawn ones are ranked by a range-partitioned sort of
their digest rows. The dictionary decides speed alone, never a result.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import stored, worker_state
from murmur.llm.flat import text_units
from murmur.operators.rank import sorted_places

#: Words in the broadcast dictionary at most, and the longest such word in bytes.
DICTIONARY, LONGEST = 100_000, 255
#: Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 400_000
DELIMITER = 0x20
#: A cut through a long text may follow any byte that is no part of a word.
CUT = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def byte_map() -> bytes:
    """Lower-cases A-Z and turns all other ASCII but digits and a-z into the delimiter."""
    out = bytearray([DELIMITER] * 0x80 + [*range(0x80, 0x100)])
    for b in (*range(0x30, 0x3A), *range(0x61, 0x7B)):
        out[b] = b
    for b in range(0x41, 0x5B):
        out[b] = b + 0x20
    return bytes(out)


# -- payloads ---------------------------------------------------------------

def zero_tables(levels: int = 40) -> np.ndarray:
    """[level, byte place, byte] -> what 2^level zero bytes do to a CRC's byte."""
    table = np.empty((levels, 4, 256), np.uint32)
    # One zero bit, as the images of the 32 unit vectors; three squarings make a byte.
    images = [0xEDB88320] + [1 << i for i in range(31)]

    def apply(m, x):
        out, i = 0, 0
        while x:
            if x & 1:
                out ^= m[i]
            x >>= 1
            i += 1
        return out

    for _ in range(3):
        images = [apply(images, x) for x in images]
    for level in range(levels):
        for place in range(4):
            for byte in range(256):
                table[level, place, byte] = apply(images, byte << (8 * place))
        images = [apply(images, x) for x in images]
    return table


def followed_by_zeros(crc: np.ndarray, n: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The linear part of appending n bytes to strings with these CRCs."""
    crc, n, level = crc.astype(np.uint32, copy=True), n.astype(np.int64, copy=True), 0
    while n.any():
        at = np.flatnonzero(n & 1)
        x = crc[at]
        crc[at] = (tables[level, 0, x & 0xFF] ^ tables[level, 1, (x >> 8) & 0xFF]
                   ^ tables[level, 2, (x >> 16) & 0xFF] ^ tables[level, 3, x >> 24])
        n >>= 1
        level += 1
    return crc


def joined_crc(crc: np.ndarray, next_crc: np.ndarray, next_length: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The CRCs of strings, a space and further strings, from those of the parts."""
    space = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    tail = followed_by_zeros(space, next_length, tables) ^ next_crc
    return followed_by_zeros(crc, next_length + 1, tables) ^ tail


# -- the automaton ----------------------------------------------------------

def automaton(words: list[bytes]):
    """Finds ``words`` between delimiters; a payload is CRC << 8 | byte length."""
    import ahocorasick

    out = ahocorasick.Automaton()  # stores objects; its integer mode keeps 32 bits alone
    for w in words:
        out.add_word(f" {w.decode('latin-1')} ", zlib.crc32(w) << 8 | len(w))
    if words:
        out.make_automaton()
    return out


def scan(machine, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, CRC and byte length of every word of delimited ``data`` (it begins and ends with a delimiter)."""
    inside = np.frombuffer(data, np.uint8) != DELIMITER
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, lengths = edges[0::2], edges[1::2] - edges[0::2]
    crc, known = np.zeros(len(starts), np.uint32), np.zeros(len(starts), bool)
    if len(machine):
        emitted = np.fromiter(chain.from_iterable(machine.iter(data.decode("latin-1"))), np.int64).reshape(-1, 2)
        at = np.searchsorted(starts, emitted[:, 0] - (emitted[:, 1] & 0xFF))
        crc[at], known[at] = emitted[:, 1] >> 8, True
    for i in np.flatnonzero(~known).tolist():
        a = starts[i]
        crc[i] = zlib.crc32(data[a:a + lengths[i]])
    return starts, crc, lengths


def payloads(machine, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, CRC and byte length of every word of a column of texts, unit by unit.

    A unit holds about a megabyte: many short texts, or a piece of a long one.
    """
    table = byte_map()
    for unit in text_units(column, CUT):
        parts = [raw.translate(table) for _, raw in unit]
        data = b" " + b" ".join(parts) + b" "
        first = np.cumsum([1, *(len(x) + 1 for x in parts)])
        starts, crc, lengths = scan(machine, data)
        rows = np.array([row for row, _ in unit], np.int64)
        yield rows[np.searchsorted(first, starts, side="right") - 1], crc, lengths


def features(machine, column: pa.Array, order: int, buckets: int, tables: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the words, rows of the features, buckets of the features), unit by unit.

    The payloads of a text's last words are carried into its next piece.
    """
    held = (np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.int64))
    for rows, crc, lengths in payloads(machine, column):
        words = rows
        new = len(held[0])
        rows, crc, lengths = (np.concatenate(x) for x in zip(held, (rows, crc, lengths)))
        found_rows, found = [rows[new:]], [crc[new:] % np.uint32(buckets)]
        run = crc
        for size in range(2, order + 1):
            n = len(rows) - size + 1
            if n <= 0:
                break
            run = joined_crc(run[:n], crc[size - 1:], lengths[size - 1:], tables)
            keep = (rows[:n] == rows[size - 1:]) & (np.arange(n) + size > new)
            found_rows.append(rows[:n][keep])
            found.append(run[keep] % np.uint32(buckets))
        yield words, np.concatenate(found_rows), np.concatenate(found)
        if order > 1:
            held = (rows[1 - order:], crc[1 - order:], lengths[1 - order:])


# -- the Spark jobs ---------------------------------------------------------

def frequent_words(texts: DataFrame, most: int = DICTIONARY, held: int = HELD_WORDS) -> list[bytes]:
    """The words that occur more often than a bound set so that at most ``most`` do.

    Counts are exact over all texts and stay in Spark; the driver receives a
    histogram of counts and the chosen words.
    """
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        table, seen = byte_map(), Counter()

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], schema=schema)

        for batch in batches:
            for unit in text_units(batch.column(0), CUT):
                seen.update(w for _, raw in unit for w in raw.translate(table).split() if len(w) <= LONGEST)
                if len(seen) > held:
                    yield batch_of()
                    seen.clear()
        yield batch_of()

    counted = stored(texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # Classes of counts, 16 to each power of two: a few hundred rows, whatever the corpus.
    step = F.floor(F.log2(F.col("n")) * 16).cast("int")
    bound, total = None, 0
    for r in sorted(counted.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > most:
            break
        bound = r["step"]
    return [bytes(r["word"]) for r in counted.filter(step >= bound).select("word").collect()] if bound is not None else []


def bucket_counts(texts: DataFrame, shared, order: int, buckets: int) -> np.ndarray:
    """How many features of ``texts`` fall into each bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        key, words, tables = shared.value
        machine = worker_state(key, lambda: automaton(words))
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket in features(machine, batch.column(0), order, buckets, tables):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], schema=schema)

    out = [0] * buckets
    for r in texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """Floored thousandths of each bucket's log ratio of target to corpus, one added to every count."""
    s_all, t_all, n = sum(corpus), sum(target), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(corpus, target)], np.int64)


def noise(seed: str, doc_id) -> int:
    """Floored thousandths of Gumbel noise drawn from a hash of the seed and the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, shared, gain: np.ndarray, order: int, seed: str) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of (doc_id, text)."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight", "score")])

    def score(batches):
        key, words, tables = shared.value
        machine = worker_state(key, lambda: automaton(words))
        for batch in batches:
            n_words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for word_rows, rows, bucket in features(machine, batch.column("text"), order, len(gain), tables):
                n_words += np.bincount(word_rows, minlength=batch.num_rows)
                n += np.bincount(rows, minlength=batch.num_rows)
                np.add.at(total, rows, gain[bucket])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            ids = batch.column("doc_id")
            drawn = np.array([noise(seed, i) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n_words, n, weight, weight + drawn))], schema=schema)

    return docs.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def target_resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
                    order: int = 1, buckets: int = 10_000, seed: str = "2024", least_words: int = 20, percent: int = 10,
                    dictionary: int = DICTIONARY) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``.

    Of the N rows with at least ``least_words`` words, the floor(percent * N /
    100) with the greatest score are drawn and ranked from 1; ties go to the
    smaller id, null ids before all others. A null or empty text has no
    feature and weight 0; a null id draws its noise from the seed alone.
    Repeated rows are scored and ranked each, next to each other. Texts of any
    length are scanned in pieces. An empty target leaves the added counts
    alone; an empty table gives an empty result. Columns of ``docs`` other
    than the two named ones play no part, whatever their names.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    goal = target.select(F.col(target_text).alias("text"))
    words = frequent_words(rows.select("text").unionByName(goal), dictionary)
    shared = docs.sparkSession.sparkContext.broadcast((f"automaton-{uuid.uuid4().hex}", words, zero_tables()))
    gain = gains(bucket_counts(rows.select("text"), shared, order, buckets), bucket_counts(goal, shared, order, buckets))
    table = stored(scored(rows, shared, gain, order, seed), "scores")
    long_enough = F.col("n_words") >= least_words
    drawn = table.filter(long_enough).count() * percent // 100
    placed = sorted_places(table.filter(long_enough), [F.col("score").desc(), F.col("doc_id").asc_nulls_first()])
    before = F.sum("n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    offsets = placed.groupBy("_pid").agg(F.count("*").alias("n")).select("_pid", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_li") + 1
    out = placed.join(offsets, "_pid").withColumn("rank", F.when(number <= drawn, number))
    rest = table.filter(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return out.select(columns).unionByName(rest.select(columns))


#: The same result in DuckDB; a CRC is folded over the bytes of each distinct word.
SQL = r"""
WITH RECURSIVE bits(x, v, k) AS (
  SELECT x, x::BIGINT, 0 FROM range(256) r(x)
  UNION ALL SELECT x, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
t AS (SELECT list(v ORDER BY x) AS t FROM bits WHERE k = 8),
o AS MATERIALIZED (SELECT doc_id, text, row_number() OVER () AS row FROM documents),
w AS (SELECT 0 AS side, row, unnest(regexp_extract_all(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM o
      UNION ALL
      SELECT 1, 0, unnest(regexp_extract_all(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
x AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM w)),
c AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2),
        lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM x, t),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM w JOIN c USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)
                               / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000))))::BIGINT AS gain FROM n),
d AS (SELECT row, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
      FROM w JOIN c USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY row),
a AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
      FROM o LEFT JOIN d USING (row)),
s AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM a),
r AS (SELECT *, n_features >= 20 AS may, count(*) FILTER (n_features >= 20) OVER () AS total FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id NULLS FIRST) AS place FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 10 * total // 100 THEN place END AS rank FROM p
"""
