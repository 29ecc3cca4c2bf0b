"""Quality rules by compression bands.

Each text is compressed with zstandard, whole and in fixed chunks; the last
bytes that fill no chunk are judged with those before them, as one more
chunk. A text shorter than a chunk is one by itself: its whole ratio. The ratio
of compressed to raw bytes falls when a text repeats itself and rises towards
one when it is noise; both depend on the length, so every length class has
its own band. A text is kept when its whole ratio lies in its band, the share
of its chunks outside theirs and their longest run stay within the limits,
and no base rule failed.

The bands are a parameter. Where the caller gives none, they are learned from
the labels that come with the documents: the outer quantiles of the ratios of
all labelled good documents, widened by a margin. All ratios are measured
once, in one pass over the texts; bands and verdicts come from that table.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import SLICE_BYTES, per_slice, stored
from murmur.llm.flat import byte_texts, counts_to_offsets, hash_spans, long_cuts, spans, symbol_values, text_of, windows

CHUNK_BYTES = 2048
LEVEL = 3
#: Shortest lengths in bytes of the classes of whole texts; shorter texts have no band.
CLASSES = (200, 400, 600, 800, 1000, 1400, 2000, 3000, 5000, 10000, 20000)
#: The share of labelled good ratios that lies below, and above, a band before it is widened by MARGIN at both ends.
OUTSIDE, MARGIN = 0.001, 0.01
#: Ratios that a class needs for a band of its own; texts of a class with fewer are judged by their chunks alone.
LEAST_RATIOS = 30
#: The greatest share of chunks outside the band of chunks.
CHUNK_SHARE = 0.02
#: So many neighbouring chunks outside the band fail a text, however long it is.
CHUNK_RUN = 2
SYMBOLS = b"#*$%&|<>"
CUT = re.compile(rb"[\x20\x09-\x0D]")


class Bands(NamedTuple):
    """(shortest length in bytes, least and greatest ratio) per class of whole texts, and (least, greatest) of a chunk.

    A class without a band has None for both; texts below the first class have none."""

    whole: tuple
    chunk: tuple


def base_features(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Word, symbol, line and repetition counts of all texts, from their bytes.

    Words are runs without ASCII white space. Equal words and lines are
    found by 64-bit hashes.
    """
    n = len(offsets) - 1
    values = symbol_values(5)[raw]
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    starts, ends = spans(~blank[raw], offsets)
    owner = text_of(starts, offsets)
    n_words = np.bincount(owner, minlength=n)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    at = at[~blank[raw[at]]]
    word_chars = np.bincount(text_of(at, offsets), minlength=n)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    n_symbols = np.bincount(text_of(np.flatnonzero(symbol[raw]), offsets), minlength=n)
    # Lines with a word that equal an earlier line of their text.
    ls, le = spans(raw != 0x0A, offsets)
    seen = np.r_[0, np.cumsum(~blank[raw])]
    full = seen[le] > seen[ls]
    ls, le = ls[full], le[full]
    line_owner = text_of(ls, offsets)
    n_dup_lines = repeats(hash_spans(values, ls, le), line_owner, n)
    # Words inside a 3-word window that the text has twice or more.
    first = counts_to_offsets(owner, n)
    h, of = windows(hash_spans(values, starts, ends), first, 3)
    place = np.searchsorted(of, np.arange(n + 1))
    again = twice(h, of)
    begin = np.arange(len(h)) - place[of] + first[of]
    covered = np.zeros(len(starts) + 3, bool)
    for j in range(3):
        covered[begin[again] + j] = True
    n_repeat = np.bincount(owner[covered[:len(starts)]], minlength=n)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
            "n_repeat_words": n_repeat}


def long_features(raw: bytes, step: int) -> dict[str, np.ndarray]:
    """``base_features`` of one long text, in pieces: what is held for the whole text is a hash per word and per line."""
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    table, hashes = symbol_values(5), []
    word_chars = n_symbols = 0
    for piece in long_cuts(raw, step, CUT):
        part, offsets = np.frombuffer(piece, np.uint8), np.array([0, len(piece)])
        starts, ends = spans(~blank[part], offsets)
        hashes.append(hash_spans(table[part], starts, ends))
        word_chars += int((((part & 0xC0) != 0x80) & ~blank[part]).sum())
        n_symbols += sum(piece.count(SYMBOLS[i:i + 1]) for i in range(len(SYMBOLS)))
    words = np.concatenate(hashes)
    lines, a = [], 0
    held = memoryview(raw)
    while a <= len(raw):
        b = raw.find(b"\n", a)
        b = len(raw) if b < 0 else b
        if raw[a:b].strip(b"\x20\x09\x0A\x0B\x0C\x0D"):
            lines.append(int.from_bytes(blake2b(held[a:b], digest_size=8).digest(), "little"))
        a = b + 1
    line = np.array(lines, np.uint64)
    n_dup = len(line) - len(np.unique(line))
    h, _ = windows(words, np.array([0, len(words)]), 3)
    again = np.flatnonzero(twice(h, np.zeros(len(h), np.int64)))
    covered = np.zeros(len(words) + 3, bool)
    for j in range(3):
        covered[again + j] = True
    values = {"n_words": len(words), "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": int(covered.sum())}
    return {name: np.array([value]) for name, value in values.items()}


def twice(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether an item's hash occurs twice or more under its owner."""
    order = np.lexsort((h, owner))
    same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out = np.zeros(len(h), bool)
    out[order] = np.r_[False, same] | np.r_[same, False] if len(h) else False
    return out


def repeats(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per owner, items that equal an earlier one."""
    order = np.lexsort((h, owner))
    same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return np.bincount(owner[order][1:][same], minlength=n)


def compression_features(column: pa.Array, chunk: int = CHUNK_BYTES, level: int = LEVEL) -> dict[str, list]:
    """The ratio of every whole text (null if empty) and of each of its chunks, the last ``chunk`` bytes among them."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
    ratio, chunks = [], []
    for raw in column.cast(pa.large_binary()).to_pylist():
        raw = raw or b""
        ratio.append(len(packer.compress(raw)) / len(raw) if raw else None)
        starts = [*range(0, len(raw) - chunk + 1, chunk)]
        if starts and len(raw) % chunk:
            starts.append(len(raw) - chunk)
        chunks.append([len(packer.compress(raw[i:i + chunk])) / chunk for i in starts])
    return {"ratio": ratio, "chunk_ratios": chunks}


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", step: int = SLICE_BYTES) -> DataFrame:
    """The base counts, ratios and base verdict of every row; a text longer than ``step`` bytes is counted in pieces."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()),
                        ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
                        ("ratio", pa.float64()), ("chunk_ratios", pa.list_(pa.float64()))])

    def measure(batch):
        raw, offsets = byte_texts(batch.column("text"))
        long = batch.num_rows == 1 and len(raw) > step
        return ({"doc_id": batch.column("doc_id"), "n_bytes": np.diff(offsets)} | (long_features(raw.tobytes(), step) if long else base_features(raw, offsets))
                | compression_features(batch.column("text")))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(per_slice(measure, schema, limit=step),
                          "doc_id long, n_bytes long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                          "n_repeat_words long, ratio double, chunk_ratios array<double>")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def learn_bands(measures: DataFrame, labels: DataFrame | None, classes=CLASSES, outside: float = OUTSIDE, margin: float = MARGIN,
                least: int = LEAST_RATIOS) -> Bands:
    """The bands of labelled good, non-toxic documents that pass the base rules.

    ``measures`` is what ``measured`` gives. Without such a label, all documents
    that pass the base rules take their place. Quantiles are exact over ratios
    of four decimals, so their state does not grow with the rows; a class (or
    the chunks) with fewer than ``least`` ratios has no band.
    """
    rows = measures.filter(~F.col("base_failed"))
    if labels is not None:
        good = (labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
                .agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).filter("q = 1 and t = 0").select("doc_id"))
        labelled = rows.join(good, "doc_id", "left_semi")
        rows = labelled if not labelled.isEmpty() else rows
    kind = F.lit(None).cast("int")
    for shortest in classes:
        kind = F.when(F.col("n_bytes") >= shortest, shortest).otherwise(kind)
    whole = rows.select(kind.alias("kind"), F.col("ratio").alias("x")).filter("kind is not null")
    chunks = rows.select(F.lit(0).alias("kind"), F.explode("chunk_ratios").alias("x"))
    found = (whole.unionByName(chunks).groupBy("kind")
             .agg(F.count("*").alias("n"), F.percentile(F.round("x", 4), F.array(F.lit(outside), F.lit(1 - outside))).alias("q")).collect())
    bands = {r["kind"]: (round(r["q"][0] - margin, 4), round(r["q"][1] + margin, 4)) for r in found if r["n"] >= least}
    return Bands(tuple((k, *bands.get(k, (None, None))) for k in sorted(classes)), bands.get(0, (0.0, float("inf"))))


def longest_run(flags) -> F.Column:
    """The length of the longest run of true in an array of booleans."""
    zero = F.struct(F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("most"))

    def step(a, x):
        now = F.when(x, a["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(flags, zero, step, lambda a: a["most"])


def judged(measures: DataFrame, bands: Bands, chunk_share: float = CHUNK_SHARE, chunk_run: int = CHUNK_RUN) -> DataFrame:
    """The features of ``measured`` and the verdict that ``bands`` give."""
    band = F.lit(True)
    for shortest, low, high in sorted(bands.whole):
        band = F.when(F.col("n_bytes") >= shortest, F.lit(True) if low is None else F.col("ratio").between(low, high)).otherwise(band)
    low, high = bands.chunk
    out = (measures.withColumn("n_chunks", F.size("chunk_ratios").cast("long"))
           .withColumn("low_chunks", F.size(F.filter("chunk_ratios", lambda x: x < low)).cast("long"))
           .withColumn("high_chunks", F.size(F.filter("chunk_ratios", lambda x: x > high)).cast("long"))
           .withColumn("bad_run", longest_run(F.transform("chunk_ratios", lambda x: ~x.between(low, high)))))
    chunks = (F.col("low_chunks") + F.col("high_chunks") <= chunk_share * F.col("n_chunks")) & (F.col("bad_run") < chunk_run)
    return (out.withColumn("in_band", F.coalesce(band, F.lit(True))).withColumn("chunks_in_band", chunks)
            .withColumn("kept", ~F.col("base_failed") & F.col("in_band") & F.col("chunks_in_band"))
            .select("doc_id", "n_bytes", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "n_chunks",
                    "low_chunks", "high_chunks", "bad_run", "base_failed", "in_band", "chunks_in_band", "kept"))


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text",
                  bands: Bands | None = None, chunk_share: float = CHUNK_SHARE, chunk_run: int = CHUNK_RUN) -> DataFrame:
    """The features and verdict of every row, by ``bands`` or those learned from ``labels``.

    A null text has no words, so it fails the base rule, as an empty or
    white one does. Repeated rows are judged each; null ids are judged but
    have no label; an empty table gives an empty result. Whole texts are
    compressed, however long; one of more than a megabyte is counted in
    pieces. A ratio at the edge of a band lies in it. Columns of ``docs`` other
    than the two named ones play no part, whatever their names.
    """
    measures = measured(docs, doc_id, text)
    if bands is None:
        measures = stored(measures, "ratios")
        bands = learn_bands(measures, labels)
    return judged(measures, bands, chunk_share, chunk_run)
