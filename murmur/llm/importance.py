"""Quality by importance resampling.

Two hashed n-gram models generate text: one estimated from labelled good
documents (the target), one from all documents (raw). Features are words and
runs of punctuation, case kept, and pairs of neighbours, each order hashed into
buckets of its own; every occurrence counts. A bucket's log ratio is

    log((target + s) / (raw * N_target / N_raw + s))

with s added to both expected counts, and the document's own occurrences taken
out of both, so labelled documents are weighed like all others. A document's
log weight is the log of the ratio at which the two models generate it: the
sum of its features' log ratios (those of pairs times ``PAIR_WEIGHT``: they
repeat what their words say, and most are rare).

A long document hides a few foreign words in that sum, so each document also
has the least log ratio of ``PASSAGE`` neighbouring words; documents whose
least likely passage falls below the ``loss`` quantile of the labelled good
ones are rejected whatever the draw says (``passage_ok``).

Documents are sampled without replacement by Gumbel top-k: the k documents
with the greatest log weight + Gumbel noise stay, at temperature 1 a draw in
proportion to the weights. k is ``share`` of the rows; without a share it is
the number of rows whose log weight reaches the ``loss`` quantile of the
labelled good ones. The noise comes from a hash of the id, so a rerun of a
lost task draws it again. The k-th greatest value is found by counting rows
below candidate values, not by sorting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import SLICE_BYTES, byte_slices, fresh, per_slice, stored
from murmur.llm.flat import byte_texts, counts_to_offsets, hash_spans, long_cuts, spans, symbol_values, text_of, windows
from murmur.llm.histogram_sort import splitters

#: log2 of the buckets of words and of pairs, added count, weight of a pair, words in a passage.
WORD_BITS, PAIR_BITS, SMOOTHING, PAIR_WEIGHT, PASSAGE = 20, 18, 1.0, 0.1, 40
#: Temperature of the sampling, and the share of labelled good documents given up where k is not set.
TEMPERATURE, LOSS = 1.0, 0.005
SIZE = (1 << WORD_BITS) + (1 << PAIR_BITS)
#: Labelled rows to learn from, in expectation: more are thinned by a hash of their id. This bounds the broadcast.
LABELLED = 200_000
_BLANK, _MARK, _WORD = 0, 1, 2
#: A cut through a long text may follow any white space.
CUT = re.compile(rb"[\x20\x09-\x0D]")


def byte_classes() -> np.ndarray:
    out = np.full(256, _MARK, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = _BLANK
    for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        out[a:b] = _WORD
    return out


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all tokens with their text's number, and of all neighbour pairs with theirs."""
    raw, offsets = byte_texts(column)
    kind = byte_classes()[raw]
    found = [spans(kind == k, offsets) for k in (_WORD, _MARK)]
    starts, ends = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    h = hash_spans(symbol_values(11)[raw], starts, ends)
    owner = text_of(starts, offsets)
    pairs, pair_owner = windows(h, counts_to_offsets(owner, len(offsets) - 1), 2)
    return ((h >> np.uint64(64 - WORD_BITS)).astype(np.int64), owner,
            (pairs >> np.uint64(64 - PAIR_BITS)).astype(np.int64) + (1 << WORD_BITS), pair_owner)


def token_pieces(raw: bytes, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(word buckets, pair buckets, whether the first word is the last one of the piece before) of one long text, piece by piece."""
    held = b""
    for piece in long_cuts(raw, step, CUT):
        word, _, pair, _ = features(pa.array([held + piece], pa.binary()))
        yield word, pair, bool(held)
        tail = piece.rstrip(b"\x20\x09\x0A\x0B\x0C\x0D")
        if tail:
            kind = byte_classes()[np.frombuffer(tail, np.uint8)]
            change = np.flatnonzero(kind[1:] != kind[:-1])
            held = tail[change[-1] + 1 if len(change) else 0:] + b" "


def text_counts(raw: bytes, step: int) -> np.ndarray:
    """Occurrences per bucket in one long text."""
    out = np.zeros(SIZE, np.int64)
    for word, pair, carried in token_pieces(raw, step):
        out += np.bincount(np.r_[word[1 if carried else 0:], pair], minlength=SIZE)
    return out


def least_passage(ratio: np.ndarray, raw: bytes, step: int, passage: int) -> int:
    """The least sum of ``ratio`` (per bucket) over ``passage`` neighbouring words of one long text, and their pairs."""
    least, x, last = 1 << 62, np.empty(0, np.int64), np.empty(0, np.int64)

    def scan(x):
        total = np.r_[0, np.cumsum(x)]
        return int((total[passage:] - total[:-passage]).min()) if len(x) >= passage else 1 << 62

    for word, pair, _ in token_pieces(raw, step):
        if len(word):
            # A word's pair with the next one counts with it; the last word waits for its own.
            x, last = np.r_[x, ratio[word[:-1]] + ratio[pair]], ratio[word[-1:]]
            least = min(least, scan(x))
            x = x[max(0, len(x) - passage + 1):] if least < 1 << 62 else x
    x = np.r_[x, last]
    return min(least, scan(x)) if least < 1 << 62 or len(x) >= passage else int(x.sum())


def slice_counts(column: pa.Array, step: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, occurrences) of a column's features, each bucket of a row once."""
    if len(column) == 1:
        raw = (column[0].as_py() or "").encode()
        if len(raw) > step:
            total = text_counts(raw, step)
            at = np.flatnonzero(total)
            return np.zeros(len(at), np.int64), at, total[at]
    word, owner, pair, pair_owner = features(column)
    key, n = np.unique(np.r_[owner, pair_owner] << np.int64(32) | np.r_[word, pair], return_counts=True)
    return key >> np.int64(32), key & np.int64((1 << 32) - 1), n


def learn(docs: DataFrame, text: str, good: str) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences per bucket: in all texts, and in those where ``good`` is true."""

    def count(batches):
        raw, target = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
        for batch in batches:
            for a, b in byte_slices(batch.column("text")):
                part = batch.slice(a, b - a)
                row, bucket, n = slice_counts(part.column("text"))
                flag = part.column("good").to_numpy(zero_copy_only=False).astype(bool)[row]
                np.add.at(raw, bucket, n)
                np.add.at(target, bucket[flag], n[flag])
        at = np.flatnonzero(raw)
        for i in range(0, len(at), 1 << 16):
            part = at[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(raw[part]), pa.array(target[part])],
                                             names=["bucket", "raw", "target"])

    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(good), F.lit(False)).alias("good"))
    sums = (rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket")
            .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    raw, target = np.zeros(SIZE), np.zeros(SIZE)
    held = sums.toArrow()  # a row per bucket at most
    at = held.column("bucket").to_numpy()
    raw[at], target[at] = held.column("raw").to_numpy(), held.column("target").to_numpy()
    return raw, target


def log_weights(docs: DataFrame, raw: np.ndarray, target: np.ndarray, doc_id: str, text: str, good: str, smoothing: float = SMOOTHING,
                pair_weight: float = PAIR_WEIGHT, passage: int = PASSAGE, step: int = SLICE_BYTES) -> DataFrame:
    """doc_id, good, the log weight and the least passage's log ratio of every row; a text without tokens has 0 for both."""
    cut = 1 << WORD_BITS
    share = [target[x].sum() / max(1.0, raw[x].sum()) for x in (slice(0, cut), slice(cut, None))]
    shared = docs.sparkSession.sparkContext.broadcast((raw, target))
    schema = pa.schema([("doc_id", pa.int64()), ("good", pa.bool_()), ("text_hash", pa.int64()), ("weight", pa.float64()),
                        ("passage", pa.float64())])

    def ratios(bucket, n, own):
        """Log ratios without the document's ``n`` own occurrences, as whole numbers: sums do not depend on their order."""
        raw, target = shared.value
        is_pair = bucket >= cut
        expected = np.maximum(raw[bucket] - n, 0) * np.where(is_pair, share[1], share[0])
        ratio = np.log((np.maximum(target[bucket] - n * own, 0) + smoothing) / (expected + smoothing))
        return np.rint(ratio * np.where(is_pair, pair_weight, 1.0) * (1 << 20)).astype(np.int64)

    def weigh(batch):
        texts, rows = batch.column("text"), batch.num_rows
        own = np.array([bool(x) for x in batch.column("good").to_pylist()], np.float64)
        total, least = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        text = (texts[0].as_py() or "").encode() if rows == 1 else b""
        if len(text) > step:
            n = text_counts(text, step)
            ratio = ratios(np.arange(SIZE), n, own[0])
            total[0], least[0] = (ratio * n).sum(), least_passage(ratio, text, step, passage)
        else:
            word, owner, pair, pair_owner = features(texts)
            key, at, n = np.unique(np.r_[owner, pair_owner] << np.int64(32) | np.r_[word, pair], return_inverse=True, return_counts=True)
            row = key >> np.int64(32)
            ratio = ratios(key & np.int64((1 << 32) - 1), n, own[row])
            np.add.at(total, row, ratio * n)
            if len(word):
                x, first, i = ratio[at[:len(word)]], counts_to_offsets(owner, rows), np.arange(len(word))
                x[i + 1 < first[owner + 1]] += ratio[at[len(word):]]
                summed = np.r_[0, np.cumsum(x)]
                end = np.minimum(i + passage, first[owner + 1])
                sums = summed[end] - summed[i]
                sums[(end - i < passage) & (i != first[owner])] = 1 << 62
                full = np.flatnonzero(np.diff(first))
                least[full] = np.minimum.reduceat(sums, first[:-1][full])
        return {"doc_id": batch.column("doc_id"), "good": batch.column("good"), "text_hash": batch.column("text_hash"),
                "weight": total / (1 << 20), "passage": least / (1 << 20)}

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(good).alias("good"),
                       F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(per_slice(weigh, schema, limit=step), "doc_id long, good boolean, text_hash long, weight double, passage double")


def flagged(docs: DataFrame, labels: DataFrame, doc_id: str, limit: int = LABELLED) -> DataFrame:
    """``docs`` with ``good``: true for good, false for other labelled rows, null for the rest.

    An id is good if its labels say quality 1 and never toxic 1. At most
    about ``limit`` labelled ids take part, thinned by a hash of the id, so
    the table that is broadcast has a bound and no text is shuffled.
    """
    total = labels.count()
    kept = labels.filter(F.col("doc_id").isNotNull())
    if total > limit:
        kept = kept.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * limit / total))
    one = kept.groupBy(F.col("doc_id").alias("_label_id")).agg(
        F.coalesce((F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0), F.lit(False)).alias("_good"))
    return docs.join(F.broadcast(one), docs[doc_id] == F.col("_label_id"), "left").drop("_label_id")


def importance_sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      smoothing: float = SMOOTHING, pair_weight: float = PAIR_WEIGHT, passage: int = PASSAGE,
                      temperature: float = TEMPERATURE, share: float | None = None, loss: float = LOSS, seed: int = 0) -> DataFrame:
    """doc_id, text_hash, log_weight, passage_log_weight, sampled_key, sampled, passage_ok and kept of every row of ``docs``.

    ``sampled`` rows are the Gumbel top-k; a row is kept if it is sampled and
    its least likely passage passes. With ``share``, floor(share * rows) rows
    are drawn. Without any good label there is no target: every passage
    passes, and without a share all rows are drawn. A null or empty text has no token and log weight 0, that of a
    text neither model prefers. Repeated rows draw the same noise and stay or
    go together, so their number may exceed k; ties of the key do likewise.
    Null ids draw theirs from the text alone. Long texts are counted in
    pieces. An empty table gives an empty result. Columns of ``docs`` other
    than the two named ones play no part, whatever their names.
    """
    rows = flagged(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels, "doc_id")
    raw, target = learn(rows, "text", "_good")
    unit = 1 << 20
    # 53 random bits, never 0 or 1, from the id and the text.
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), 11).cast("double") + 0.5) / float(1 << 53)
    scored = (log_weights(rows, raw, target, "doc_id", "text", "_good", smoothing, pair_weight, passage)
              .withColumn("noisy", F.col("weight") / temperature - F.log(-F.log(u)))
              .withColumn("weight_key", F.round(F.col("weight") * unit).cast("long"))
              .withColumn("passage_key", F.round(F.col("passage") * unit).cast("long"))
              .withColumn("sampled_key", F.round(F.col("noisy") * unit).cast("long")).withColumn("one", F.lit(1)))
    table = stored(scored, "weights")
    total, good = table.agg(F.count("*"), F.sum(F.when(F.col("good"), 1).otherwise(0))).first()
    everything = -(1 << 62)
    cut = passage_bar = everything
    k = int(total * share) if share is not None else total
    if good:
        # The least value that `loss` of the good rows stay below.
        passage_bar, _ = splitters(table.filter("good"), "passage_key", "one", [int(loss * good)], [0])[0]
        if share is None:
            bar, _ = splitters(table.filter("good"), "weight_key", "one", [int(loss * good)], [0])[0]
            k = table.filter(F.col("weight_key") >= bar).count()
    if k < total:
        cut, _ = splitters(table, "sampled_key", "one", [total - k], [0])[0]
    sampled, ok = F.col("sampled_key") >= cut, F.col("passage_key") >= passage_bar
    return table.select("doc_id", "text_hash", F.col("weight").alias("log_weight"), F.col("passage").alias("passage_log_weight"), "sampled_key",
                        sampled.alias("sampled"), ok.alias("passage_ok"), (sampled & ok).alias("kept"))


def keep_sampled(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``importance_sample`` keeps, with all their columns."""
    sid, sth = fresh(docs, "sampled_id", "sampled_hash")
    kept = (importance_sample(docs, labels, doc_id, text, **options).filter("kept")
            .select(F.col("doc_id").alias(sid), F.col("text_hash").alias(sth)).distinct())
    return docs.join(kept, F.col(doc_id).cast("long").eqNullSafe(F.col(sid)) & (F.xxhash64(F.col(text)) == F.col(sth)), "left_semi")
