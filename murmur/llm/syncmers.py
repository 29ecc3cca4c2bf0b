"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor when the least hash among its s-mers is
that of its first or its last one. Whether it is depends on the k-mer alone,
so the same passage gives the same anchors in every text, wherever it stands.
An anchor is its 48-bit hash and its place (of its first occurrence in the
text). A fingerprint holds the ``SIZE`` anchors of least hash, which every
text picks by the same rule; a text without an anchor has one, of the whole
text. Memory is bounded by pieces that overlap by k - 1 code points.

Two fingerprints are compared over the range of hashes that both cover. A
common anchor counts when it lies on the longest chain of common anchors that
stand in the same order in both texts (positional matching, which inserted or
removed passages do not disturb but chance matches do); the likeness is twice
the chain over the anchors of both.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import byte_slices, per_slice, texts_of, utf8_size
from murmur.llm.flat import code_points, mix64

#: Code points of an anchor and of the inner substrings, anchors in a fingerprint.
K, S, SIZE = 12, 5, 64
#: Code points of one numpy pass; longer texts take several.
PASS = 1 << 17
#: Bytes of text in one part of the ordered exchange, and parts at most: beyond them a part grows with the corpus.
PART_BYTES, PARTS = 16 << 20, 20_000
#: Rows drawn per part to place its border, in expectation.
DRAWN = 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def closed_syncmers(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the k-mers whose least s-mer is their first or last (ties count)."""
    n = len(points) - s + 1
    if n < k - s + 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = points[:n].astype(np.uint64)
    for j in range(1, s):
        h *= _MULTIPLIER
        h += points[j:n + j]
    h = mix64(h)
    w, least, width = k - s + 1, h, 1
    while width < w:
        step = min(width, w - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = np.flatnonzero((h[:len(least)] == least) | (h[w - 1:] == least))
    # s-mers that cover the k-mer, composed in their order.
    out = h[at]
    for j in [*range(s, k - s, s), k - s]:
        out = mix64(out * _MULTIPLIER + h[at + j])
    return at, out


def pass_anchors(texts: list[str], k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and hash of the anchors of several texts at once."""
    points, offsets = code_points(texts)
    at, h = closed_syncmers(points, k, s)
    owner = np.searchsorted(offsets, at, side="right") - 1
    whole = at + k <= offsets[owner + 1]
    at, h, owner = at[whole], h[whole], owner[whole]
    return owner, at - offsets[owner], h


def least_anchors(owner: np.ndarray, place: np.ndarray, h: np.ndarray, n: int, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the ``size`` least hashes (48 bits) in order, each with its first place."""
    h = h >> np.uint64(16)
    order = np.lexsort((place, h, owner))
    owner, place, h = owner[order], place[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    owner, place, h = owner[new], place[new], h[new]
    first = np.searchsorted(owner, np.arange(n + 1))
    return [(h[a:min(b, a + size)], place[a:min(b, a + size)]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def text_anchors(texts: list[str], size: int = SIZE, k: int = K, s: int = S, step: int = PASS) -> list[tuple[np.ndarray, np.ndarray]]:
    """The fingerprint's anchors of every text; texts of any length."""
    out: list = [None] * len(texts)
    unit, held = [], 0

    def close():
        nonlocal unit, held
        for i, found in zip(unit, least_anchors(*pass_anchors([texts[i] for i in unit], k, s), len(unit), size)):
            out[i] = found
        unit, held = [], 0

    for i, t in enumerate(texts):
        if len(t) <= step:
            unit.append(i)
            held += len(t)
            if held >= step:
                close()
            continue
        best = np.empty(0, np.uint64), np.empty(0, np.int64)
        for a in range(0, len(t), step):
            _, place, h = pass_anchors([t[a:a + step + k - 1]], k, s)
            # The least anchors of the text so far and of this piece; hashes come back from 48 bits unchanged.
            h, place = np.r_[best[0] << np.uint64(16), h], np.r_[best[1], place + a]
            best = least_anchors(np.zeros(len(h), np.int64), place, h, 1, size)[0]
        out[i] = best
    if unit:
        close()
    for i, (h, _) in enumerate(out):
        if texts[i] and not len(h):
            own = int.from_bytes(hashlib.blake2b(texts[i].encode(), digest_size=6).digest(), "little")
            out[i] = np.array([own], np.uint64), np.zeros(1, np.int64)
    return out


def packed(anchors: tuple[np.ndarray, np.ndarray]) -> str:
    """A fingerprint: six bytes of hash and four of place (modulo 2^32) per anchor, in base64."""
    h, place = anchors
    raw = np.empty((len(h), 10), np.uint8)
    raw[:, :6] = h.astype("<u8")[:, None].view(np.uint8)[:, :6]
    raw[:, 6:] = place.astype("<u4")[:, None].view(np.uint8)
    return base64.b64encode(raw.tobytes()).decode()


def unpacked(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 10)
    h = np.zeros((len(raw), 8), np.uint8)
    h[:, :6] = raw[:, :6]
    return h.view("<u8").ravel(), np.ascontiguousarray(raw[:, 6:]).view("<u4").ravel().astype(np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int = SIZE) -> float:
    """0 to 1: the share of anchors that both texts have in the same order; 1 for two texts without any."""
    (ha, pa_), (hb, pb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    # A full fingerprint tells nothing of hashes above its last.
    bound = min([x[-1] for x in (ha, hb) if len(x) >= size], default=None)
    if bound is not None:
        na, nb = (int(np.searchsorted(x, bound, side="right")) for x in (ha, hb))
        ha, pa_, hb, pb = ha[:na], pa_[:na], hb[:nb], pb[:nb]
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    chain: list[int] = []
    for x in pb[ib][np.argsort(pa_[ia])].tolist():
        i = bisect.bisect_left(chain, x)
        chain[i:i + 1] = [x]
    return 2 * len(chain) / (len(ha) + len(hb))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, k: int = K, s: int = S) -> DataFrame:
    """doc_id, n_chars, fingerprint and anchors (place, hash) of every row.

    A null or empty text has the empty fingerprint. Equal texts have equal
    ones; repeated rows are treated each; an empty table gives an empty
    result. Other columns play no part, whatever their names.
    """
    kind = pa.list_(pa.struct([("place", pa.int64()), ("hash", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string()), ("anchors", kind)])

    def run(batch):
        texts = texts_of(batch.column("text"))
        found = text_anchors(texts, size, k, s)
        return {"doc_id": batch.column("doc_id"), "n_chars": [len(t) for t in texts], "fingerprint": [packed(x) for x in found],
                "anchors": [[{"place": p, "hash": h} for h, p in zip(x.tolist(), y.tolist())] for x, y in found]}

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(per_slice(run, schema),
                           "doc_id long, n_chars long, fingerprint string, anchors array<struct<place: long, hash: long>>")


# -- neighbours in the order of ids -----------------------------------------

def in_order(rows: DataFrame, part_bytes: int = PART_BYTES, parts: int = PARTS) -> DataFrame:
    """(part, ahead, doc_id, th, text) of ``rows`` (doc_id, text), each part sorted and followed by the row after it.

    Parts are runs of the order (doc_id, th), th the text's hash; null ids
    come first. Their borders are rows drawn by a hash of id and text, a
    bounded number per part. The first row of each part also goes, with
    ``ahead`` true, to the part before it (that of the first part to the
    last), so that every row meets its successor in its own task. One exchange.
    """
    keyed = rows.withColumn("th", F.xxhash64("text"))
    n, size, least = keyed.agg(F.count("*"), F.sum(utf8_size(F.col("text"))), F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "th"))).first()
    wanted = max(1, min(parts, -(-(size or 0) // part_bytes)))
    rate = max(1, n // (wanted * DRAWN))

    def key(doc_id, th):
        return (doc_id is not None, doc_id or 0, th)

    drawn = keyed.filter(F.pmod(F.xxhash64(F.lit(7), "doc_id", "th"), F.lit(rate)) == 0).select("doc_id", "th").distinct().collect()
    order = sorted(key(*r) for r in drawn)
    each = max(1, len(order) // wanted)
    bounds = sorted({*order[each:len(order):each], *([key(least[1], least[2])] if least is not None else [])})
    n_parts = max(1, len(bounds))

    @F.pandas_udf("array<int>")
    def parts_of(doc_id: pd.Series, missing: pd.Series, th: pd.Series) -> pd.Series:
        """A row's part, and the part before it where the row is its border."""
        out = []
        for i, m, t in zip(doc_id.tolist(), missing.tolist(), th.tolist()):
            own = (not m, 0 if m else i, t)
            at = bisect.bisect_right(bounds, own) - 1
            out.append([at, (at - 1) % n_parts] if bounds[at] == own else [at])
        return pd.Series(out)

    where = parts_of(F.coalesce("doc_id", F.lit(0).cast("long")), F.col("doc_id").isNull(), "th")
    placed = keyed.select("*", F.posexplode(where).alias("ahead", "part")).withColumn("ahead", F.col("ahead") > 0)
    return (placed.repartitionById(n_parts, "part").sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "th")
            .select("part", "ahead", "doc_id", "th", "text"))


def groups(batches) -> Iterator[list[list]]:
    """Lists of [part, ahead, id, hash, text, rows] for neighbouring equal rows; a list's last one starts the next list."""
    held: list[list] = []
    for batch in batches:
        for a, b in byte_slices(batch.column("text")):
            for part, ahead, i, th, text in zip(*(c.to_pylist() for c in batch.slice(a, b - a).columns)):
                if held and held[-1][:4] == [part, ahead, i, th]:
                    held[-1][5] += 1
                else:
                    held.append([part, ahead, i, th, text or "", 1])
            if len(held) > 1:
                yield held
                held = held[-1:]
    if held:
        yield held


def half_edited(text: str, other: str) -> str:
    """``text`` with its last half replaced by as many code points of the start of ``other`` (or all it has)."""
    n = len(text) // 2
    return text[:len(text) - n] + other[:n]


def syncmer_digest(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The next document is the next different row in the order of (id, text
    hash), null ids first; after the last comes the first. Rows that repeat
    an id and a text are one document and get a result each. A null text
    counts as empty. One document alone is its own next. An empty table
    gives an empty result. Other columns play no part.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def describe(batches):
        for held in groups(batches):
            own, following = held[:-1], held[1:]
            pairs = [(x, y) for x, y in zip(own, following) if not x[1]]
            if not pairs:
                continue
            prints = text_anchors([x[4] for x in held], size)
            texts = [half_edited(x[4], y[4]) for x, y in zip(own, following)]
            edited = text_anchors(texts, size)
            rows = []
            for j, x in enumerate(own):
                if not x[1]:
                    row = (x[2], len(x[4]), hashlib.sha256(texts[j].encode()).hexdigest(), packed(prints[j]), packed(edited[j]),
                           likeness(prints[j], edited[j], size), likeness(prints[j], prints[j + 1], size))
                    rows += [(x[5], row)]
            for a in range(0, len(rows)):
                n, row = rows[a]
                if n > 1:  # repeated rows, a bounded batch at a time
                    for b in range(0, n, 1000):
                        k = min(1000, n - b)
                        yield pa.RecordBatch.from_arrays([pa.array([v] * k, f.type) for v, f in zip(row, schema)], schema=schema)
            single = [row for n, row in rows if n == 1]
            if single:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*single), schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return in_order(rows).mapInArrow(describe, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                               "edited_fingerprint string, near_edited double, near_next double")
