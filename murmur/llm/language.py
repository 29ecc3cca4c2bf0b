"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A
letter's place in an n-gram is a rotation of its vector; the n-gram's vector
is the elementwise product of its rotated letters. A text is the sum of its
n-gram vectors, a language the sum of its texts, each with the same weight.
A text gets the language whose sum has the greatest cosine with its own.

Sums are kept in whole numbers, so the profiles do not depend on the order
in which tasks add up. A text's weight is so large that an n-gram seen once
counts in any text of under 2^31 letters; 2^33 texts a language fit.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.llm.common import byte_slices, per_slice, stored, texts_of, without, worker_state
from murmur.llm.flat import code_points, long_cuts, mix64

#: Components of a vector, letters of an n-gram, and the weight of one text.
SIZE, ORDER, WEIGHT = 1024, 3, 1 << 30
#: Languages that the driver may hold profiles of (SIZE numbers each).
MAX_LANGUAGES = 5000
GAP = 0x20
#: Bytes and rows that one matrix of counts spans.
SLICE = (1 << 18, 512)
#: Code points of one piece of a long text, and n-grams whose vectors are held at once.
PIECE, VECTORS = 1 << 20, 8192
#: A long text may be cut after any ASCII white space, which is no letter.
CUT = re.compile(r"[\x20\x09-\x0D]")


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c <= 0xDFFF else False for c in range(0x110000)), bool, 0x110000)


def letter_vectors(letters: np.ndarray, size: int = SIZE) -> np.ndarray:
    """A row of +1 and -1 for each code point."""
    words = mix64(letters.astype(np.uint64)[:, None] * np.uint64(0x10001) + np.arange(size // 64, dtype=np.uint64))
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    return (bits.astype(np.int8) << 1) - 1


def gram_vectors(grams: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Vectors of packed n-grams (21 bits a letter): the product of rotated letter vectors."""
    out = np.ones((len(grams), size), np.int8)
    for j in range(ORDER):
        letters, at = np.unique((grams >> np.int64(21 * j)) & np.int64((1 << 21) - 1), return_inverse=True)
        out *= np.roll(letter_vectors(letters, size), j, axis=1)[at]
    return out


def gram_counts(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the slice, and a (text, n-gram) matrix of counts.

    A text is its lower-cased letters, each run of others one gap, with a
    gap at both ends. N-grams are numbered by the slice's own letters, so
    counting needs no sort unless there are very many different letters.
    """
    cps, offsets = code_points([f" {x.lower()} " for x in texts])
    inside = letters[cps]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    keep[offsets[:-1]] = True
    stream = np.where(inside, cps, GAP)[keep]
    owner = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, np.cumsum(keep)][offsets]))
    own = np.flatnonzero(np.bincount(stream))
    number = np.zeros(int(own[-1]) + 1 if len(own) else 1, np.int64)
    number[own] = np.arange(len(own))
    code, n = number[stream], max(0, len(stream) - ORDER + 1)
    gram = np.zeros(n, np.int64)
    for j in range(ORDER):
        gram = gram * len(own) + code[j:n + j]
    whole = owner[:n] == owner[ORDER - 1:] if n else np.zeros(0, bool)
    gram, owner = gram[whole], owner[:n][whole]
    if len(own) ** ORDER <= 1 << 22:
        distinct = np.flatnonzero(np.bincount(gram))
        place = np.zeros(len(own) ** ORDER, np.int64)
        place[distinct] = np.arange(len(distinct))
        at = place[gram]
    else:
        distinct, at = np.unique(gram, return_inverse=True)
    counts = np.bincount(owner * len(distinct) + at, minlength=len(texts) * len(distinct))
    packed = np.zeros(len(distinct), np.int64)
    for j in range(ORDER):
        packed |= own[distinct // len(own) ** (ORDER - 1 - j) % len(own)] << np.int64(21 * j)
    return packed, counts.reshape(len(texts), len(distinct))


def slice_gram_counts(texts: list[str], letters: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """``gram_counts``, of one long text in pieces: cuts are gaps, and only n-grams around a gap join two pieces."""
    if len(texts) != 1 or len(texts[0]) <= piece:
        return gram_counts(texts, letters)
    grams, counts, last = np.empty(0, np.int64), np.empty(0, np.int64), None
    for part in long_cuts(texts[0], piece, CUT):
        found, n = gram_counts([part], letters)
        own = np.array([ord(c) for c in part.lower()], np.int64) if len(part) < 64 else code_points([part.lower()])[0].astype(np.int64)
        own = own[letters[own]]
        if last is not None and len(own):
            found, n = np.r_[found, last | GAP << 21 | own[0] << np.int64(42)], np.c_[n, [[1]]]
        last = own[-1] if len(own) else last
        grams, at = np.unique(np.r_[grams, found], return_inverse=True)
        counts = np.bincount(at, weights=np.r_[counts, n[0]], minlength=len(grams)).astype(np.int64)
    return grams, counts[None, :]


def bundled(grams: np.ndarray, counts: np.ndarray, kind) -> np.ndarray:
    """Per text the sum of its n-grams' vectors; whole numbers, so exact in any order while they fit ``kind``."""
    out = np.zeros((len(counts), SIZE), kind)
    for a in range(0, len(grams), VECTORS):
        out += counts[:, a:a + VECTORS].astype(kind) @ gram_vectors(grams[a:a + VECTORS]).astype(kind)
    return out


def profiles(docs: DataFrame, text: str, lang: str) -> dict[str, np.ndarray]:
    """The profile of each non-null value of ``lang``."""
    schema = pa.schema([("lang", pa.string()), ("profile", pa.list_(pa.int64()))])

    def bundle(batches):
        letters = worker_state("letters", letter_table)
        total: dict[str, np.ndarray] = {}

        def add(batch):
            texts, langs = texts_of(batch.column("text")), batch.column("lang").to_pylist()
            distinct, counts = slice_gram_counts(texts, letters)
            share = np.rint(counts * (WEIGHT / np.maximum(1, counts.sum(axis=1, keepdims=True))))
            names, of = np.unique(np.array(langs, object).astype(str), return_inverse=True)
            held = np.stack([share[of == i].sum(axis=0) for i in range(len(names))])
            sums = bundled(distinct, held, np.float64)
            for name, row in zip(names.tolist(), sums):
                total[name] = total.get(name, 0) + row.astype(np.int64)

        for batch in batches:
            for a, b in byte_slices(batch.column("text"), *SLICE):
                add(batch.slice(a, b - a))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], schema=schema)

    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sums = (rows.mapInArrow(bundle, "lang string, profile array<long>").select("lang", F.posexplode("profile").alias("i", "x"))
            .groupBy("lang", "i").agg(F.sum("x").alias("x")))
    sums = stored(sums, "profiles")
    names = sums.filter("i = 0").limit(MAX_LANGUAGES + 1).count()
    if names > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out: dict[str, np.ndarray] = {}
    for row in sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect():
        out[row["lang"]] = np.array([x["x"] for x in row["v"]], np.float64)
    return out


def predict(docs: DataFrame, learned: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Every row with lang_pred and score, the cosine with the nearest profile (at least 0).

    Columns of ``docs`` with these names are replaced.
    """
    docs = without(docs, "lang_pred", "score")
    names = sorted(learned)
    shared = docs.sparkSession.sparkContext.broadcast(
        np.array([learned[x] / (np.linalg.norm(learned[x]) or 1.0) for x in names]).reshape(len(names), SIZE))

    def score(batch):
        texts = texts_of(batch.column(text))
        letters = worker_state("letters", letter_table)
        distinct, counts = slice_gram_counts(texts, letters)
        own = bundled(distinct, counts, np.float32 if sum(map(len, texts)) < 1 << 22 else np.float64)
        norm = np.linalg.norm(own.astype(np.float64), axis=1)
        # A letter gives at least one n-gram: with the gap on either side of it.
        has = counts.sum(axis=1) > 0
        known = has & (norm > 0) & bool(names)
        lang, best = ["und"] * len(texts), np.zeros(len(texts))
        if known.any():
            cosine = (own[known].astype(np.float64) @ shared.value.T) / norm[known, None]
            at = cosine.argmax(axis=1)
            best[known] = np.clip(cosine[np.arange(len(at)), at], 0, 1)
            for i, j in zip(np.flatnonzero(known).tolist(), at.tolist()):
                lang[i] = names[j]
        return {c: batch.column(c) for c in batch.schema.names} | {"lang_pred": lang, "score": best}

    def batches(stream):
        for batch in stream:
            schema = pa.schema([*batch.schema, ("lang_pred", pa.string()), ("score", pa.float64())])
            yield from per_slice(score, schema, text, *SLICE)(iter([batch]))

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(batches, T.StructType([*docs.schema.fields, *added]))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    Profiles are learned from rows whose crc32(doc_id as text) mod 4 is not 2
    and whose language is given; all of them, not a sample. A text that is
    null or has no letter is ``und`` with score 0, as is every text when
    nothing could be learned. A null id is neither learned from nor held out.
    Ties go to the language that sorts first. Repeated rows are learned from
    and predicted each; long texts are counted in pieces; an empty table gives
    an empty result. Other columns play no part, whatever their names.
    """
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4
    learned = profiles(docs.filter(fold != 2), text, lang)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"),
                       F.col(text).alias("text"))
    return predict(rows, learned).select("doc_id", "held_out", "lang_pred", "score")
