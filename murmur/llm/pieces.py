"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text becomes symbols (one per character, blanks as U+2581, one put before
the text). No piece of a supported model has U+2581 after another character,
so the text falls into units, a run of U+2581 and what follows it, that never
merge across. Equal units have equal ids: each distinct unit of a slice is
merged once, and remembered by the worker.

Merging works on all new units at once, as one flat symbol array. Each round
takes every unit's lowest pair rank (a segmented minimum), merges that rank's
leftmost non-overlapping pairs of the unit, compacts the arrays, and looks up
the ranks of the pairs that changed, until no unit has a pair left. The
library merges one pair at a time; taking all pairs of a rank in one round is
the same unless a merged piece can start a pair of a rank as good or better.
Those pieces are known from the merge table, and merge one at a time.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.llm.byte_bpe import Generations
from murmur.llm.common import per_slice, texts_of, without, worker_state
from murmur.llm.flat import hash_spans, mix64, spaced_cuts, text_of

BLANK = 0x2581
NONE = np.int64(1) << 40
#: Longest unit that is remembered, in characters.
CACHE_CHARS = 64
#: A text of more characters is worked on in pieces of about this many.
PIECE = 4 << 20


def library(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


class MergeTable:
    """The model's pieces as arrays; built on the driver, as large as the vocabulary."""

    def __init__(self, model: bytes):
        os.environ.setdefault("PROTOCOL_BUFFERS_PYTHON_IMPLEMENTATION", "python")
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, train, kinds = proto.normalizer_spec, proto.trainer_spec, {p.type for p in proto.pieces}
        if (train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix
                or not norm.escape_whitespaces or train.treat_whitespace_as_suffix or not train.byte_fallback or kinds - {1, 2, 3, 6}):
            raise ValueError("needs a BPE model with byte fallback, an identity normaliser and a leading blank")
        pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(chr(BLANK) in p.lstrip(chr(BLANK)) for p in pieces):
            raise ValueError("a piece has a blank after another character")
        self.size = len(proto.pieces)
        byte_ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_ids = np.array([byte_ids[f"<0x{b:02X}>"] for b in range(256)], np.int64)
        # Characters that occur in pieces but are none themselves still need symbols of their own.
        symbols = {p: i for p, (i, _) in pieces.items()}
        for c in sorted({c for p in pieces for c in p} - set(symbols)):
            symbols[c] = self.size + len(symbols)
        self.width = np.int64(max([self.size, *symbols.values()]) + 2)
        single = sorted((ord(p), i) for p, i in symbols.items() if len(p) == 1)
        self.chars = np.array([c for c, _ in single], np.int64)
        self.char_symbols = np.array([i for _, i in single], np.int64)
        _, rank = np.unique([-s for _, s in pieces.values()], return_inverse=True)
        rank_of = dict(zip(pieces, rank.tolist()))
        found = sorted((symbols[p[:k]] * int(self.width) + symbols[p[k:]], i, rank_of[p])
                       for p, (i, _) in pieces.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.keys, self.pieces, self.ranks = (np.array(x, np.int64) for x in zip(*found))
        own = np.full(int(self.width), -1, np.int64)
        own[self.pieces] = self.ranks
        left, right = np.divmod(self.keys, self.width)
        self.alone = np.zeros(int(self.width), bool)
        for side in (left, right):
            self.alone[side[(own[side] >= 0) & (self.ranks <= own[side])]] = True

    @classmethod
    def of(cls, arrays: dict) -> MergeTable:
        table = cls.__new__(cls)
        vars(table).update(arrays)
        return table

    def symbols_of(self, cps: np.ndarray) -> np.ndarray:
        """Symbols of code points; ``width - 1`` for one that no piece has."""
        at = np.minimum(np.searchsorted(self.chars, cps), len(self.chars) - 1)
        return np.where(self.chars[at] == cps, self.char_symbols[at], self.width - 1)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of symbol pairs; rank NONE where they do not merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.pieces[at]


def merge_units(table: MergeTable, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge all units to the end: symbols, each one's unit, and the place of its first character."""
    n = len(symbols)
    unit = text_of(np.arange(n), offsets)
    place = np.arange(n)
    sym = symbols.copy()
    rank, piece = np.full(n, NONE), np.zeros(n, np.int64)
    inner = np.flatnonzero(unit[1:] == unit[:-1])
    rank[inner], piece[inner] = table.pairs(sym[inner], sym[inner + 1])
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(sym):
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        length = np.diff(np.r_[first, len(sym)])
        least = np.minimum.reduceat(rank, first)
        open_ = np.repeat(least < NONE, length)
        if not open_.all():
            done.append((sym[~open_], unit[~open_], place[~open_]))
            least, length = least[least < NONE], length[least < NONE]
            sym, unit, place, rank, piece = sym[open_], unit[open_], place[open_], rank[open_], piece[open_]
            if not len(sym):
                break
        at = np.flatnonzero(rank == np.repeat(least, length))
        j = np.arange(len(at))
        run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], j, 0))
        leads = np.r_[True, unit[at[1:]] != unit[at[:-1]]]
        # A unit whose pairs of this rank hold a piece that must merge alone takes its leftmost pair only.
        single = np.bitwise_or.reduceat(table.alone[piece[at]], np.flatnonzero(leads))[np.cumsum(leads) - 1]
        at = at[np.where(single, leads, (j - run) % 2 == 0)]
        sym[at] = piece[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        new = moved[at]
        sym, unit, place, rank, piece = sym[keep], unit[keep], place[keep], rank[keep], piece[keep]
        changed = np.unique(np.r_[new, new[new > 0] - 1])
        last = len(sym) - 1
        nxt = np.minimum(changed + 1, last)
        ends = (changed == last) | (unit[changed] != unit[nxt])
        r, p = table.pairs(sym[changed], sym[nxt])
        rank[changed], piece[changed] = np.where(ends, NONE, r), p
    if not done:
        return sym, unit, place
    sym, unit, place = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(unit, kind="stable")
    return sym[order], unit[order], place[order]


def spell(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points end to end, and how many each has."""
    n = 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)
    which = np.repeat(np.arange(len(cps)), n)
    j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    c, m = cps[which].astype(np.int64), n[which]
    low = (c >> (6 * (m - 1 - j))) & 0x3F | 0x80
    head = np.array([0, 0, 0xC0, 0xE0, 0xF0])[m] | c >> (6 * (m - 1))
    return np.where(m == 1, c, np.where(j == 0, head, low)), n


class PieceEncoder:
    def __init__(self, table: MergeTable, model: bytes):
        self.table, self.known, self.library = table, Generations(), library(model)

    def ids_of_units(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids of the given units (as bytes of int32)."""
        length = ends - starts
        offsets = np.r_[0, np.cumsum(length)]
        pick = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], length)
        chars = cps[pick].astype(np.int64)
        sym, unit, place = merge_units(self.table, self.table.symbols_of(chars), offsets)
        bare = sym >= self.table.size
        raw, n = spell(chars[place[bare]])
        each = np.ones(len(sym), np.int64)
        each[bare] = n
        ids = np.repeat(sym, each)
        ids[np.repeat(bare, each)] = self.table.byte_ids[raw]
        cut = np.r_[0, np.cumsum(np.bincount(unit, weights=each, minlength=len(starts)))].astype(np.int64) * 4
        raw = ids.astype(np.int32).tobytes()
        return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and n + 1 offsets."""
        marked = [chr(BLANK) + x.replace(" ", chr(BLANK)) if x else "" for x in texts]
        if len(marked) == 1 and len(marked[0]) > PIECE:
            # Units begin where a blank follows another character: cuts there change nothing.
            cps = np.frombuffer(marked[0].encode("utf-32-le"), np.uint32)
            cuts = spaced_cuts(np.flatnonzero((cps[1:] == BLANK) & (cps[:-1] != BLANK)) + 1, len(cps), PIECE)
            ids = np.concatenate([self.encode_marked([marked[0][a:b]])[0] for a, b in zip(cuts, cuts[1:])])
            return ids, np.array([0, len(ids)])
        return self.encode_marked(marked)

    def encode_marked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts whose blanks are marked and that begin a unit."""
        sizes = np.array([len(x) for x in texts], np.int64)
        cps = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if not len(cps):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        offsets = np.r_[0, np.cumsum(sizes)]
        blank = cps == BLANK
        begin = np.zeros(len(cps), bool)
        begin[1:] = blank[1:] & ~blank[:-1]
        begin[offsets[:-1][sizes > 0]] = True
        starts = np.flatnonzero(begin)
        ends = np.r_[starts[1:], len(cps)]
        hashes = hash_spans(mix64(cps.astype(np.uint64)), starts, ends)
        uniq, index, where = np.unique(hashes, return_index=True, return_inverse=True)
        keys = uniq.tolist()
        pieces = self.known.get(keys)
        missing = np.array([i for i, x in enumerate(pieces) if x is None], np.int64)
        if len(missing):
            a, b = starts[index[missing]], ends[index[missing]]
            for i, size, ids in zip(missing.tolist(), (b - a).tolist(), self.ids_of_units(cps, a, b)):
                pieces[i] = ids
                if size <= CACHE_CHARS:
                    self.known.put(keys[i], ids)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        pool = np.frombuffer(b"".join(pieces), np.int32)
        first = np.cumsum(lengths) - lengths
        each = lengths[where]
        ids = pool[np.arange(int(each.sum())) + np.repeat(first[where] - (np.cumsum(each) - each), each)]
        counts = np.bincount(text_of(starts, offsets), weights=each, minlength=len(texts)).astype(np.int64)
        return ids, np.r_[0, np.cumsum(counts)]


def encode_decode(docs: DataFrame, model_path: str, end_id: int | None = 2, text: str = "text",
                  ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Every row with its text's ``ids`` (array<int>, ``end_id`` last) and the text they decode to.

    Other columns are kept. A null text counts as empty: its only id is
    ``end_id``. An empty table gives an empty result; repeated rows and null
    ids stay; pairs of equal rank merge from the left; long texts go in pieces.
    Columns of ``docs`` that are named as an output are replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, ids.lower(), decoded.lower())
    with open(model_path, "rb") as f:
        model = f.read()
    shared = spark.sparkContext.broadcast((vars(MergeTable(model)), model))
    ddl = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batch):
        arrays, model = shared.value
        enc = worker_state(f"pieces-{hash(model)}", lambda: PieceEncoder(MergeTable.of(arrays), model))
        flat, offsets = enc.encode(texts_of(batch.column(text)))
        if end_id is not None:
            flat = np.insert(flat, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
        cut = offsets.tolist()
        back = enc.library.decode([flat[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])], num_threads=1)
        return {c: batch.column(c) for c in batch.schema.names} | {ids: lists, decoded: pa.array(back, pa.string())}

    def batches(stream):
        for batch in stream:
            schema = pa.schema([*batch.schema, (ids, pa.list_(pa.int32())), (decoded, pa.string())])
            yield from per_slice(run, schema, text=text, limit=2 << 20)(iter([batch]))

    return docs.mapInArrow(batches, ddl)


def piece_digest(docs: DataFrame, model_path: str, end_id: int = 2) -> DataFrame:
    """doc_id, n_tokens and the sha256 of the ids and of the decoded text.

    Null, empty and long texts, null and repeated ids and empty tables as in ``encode_decode``.
    """
    out = encode_decode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model_path, end_id)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
