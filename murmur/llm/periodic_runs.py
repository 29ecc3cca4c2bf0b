"""Periodic runs of words by suffix-tree LCE.

A run is a maximal stretch of words with smallest period q that is at least
``least`` and 2 q words long. By the runs theorem every run holds, at some
place i, the longest Lyndon word that starts at i for the order of the words
or for its reverse, and the run's period is that Lyndon word's length. So
each place gives one candidate root per order; the root (i, p) is extended to
the right by the longest common extension of the suffixes at i and i + p, to
the left by that of the prefixes before them, and is a run where the whole is
2 p words or more.

Extensions come from two trees built by Ukkonen's algorithm, of the words and
of their reversal: an Euler tour lists the leaves and, between neighbours, the
depth of their lowest common ancestor; a sparse table over those depths
answers any pair in constant time. The tour's leaf ranks, taken once with
the words in order and once reversed, also give the Lyndon words (up to the
next smaller suffix).

Only words that can lie in a run enter a tree: at least half of a run, six
words or more, repeats inside it, so each of its words lies in a six-word
window that occurs twice in one zone. Zones are found by sorting window
hashes and narrowed until they stand still; a hash collision can only add
a zone, and the trees compare the words themselves. Many zones share a pair of
trees, divided by separators that are unique and less than any word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import byte_slices
from murmur.llm.flat import long_cuts, mix64, spans, windows

#: Shortest run in words, and words that one pair of trees takes (a longer zone has one of its own).
LEAST, TREE_WORDS = 12, 1 << 15
CUT = re.compile(rb"[\x20\x09-\x0D]")


# -- suffix trees -----------------------------------------------------------

def ukkonen(s: list[int], width: int) -> tuple[list[int], list[int], dict[int, int], list[int]]:
    """(first, last, child, leaf) of the suffix tree of ``s``, whose last symbol is unique.

    Node v's edge holds s[first[v]:last[v]]; child[v * width + symbol] is the
    node below v by that symbol; leaf[v] is the suffix that ends there, or
    -1. Symbols are 0 to width - 1, node 0 is the root.
    """
    n = len(s)
    first, last, link, leaf, child = [0], [0], [0], [-1], {}
    node = edge = length = left = suffix = 0
    for i, c in enumerate(s):
        left += 1
        waiting = 0
        while left:
            if not length:
                edge = i
            key = node * width + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(first)
                first.append(i)
                last.append(n)
                link.append(0)
                leaf.append(suffix)
                suffix += 1
                if waiting:
                    link[waiting] = node
                    waiting = 0
            else:
                start = first[below]
                span = last[below] - start if leaf[below] < 0 else i + 1 - start
                if length >= span:
                    edge += span
                    length -= span
                    node = below
                    continue
                if s[start + length] == c:
                    length += 1
                    if waiting and node:
                        link[waiting] = node
                    break
                split = len(first)
                first += (start, i)
                last += (start + length, n)
                link += (0, 0)
                leaf += (-1, suffix)
                suffix += 1
                child[key] = split
                child[split * width + s[start + length]] = below
                child[split * width + c] = split + 1
                first[below] = start + length
                if waiting:
                    link[waiting] = split
                waiting = split
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    return first, last, child, leaf


class Extensions:
    """Longest common extensions of suffixes by lowest common ancestors in a suffix tree.

    The Euler tour's leaf order is found level by level: a node's first leaf
    stands where its parent's does, plus the leaves below its earlier siblings.
    """

    def __init__(self, s: np.ndarray, width: int):
        first, last, child, leaf = ukkonen(s.tolist(), width)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        nodes = np.fromiter(child.values(), np.int64, len(child))
        del child
        self.size, self.width, n = len(s), width, len(first)
        self.leaf = np.asarray(leaf)
        self.edge = np.asarray(last) - np.asarray(first)
        self.parent, self.symbol = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.parent[nodes], self.symbol[nodes] = np.divmod(keys, width)
        below, starts = self.children(self.symbol)
        self.levels = list(self.walk(below, starts))
        # Leaves below each node, from the deepest level up.
        self.leaves = (self.leaf >= 0).astype(np.int64)
        for level in reversed(self.levels):
            np.add.at(self.leaves, self.parent[level], self.leaves[level])
        depth = np.zeros(n, np.int64)
        for level in self.levels:
            depth[level] = depth[self.parent[level]] + self.edge[level]
        place = self.places(self.levels)
        self.rank = self.ranked(place)
        # Where a node is no first child, its parent parts its first leaf from the one before.
        later = np.flatnonzero(place > place[self.parent])
        between = np.zeros(self.size - 1, np.int32)
        between[place[later] - 1] = depth[self.parent[later]]
        self.table = [between]
        step = 1
        while 2 * step <= len(between):
            t = self.table[-1]
            self.table.append(np.minimum(t[:-step], t[step:]))
            step *= 2

    def children(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All nodes but the root by parent, then symbol, and where each parent's begin."""
        order = np.lexsort((symbol[1:], self.parent[1:])) + 1
        return order, np.searchsorted(self.parent[order], np.arange(len(symbol) + 1))

    @staticmethod
    def walk(below: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """The nodes of each level under the root, siblings side by side in their order."""
        level = np.zeros(1, np.int64)
        while True:
            n = starts[level + 1] - starts[level]
            level, n = level[n > 0], n[n > 0]
            if not len(level):
                return
            level = below[np.repeat(starts[level] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            yield level

    def places(self, levels) -> np.ndarray:
        """The tour's number of each node's first leaf."""
        place = np.zeros(len(self.leaf), np.int64)
        for level in levels:
            before = np.cumsum(self.leaves[level]) - self.leaves[level]
            up = self.parent[level]
            new = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
            place[level] = place[up] + before - np.repeat(before[new], np.diff(np.r_[new, len(level)]))
        return place

    def ranked(self, place: np.ndarray) -> np.ndarray:
        rank = np.empty(self.size, np.int64)
        own = np.flatnonzero(self.leaf >= 0)
        rank[self.leaf[own]] = place[own]
        return rank

    def reverse_rank(self, separators: int) -> np.ndarray:
        """Ranks of the suffixes for the reversed order of words; separators stay below all words."""
        symbol = np.where(self.symbol >= separators, separators + self.width - 1 - self.symbol, self.symbol)
        return self.ranked(self.places(self.walk(*self.children(symbol))))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words of the suffixes at a and b (a != b)."""
        a, b = self.rank[a], self.rank[b]
        low, gap = np.minimum(a, b), np.abs(a - b)
        level = np.frexp(gap.astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            t = self.table[k]
            out[at] = np.minimum(t[low[at]], t[low[at] + gap[at] - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one of smaller rank, or the length."""
    r, n = rank.tolist(), len(rank)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        j, own = i + 1, r[i]
        while j < n and r[j] > own:
            j = out[j]
        out[i] = j
    return np.asarray(out)


def runs_of(zones: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """(start, length, period) rows of every run of each word sequence, by start, then period."""
    if not zones:
        return []
    k = len(zones)
    sizes = np.array([len(z) for z in zones])
    words, ids = np.unique(np.concatenate(zones), return_inverse=True)
    # Separator z ends zone z; the last one is unique too, as Ukkonen's algorithm needs.
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    s = np.empty(int(sizes.sum()) + k, np.int64)
    place = np.arange(len(ids)) + np.repeat(np.arange(k), sizes)
    s[place] = ids + k
    s[starts + sizes] = np.arange(k)
    n, width = len(s), k + len(words)
    forward = Extensions(s, width)
    found = [(place, next_smaller(rank)[place] - place) for rank in (forward.rank, forward.reverse_rank(k))]
    roots = np.concatenate([x * (n + 1) + y for x, y in found])  # a pair as one number
    i, p = np.divmod(np.unique(roots), n + 1)
    # The reversal, with the last symbol of s first: moved to the end so that it stays unique there.
    backward = Extensions(np.r_[s[:-1][::-1], s[-1]], width)
    right = forward(i, i + p)
    # The prefix that ends before x is the suffix n - 1 - x of the reversal; the empty prefix is its last symbol.
    back = backward(n - 1 - i, n - 1 - i - p)
    start, length = i - back, back + p + right
    good = (length >= 2 * p) & (length >= least)
    # Start and period name a run, by start, then period.
    key, at = np.unique(start[good] * (n + 1) + p[good], return_index=True)
    first, period = np.divmod(key, n + 1)
    zone = np.searchsorted(starts, first, side="right") - 1
    out = np.stack([first - starts[zone], length[good][at], period], axis=1)
    cut = np.searchsorted(zone, np.arange(k + 1))
    return [out[cut[z]:cut[z + 1]] for z in range(k)]


# -- texts ------------------------------------------------------------------

class Vocabulary(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def word_ids(raw: bytes, vocabulary: Vocabulary) -> np.ndarray:
    """The numbers of a text's words, piece by piece, so that a long text's words are not held at once."""
    number = vocabulary.__getitem__
    parts = [np.fromiter(map(number, words), np.int32, len(words)) for words in (x.split() for x in long_cuts(raw, 1 << 20, CUT))]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def zones_of(ids: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that may hold a run."""
    k = max(1, least // 2)
    h, _ = windows(mix64(ids.astype(np.uint64)), offsets, k)
    size = np.diff(offsets)
    at = np.flatnonzero(np.arange(len(ids)) + k <= np.repeat(offsets[1:], size)) if len(ids) else np.empty(0, np.int64)
    zone = np.repeat(np.arange(len(size)), size)[at]
    borders = offsets
    while True:
        key = mix64(h ^ mix64(zone.astype(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order] = np.r_[False, same] | np.r_[same, False] if len(key) else False
        edge = np.zeros(len(ids) + 1, np.int32)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + k, -1)
        starts, ends = spans(np.cumsum(edge[:-1]) > 0, borders)
        wide = ends - starts >= least
        starts, ends = starts[wide], ends[wide]
        zone = np.searchsorted(starts, at, side="right") - 1
        inside = (zone >= 0) & (at + k <= ends[zone]) if len(starts) else np.zeros(len(at), bool)
        if inside.all():
            return starts, ends
        at, h, zone = at[inside], h[inside], zone[inside]


def document_runs(ids: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """The runs of every document of a slice, places counted from the document's first word."""
    starts, ends = zones_of(ids, offsets, least)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    out: list[list[np.ndarray]] = [[] for _ in range(len(offsets) - 1)]
    a = 0
    while a < len(starts):
        held = np.cumsum(ends[a:] - starts[a:])
        b = a + max(1, int(np.searchsorted(held, TREE_WORDS, side="right")))
        for j, rows in enumerate(runs_of([ids[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())], least), a):
            if len(rows):
                doc = owner[j]
                out[doc].append(rows + np.array([starts[j] - offsets[doc], 0, 0]))
        a = b
    return [np.concatenate(x) if x else np.empty((0, 3), np.int64) for x in out]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """False for words that a run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def pieces_of(ids: np.ndarray, names: list[bytes]) -> Iterator[bytes]:
    """The words joined by one space, in bounded pieces."""
    name = names.__getitem__
    for a in range(0, len(ids), 1 << 16):
        yield (b" " if a else b"") + b" ".join(map(name, ids[a:a + (1 << 16)].tolist()))


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every row.

    ``runs`` lists (start, length, period) by start, then period; starts are
    word numbers from 0. ``collapsed`` is the text without the words that
    repeat a run's first period, joined by one space. Words are runs of
    bytes other than ASCII white space. A null, empty or white text has no
    word, no run and an empty collapsed text; null ids stay null; repeated
    rows are treated each; an empty table gives an empty result. Texts of any
    length are taken whole: words are held as 32-bit numbers, and only
    stretches with repeated windows enter a tree (about 1 KB a word there).
    Other columns play no part, whatever their names.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                        ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())])

    def find(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in byte_slices(texts):
                vocabulary = Vocabulary()
                each = [word_ids(x.encode() if x else b"", vocabulary) for x in texts.slice(a, b - a).to_pylist()]
                offsets = np.r_[0, np.cumsum([len(x) for x in each])].astype(np.int64)
                ids, names = np.concatenate(each), list(vocabulary)
                found = document_runs(ids, offsets, least)
                kept = [x[kept_words(len(x), r)] if len(r) else x for x, r in zip(each, found)]
                rows = np.concatenate(found)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in found])], pa.int32()),
                                                 pa.StructArray.from_arrays([pa.array(rows[:, j], pa.int64()) for j in range(3)],
                                                                            names=["start", "length", "period"]))
                collapsed = pa.array([b"".join(pieces_of(x, names)) for x in kept], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(offsets)), lists, collapsed],
                                                 schema=schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(find, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id and text of every row, each run cut to its first period; see ``find_runs``."""
    return find_runs(docs, doc_id, text, least).select("doc_id", F.col("collapsed").alias("text"))


# -- the query --------------------------------------------------------------

def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in one document of ten the words from a place on repeat a stretch of p words.

    h is the CRC-32 of the decimal id, g = h div 10; where h mod 10 is 0 and
    there are n > 0 words, word i >= a = g mod n becomes original word a + (i - a)
    mod p, with p = 1 + (n - a) div (3 + g mod 8). Null ids plant nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def planted(w):
        n = F.size(w).cast("long")
        a = g % n
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("long")
        end = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get(w, (a + i % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), end), " ")).otherwise(F.lit(""))

    changed = F.transform(F.array(words), planted)[0]
    return rows.withColumn("text", F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (h % 10 == 0), changed).otherwise(F.col("text")))


def run_digest(docs: DataFrame) -> DataFrame:
    """Per document: runs counted, the longest one, and digests of all runs and of the collapsed text."""
    found = find_runs(with_planted_runs(docs))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                                r["period"].cast("string"), F.lit("\n"))), "")
    out = found.withColumn("longest", longest)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"),
                      F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
                      F.floor(F.lit(1000) * F.col("longest.length") / -F.col("longest.period")).cast("long").alias("exponent_milli"),
                      F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
