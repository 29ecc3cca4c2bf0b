"""Byte-level BPE over many texts: vectorised pre-tokens, the library's ids.

The tokenizer splits a text into pre-tokens with the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

and encodes each pre-token on its own, so equal pre-tokens have equal ids.
Here the split is a comparison of neighbouring character classes over the
whole slice, each distinct pre-token of a slice is looked up once, and only
those that the worker has not met yet go to the tokenizers library. The
character classes are read off the library's own splitter, not assumed.
Texts that contain an added special string go to the library whole.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from murmur.llm.common import worker_state
from murmur.llm.flat import code_points, hash_spans, mix64, spaced_cuts, text_of

LETTER, NUMBER, OTHER, BLANK = 0, 1, 2, 3
#: Pre-tokens in each of a worker's two cache generations (about 170 bytes each).
CACHE_LIMIT = 500_000
#: Longest pre-token that is remembered, in characters; longer ones are encoded each time.
CACHE_CHARS = 64
#: A text of more characters is worked on in pieces of about this many.
PIECE = 4 << 20


def library_tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=4)
def character_classes(spec: str) -> tuple[tuple[int, int, int], ...]:
    """(first, last, class) runs of all code points that are not OTHER.

    Each code point c is put after ASCII characters whose class is known: it
    is other if the splitter joins it to '!', a letter if to 'a', a number
    if to '1', else white space. Runs on the driver, once per tokenizer.
    Planes 4 to 13 are unassigned and 15 and 16 private: other.
    """
    pre = library_tokenizer(spec).pre_tokenizer
    left = np.array([c for c in [*range(0x40000), *range(0xE0000, 0xE1000)] if not 0xD800 <= c <= 0xDFFF and c != 0x27])
    found = np.full(0x110000, OTHER, np.uint8)
    for lead, kind in (("!", OTHER), ("a", LETTER), ("1", NUMBER)):
        rest = []
        for part in np.array_split(left, 1 + len(left) // 50_000):
            probe = "".join(f"\n{lead}{chr(c)}" for c in part)
            starts = np.zeros(len(probe), bool)
            starts[[s for _, (s, _) in pre.pre_tokenize_str(probe)]] = True
            alone = starts[2::3]
            found[part[~alone]] = kind
            rest.append(part[alone])
        left = np.concatenate(rest)
    found[left] = BLANK
    edges = np.flatnonzero(np.diff(found)) + 1
    firsts, lasts = np.r_[0, edges], np.r_[edges, 0x110000] - 1
    return tuple((int(a), int(b), int(found[a])) for a, b in zip(firsts, lasts) if found[a] != OTHER)


def class_table(runs: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for a, b, kind in runs:
        out[a:b + 1] = kind
    return out


def pretoken_starts(cps: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Start positions of all pre-tokens; each runs to the next start or its text's end."""
    n = len(cps)
    if not n:
        return np.empty(0, np.int64)
    kind = classes[cps]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start = border[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last blank before other text: a space joins what follows, any other blank stands alone.
    at = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~border[1:n])
    start[at] = True
    start[at + 1] = cps[at] != 0x20
    # A contraction takes its letters off the run that they begin.
    p = np.flatnonzero((cps == 0x27) & start)
    p = p[p + 1 < n]
    p = p[~border[p + 1] & (kind[p + 1] == LETTER)]
    one = cps[p + 1]
    two = np.where((p + 2 < n) & ~border[np.minimum(p + 2, n)], cps[np.minimum(p + 2, n - 1)], 0)
    pair = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    length = np.where(np.isin(one, [ord(x) for x in "stmd"]), 2, np.where(pair, 3, 0))
    p, length = p[length > 0], length[length > 0]
    start[p + 1] = False
    after = p + length
    inner = (after < n) & ~border[np.minimum(after, n)]
    start[after[inner]] = True
    return np.flatnonzero(start)


class Pretokens:
    """Pre-tokens of one slice of texts: spans, their text's number and their hashes."""

    def __init__(self, texts: list[str], classes: np.ndarray):
        self.text = "".join(texts)
        cps, offsets = code_points(texts)
        self.starts = pretoken_starts(cps, offsets, classes)
        # A text's end is the start of the next text's first pre-token.
        self.ends = np.r_[self.starts[1:], len(cps)].astype(np.int64) if len(self.starts) else self.starts
        self.owner = text_of(self.starts, offsets)
        self.hashes = hash_spans(mix64(cps.astype(np.uint64)), self.starts, self.ends)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, the index of one occurrence of each, and each pre-token's place among them."""
        return np.unique(self.hashes, return_index=True, return_inverse=True)

    def strings(self, index) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.starts[index].tolist(), self.ends[index].tolist())]


class Generations:
    """A bounded cache: when the young half is full it becomes the old one."""

    def __init__(self, limit: int = CACHE_LIMIT):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, keys: list[int]) -> list:
        out = list(map(self.young.get, keys))
        for i in [i for i, x in enumerate(out) if x is None]:
            if (x := self.old.get(keys[i])) is not None:
                out[i] = x
                self.put(keys[i], x)
        return out

    def put(self, key: int, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Encoder:
    """A worker's tokenizer with its cache of pre-token ids (as bytes of uint32)."""

    def __init__(self, spec: str, runs):
        self.tokenizer = library_tokenizer(spec)
        self.classes = class_table(runs)
        self.specials = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
        self.known = Generations()

    def has_special(self, text: str) -> bool:
        return any(x in text for x in self.specials)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(self, hashes: np.ndarray, pre: Pretokens, index: np.ndarray) -> list[bytes]:
        """Ids of distinct pre-tokens, from the cache or else from the library."""
        keys = hashes.tolist()
        out = self.known.get(keys)
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            strings = pre.strings(index[missing])
            for i, s, ids in zip(missing, strings, self.library(strings)):
                out[i] = np.array(ids, np.uint32).tobytes()
                if len(s) <= CACHE_CHARS:
                    self.known.put(keys[i], out[i])
        return out

    def split(self, texts: list[str]) -> tuple[list[str], dict[int, list[int]]]:
        """Texts for the vectorised way (those with a special string blanked) and the others' ids."""
        odd = [i for i, x in enumerate(texts) if self.has_special(x)]
        whole = dict(zip(odd, self.library([texts[i] for i in odd]))) if odd else {}
        return [("" if i in whole else x) for i, x in enumerate(texts)] if odd else texts, whole

    def pieces(self, text: str) -> list[str]:
        """A long text cut after line ends where the split is the same on either side:
        one newline between two characters that are not blank."""
        cps = code_points([text])[0]
        at = np.flatnonzero(cps[1:-1] == 0x0A) + 1
        at = at[(self.classes[cps[at - 1]] != BLANK) & (self.classes[cps[at + 1]] != BLANK)] + 1
        cuts = spaced_cuts(at, len(text), PIECE)
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and n + 1 offsets."""
        if len(texts) == 1 and len(texts[0]) > PIECE and not self.has_special(texts[0]):
            ids = np.concatenate([self.encode_batch([p])[0] for p in self.pieces(texts[0])])
            return ids, np.array([0, len(ids)])
        return self.encode_batch(texts)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain, whole = self.split(texts)
        pre = Pretokens(plain, self.classes)
        uniq, index, place = pre.distinct()
        pieces = self.ids_of(uniq, pre, index)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        pool = np.frombuffer(b"".join(pieces), np.uint32)
        first = np.cumsum(lengths) - lengths
        each = lengths[place]
        total = int(each.sum())
        shift = np.repeat(first[place] - (np.cumsum(each) - each), each)
        ids = pool[np.arange(total) + shift] if total else np.empty(0, np.uint32)
        counts = np.bincount(pre.owner, weights=each, minlength=len(texts)).astype(np.int64)
        if whole:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, x in whole.items():
                parts[i], counts[i] = np.asarray(x, np.uint32), len(x)
            ids = np.concatenate(parts)
        return ids, np.r_[0, np.cumsum(counts)].astype(np.int64)


def encoder(spec: str, runs) -> Encoder:
    return worker_state(f"byte-bpe-{hash(spec)}", lambda: Encoder(spec, runs))
