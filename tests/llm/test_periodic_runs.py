import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from murmur.llm import periodic_runs as per
from murmur.llm.queries import op13_periodic_runs


def brute_runs(w, least):
    """(start, length, period) of all runs: stretches that keep period q, shortest q first."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def planted(d, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if d is None or not w:
        return w
    h = zlib.crc32(str(d).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def brute(d, text):
    w = planted(d, text)
    runs = brute_runs(w, per.LEAST)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (d, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def results(df):
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def test_equals_brute_force_on_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 6000")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = results(per.run_digest(docs))
    assert got == sorted((brute(d, t) for d, t in rows), key=str) and sum(r[1] > 0 for r in got) > 10


def test_all_documents_have_true_and_maximal_runs(spark):
    """On the longer documents too: every run is periodic, least in its period, and stops at both ends."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: planted(r.doc_id, r.text) for r in per.with_planted_runs(docs).join(docs.select("doc_id"), "doc_id").collect()
             for _ in [0] if zlib.crc32(str(r.doc_id).encode()) % 10}
    found = per.find_runs(docs).collect()
    for r in found:
        w = texts.get(r.doc_id)
        if w is None:
            continue
        for s, n, q in r.runs:
            assert n >= max(per.LEAST, 2 * q) and all(w[i] == w[i + q] for i in range(s, s + n - q))
            assert (s == 0 or w[s - 1] != w[s - 1 + q]) and (s + n == len(w) or w[s + n] != w[s + n - q])
    assert results(op13_periodic_runs(spark, "/root/testdata/sf0.01")) == results(per.run_digest(docs))


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_random_words(least):
    rnd = random.Random(least)
    for _ in range(300):
        docs = []
        for _ in range(rnd.randrange(1, 5)):
            n = rnd.randrange(0, 70)
            w = [rnd.randrange(rnd.choice([1, 2, 3, 9])) for _ in range(n)]
            if rnd.random() < 0.5 and n:
                root = [rnd.randrange(3) for _ in range(rnd.randrange(1, 9))]
                at = rnd.randrange(n)
                w[at:at] = (root * 30)[:rnd.randrange(2, 70)]
            docs.append(np.array(w, np.int64))
        offsets = np.r_[0, np.cumsum([len(x) for x in docs])].astype(np.int64)
        got = per.document_runs(np.concatenate(docs), offsets, least)
        assert [[tuple(r) for r in x.tolist()] for x in got] == [brute_runs(x.tolist(), least) for x in docs]


def test_extensions_equal_plain_comparison():
    rnd = np.random.default_rng(5)
    s = np.r_[rnd.integers(1, 4, 200), 0]
    ext = per.Extensions(s, 4)
    a, b = rnd.integers(0, 200, (2, 500))
    keep = a != b
    got = ext(a[keep], b[keep])
    for x, y, n in zip(a[keep].tolist(), b[keep].tolist(), got.tolist()):
        assert (s[x:x + n] == s[y:y + n]).all() and s[x + n] != s[y + n]
    assert (np.argsort(ext.rank) == sorted(range(201), key=lambda i: s[i:].tolist())).all()


def test_edge_rows(spark, edge, none):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    few = [(d, t) for d, t in rows if len(t or "") < 5000]
    got = results(per.run_digest(edge))
    assert len(got) == len(rows) and set(sorted((brute(d, t) for d, t in few), key=str)) <= set(got)
    assert per.run_digest(none).count() == 0
    kept = {r.doc_id: r.text for r in per.drop_repeats(edge.filter("doc_id in (2, 3, 4, 10)")).collect()}
    assert kept == {2: "", 3: "", 4: "", 10: "one"}


def test_long_periodic_texts(spark):
    """Zones longer than a shared tree, and words in pieces."""
    rnd = random.Random(2)
    root = [f"w{rnd.randrange(5000)}" for _ in range(20_000)]
    text = " ".join(["start", *root, *root, *root[:7], "end", *["a", "b"] * 40_000])
    row = per.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(1, 40_007, 20_000), (40_009, 80_000, 2)]
    assert row.collapsed == " ".join(["start", *root, "end", "a", "b"])
    raw = text.encode()
    whole, cut = per.Vocabulary(), per.Vocabulary()
    assert (per.word_ids(raw, whole) == np.concatenate([per.word_ids(x, cut) for x in per.long_cuts(raw, 1000, per.CUT)])).all()
