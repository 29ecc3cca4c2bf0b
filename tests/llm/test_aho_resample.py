import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from murmur.llm import aho_resample as aho
from murmur.llm.queries import op11_dictionary_resample
from pyspark.sql import functions as F

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def runs(text, order):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, order=1, buckets=10_000, seed="2024", least=20, percent=10):
    """(doc_id, n_features, weight, score, rank) by plain loops."""
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, runs(x, order)))
    for x in target:
        t.update(map(bucket, runs(x, order)))
    big_s, big_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))

    out, eligible = {}, []
    for row, (d, x) in enumerate(docs):
        f = runs(x, order)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[row] = [d, len(f), weight, score, None]
        if len(words(x)) >= least:
            eligible.append((-score, d is not None, d or 0, row))
    for place, (*_, row) in enumerate(sorted(eligible)[:percent * len(eligible) // 100], 1):
        out[row][4] = place
    return sorted((tuple(x) for x in out.values()), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_equals_brute_force_on_the_given_tables(spark):
    for sf in ("sf0.001", "sf0.01"):
        d = f"/root/testdata/{sf}"
        want = brute(pairs(spark.read.parquet(f"{d}/documents.parquet")), [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()])
        assert rows_of(op11_dictionary_resample(spark, d)) == want and any(r[-1] for r in want)


@pytest.mark.parametrize("order,dictionary", [(1, 0), (1, 3), (2, 5), (3, 1000)])
def test_edge_rows_runs_and_dictionary_sizes(spark, edge, order, dictionary):
    goal = spark.createDataFrame([("Word1 and then the quick",), (None,), ("",)], "text string")
    got = aho.target_resample(edge, goal, order=order, buckets=97, least_words=1, percent=60, dictionary=dictionary)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = brute(pairs(edge), [r.text for r in goal.collect()], order, 97, least=1, percent=60)
    mine = rows_of(got)
    # Rows that repeat an id and a text tie: their ranks are the same set.
    assert mine == want


def test_empty_tables(spark, edge, none):
    assert aho.target_resample(none, edge).count() == 0
    assert aho.target_resample(none, none).count() == 0
    assert rows_of(aho.target_resample(edge, none)) == brute(pairs(edge), [])


def test_joined_crc():
    rnd = np.random.default_rng(1)
    a, b = ([rnd.bytes(int(n)) for n in rnd.integers(0, 5000, 300)] for _ in range(2))
    crc = [np.array([zlib.crc32(x) for x in y], np.uint32) for y in (a, b)]
    got = aho.joined_crc(*crc, np.array([len(x) for x in b]), aho.zero_tables())
    assert got.tolist() == [zlib.crc32(x + b" " + y) for x, y in zip(a, b)]


def test_long_texts_are_scanned_in_pieces(monkeypatch):
    text = "Äb c1, d " * 3000 + "x" * 700 + " c1 d"
    machine, tables = aho.automaton([b"c1", "äb".encode(), b"d"]), aho.zero_tables()
    whole = list(aho.features(machine, pa.array([text, None, "d d"]), 3, 1000, tables))
    cut = aho.text_units
    monkeypatch.setattr(aho, "text_units", lambda column, pattern: cut(column, pattern, 64))
    parts = list(aho.features(machine, pa.array([text, None, "d d"]), 3, 1000, tables))
    assert len(parts) > 100 > len(whole)

    def counted(x):
        return Counter((int(r), int(b)) for _, rows, buckets in x for r, b in zip(rows, buckets)), Counter(int(r) for w, _, _ in x for r in w)

    assert counted(parts) == counted(whole)
    assert counted(whole)[0] == Counter((i, zlib.crc32(f.encode()) % 1000) for i, t in enumerate([text.replace("Ä", "Ä"), None, "d d"]) for f in runs(t, 3))


def test_the_dictionary_is_bounded_and_takes_the_most_frequent(spark):
    df = spark.createDataFrame([("a a a a b b b c c d",), ("a b",), (None,)], "text string")
    assert aho.frequent_words(df, most=2) == [b"a"] or set(aho.frequent_words(df, most=2)) == {b"a", b"b"}
    assert set(aho.frequent_words(df, most=10)) == {b"a", b"b", b"c", b"d"} and aho.frequent_words(df, most=0) == []
    assert set(aho.frequent_words(df, most=10, held=1)) == {b"a", b"b", b"c", b"d"}
    assert aho.frequent_words(df.filter(F.lit(False))) == []
