import random
import re

import numpy as np
import pyarrow as pa
import pytest
from murmur.llm import components, minhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent=80):
    """Least id reachable, by comparing all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def families(seed=2):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, doc = [], 100
    for size, edits in ((40, 4), (30, 9), (25, 14), (6, 2), (3, 0)):
        base = [rnd.choice(vocabulary) for _ in range(120)]
        for _ in range(size):
            words = list(base)
            for _ in range(rnd.randint(0, edits)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((doc, " ".join(words)))
            doc += 1
    rows += [(doc + i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 5, 60])))) for i in range(40)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_components_equal_all_pairs(spark, words):
    rows = families()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in minhash.near_duplicates(df, words=words).collect()}
    want = brute(rows, words)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert all(got[i].n_shingles == len(shingles(t, words)) for i, t in rows)


def test_families_cut_into_chunks_find_the_same(spark, monkeypatch):
    rows = families(7)
    monkeypatch.setattr(minhash.stray_links, "__defaults__", (600,))
    monkeypatch.setattr(minhash, "LEAVES", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, words=2).collect()}
    assert got == brute(rows, 2)


def test_strays_cost_no_pairs_of_main_members(spark):
    """A family of many connected members with few strays: every group holds strays, main sets are copied once per stray chunk."""
    n, s = 900, 7
    base = list(range(100))
    sets, family = [], []
    for i in range(n + s):
        own = base[:97] + [1000 + i, 2000 + i, 3000 + i] if i < n else base[:95] + [5000 + 10 * i + j for j in range(5)]
        sets.append((i, np.array(sorted(own), np.uint64).tobytes(), 100, [1, 2, 3, 4]))
        family.append((0, i, 0 if i < n else i))
    reps = spark.createDataFrame([(r, k, h) for r, _, k, h in sets], "rep long, n_shingles long, hashes array<long>")
    members = spark.createDataFrame([(r, bytearray(x)) for r, x, _, _ in sets], "rep long, members binary")
    fam = spark.createDataFrame(family, "family long, rep long, label long")
    out = minhash.stray_links(fam, reps, members, 2, 80, block=1000)
    assert {r.a for r in out.collect()} == set(range(n, n + s))
    plan = out._jdf.queryExecution().toString()
    assert "Generate" in plan
    # Rows that reach the groups: a main set once per stray chunk, a stray once per main and stray chunk.
    grouped = out._jdf.queryExecution().optimizedPlan().children().apply(0)
    from pyspark.sql import DataFrame

    jvm = spark._jvm.org.apache.spark.sql.classic.Dataset
    rows = DataFrame(jvm.ofRows(spark._jsparkSession, grouped), spark).count()
    mains, strays = -(-n * 100 // 1000), 1
    assert rows <= n * strays + s * (mains + strays) + 5


def test_long_texts_are_hashed_in_pieces():
    rnd = random.Random(3)
    text = "".join(rnd.choice(["aB ", "é\n", "word\t", "x" * 40 + " ", "  "]) for _ in range(2000)) + "y" * 300
    want = minhash.shingle_sets(pa.array([text]), 3, 1 << 30)
    for step in (1, 64, 1000):
        got = minhash.shingle_sets(pa.array([text]), 3, step)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_edge_rows(spark, edge, none):
    rows = minhash.near_duplicates(edge, words=2).collect()
    assert len(rows) == edge.count()
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows}
    assert {(2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (10, 1, 10, True), (11, 1, 10, False)} <= got
    assert any(d is None and c is None and k for d, _, c, k in got)
    assert {c for d, _, c, _ in got if d in (7, 8, 9)} == {7}
    kept = minhash.drop_near_duplicates(edge, words=2)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 1, 2, 3, 4, 5, 6, 7, 10, 12, 13, 14]
    assert minhash.near_duplicates(none).count() == 0


def test_contraction_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 299), (299, 300)]
    nodes = [(i,) for i in [*range(1, 61), *range(100, 160), 200, 299, 300, 400]]
    got = {r.node: r.label for r in components.contract(
        spark.createDataFrame(links, "a long, b long"), spark.createDataFrame(nodes, "node long")).collect()}
    want = {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 160)} | {200: 200, 299: 299, 300: 299, 400: 400}
    assert got == want
