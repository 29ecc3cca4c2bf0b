import hashlib
import random
import re

import pytest
from murmur.llm import winnowing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, id string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, it in items:
            v = words(it)
            n = min(10, len(v))
            if item is None or not n:
                continue
            own = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in own:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), digest, bool(hit))
    return out


def case():
    rnd = random.Random(11)
    pool = [f"{c}{i}" for c in ("É", "é", "b", "K") for i in range(40)]
    # Few words, so spans repeat, overlap and lie on many diagonals.
    few = ["aa", "Bb", "cc"]
    items = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.choice([10, 12, 30])))) for i in range(12)]
    items += [(50, " ".join(rnd.choice(few) for _ in range(25))), (51, "aa, bb aa-bb aa bb aa bb aa bb aa bb"), (52, "short item here"),
              (53, "Short  ITEM here!"), (54, None), (55, "..."), (None, "aa"), (56, "nine words are too few for one whole window"), (12, items[0][1])]
    docs = []
    for d in range(60):
        text = [rnd.choice(pool) for _ in range(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 2)):
            _, it = rnd.choice(items[:13])
            v = it.split()
            a = rnd.randint(0, len(v) - 1)
            text[rnd.randint(0, len(text)):0] = v[a:a + rnd.randint(5, 30)]
        docs.append((d, rnd.choice([" ", "; ", "\n"]).join(text)))
    docs += [(100, " ".join(rnd.choice(few) for _ in range(600))), (101, None), (102, ""), (103, "A short item here, a SHORT item: here"), (104, "-- !!")]
    return docs, items


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_report_equals_all_windows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(winnowing, "BROADCAST_RUNS", broadcast)
    docs, items = case()
    got = winnowing.contamination_report(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                                         spark.createDataFrame([(*x, "c") for x in items], ITEMS)).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute(docs, items)
    assert sum(r.contaminated for r in got) > 10


def test_edge_rows_and_empty_tables(spark, edge, none):
    items = spark.createDataFrame([(1, "word1 and then some1 word2 and then some2 word3 and then", "c"), (2, "one", "c")], ITEMS)
    got = winnowing.contamination_report(edge, items).collect()
    assert len(got) == edge.count()
    assert {r.doc_id for r in got if r.contaminated} == {7, 8, 9, 10, 11}
    left = winnowing.drop_contaminated(edge, items)
    assert left.columns == edge.columns and left.count() == edge.count() - 5
    assert winnowing.contamination_report(none, items).count() == 0
    no_items = spark.createDataFrame([], ITEMS)
    assert not [r for r in winnowing.contamination_report(edge, no_items).collect() if r.contaminated or r.n_items]
    assert winnowing.drop_contaminated(edge, no_items).count() == edge.count()


def test_no_python_in_the_plan(spark, edge):
    items = spark.createDataFrame([(1, "one", "c")], ITEMS)
    plan = winnowing.contamination(edge, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
