import base64
import hashlib
import random

import numpy as np
import pytest
from murmur.llm import syncmers as syn
from murmur.llm.queries import op12_closed_syncmers

M64 = (1 << 64) - 1


def mix(x):
    x = (x + 0x9E3779B97F4A7C15) & M64
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M64
    return x ^ x >> 31


def plain_anchors(text, k=syn.K, s=syn.S):
    """{48-bit hash: first place} of the closed syncmers, by plain loops."""
    def inner(x):
        h = 0
        for c in x:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) & M64
        return mix(h)

    out = {}
    for i in range(len(text) - k + 1):
        h = [inner(text[i + j:i + j + s]) for j in range(k - s + 1)]
        if min(h) in (h[0], h[-1]):
            x = h[0]
            for j in [*range(s, k - s, s), k - s]:
                x = mix((x * 0x9E3779B97F4A7C15 + h[j]) & M64)
            out.setdefault(x >> 16, i)
    if text and not out:
        out[int.from_bytes(hashlib.blake2b(text.encode(), digest_size=6).digest(), "little")] = 0
    return out


def plain_print(text):
    rows = sorted(plain_anchors(text).items())[:syn.SIZE]
    return base64.b64encode(b"".join(h.to_bytes(6, "little") + p.to_bytes(4, "little") for h, p in rows)).decode()


def plain_likeness(a, b):
    """Twice the longest common chain (by quadratic dynamic programming) over the anchors in the shared range."""
    x, y = (sorted(plain_anchors(t).items())[:syn.SIZE] for t in (a, b))
    if not x or not y:
        return float(len(x) == len(y))
    bounds = [z[-1][0] for z in (x, y) if len(z) >= syn.SIZE]
    if bounds:
        x, y = ([r for r in z if r[0] <= min(bounds)] for z in (x, y))
    other = dict(y)
    places = [other[h] for _, h in sorted((p, h) for h, p in x if h in other)]
    best = []
    for i, p in enumerate(places):
        best.append(1 + max((best[j] for j in range(i) if places[j] < p), default=0))
    return 2 * max(best, default=0) / (len(x) + len(y))


def brute(rows):
    """Results by plain loops; rows that repeat an id and a text are one document. Ties of ids need one text each here."""
    docs = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    following = {docs[i]: docs[(i + 1) % len(docs)][2] for i in range(len(docs))}
    out = []
    for d, t in rows:
        t = t or ""
        other = following[(d is not None, d or 0, t)]
        n = len(t) // 2
        edited = t[:len(t) - n] + other[:n]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_print(t), plain_print(edited),
                    plain_likeness(t, edited), plain_likeness(t, other)))
    return sorted(out, key=str)


def results(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"))
                   for r in df.collect()), key=str)


def test_equals_brute_force_on_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 3000")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert len(rows) > 100 and results(syn.syncmer_digest(docs)) == brute(rows)


def test_neighbours_over_many_parts(spark):
    """All documents of sf0.01, cut into many small parts: every edited text is that of the next id."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in op12_closed_syncmers(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        other, n = rows[(i + 1) % len(rows)][1], len(t) // 2
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256((t[:len(t) - n] + other[:n]).encode()).hexdigest()
    prints = {}
    for d, t in rows:
        assert prints.setdefault(t, got[d].fingerprint) == got[d].fingerprint
    long = [r for r in got.values() if r.n_chars > 200]
    assert np.mean([r.near_edited for r in long]) > 0.45 and np.mean([r.near_next for r in long]) < 0.05


@pytest.mark.parametrize("part_bytes,parts", [(1, 5), (300, 1000), (1 << 30, 7)])
def test_in_order_gives_every_row_its_successor(spark, part_bytes, parts):
    rnd = random.Random(3)
    rows = [(None if i % 9 == 0 else rnd.randrange(-50, 200), f"text {rnd.randrange(60)}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = syn.in_order(df, part_bytes, parts)
    held = out.collect()
    keys = sorted({((r.doc_id is not None), r.doc_id or 0, r.th) for r in held})
    assert sum(not r.ahead for r in held) == len(rows) and len({r.part for r in held}) <= parts * 2
    by_part = {}
    for r in held:
        by_part.setdefault(r.part, []).append(((r.doc_id is not None), r.doc_id or 0, r.th, r.ahead))
    for part in by_part.values():
        own = sorted({k[:3] for k in part if not k[3]})
        (ahead,) = {k[:3] for k in part if k[3]}
        assert own == keys[keys.index(own[0]):keys.index(own[0]) + len(own)]
        assert ahead == keys[(keys.index(own[-1]) + 1) % len(keys)]


def test_edge_rows(spark, edge, none):
    few = edge.filter("length(text) < 5000 or text is null")
    rows = [(r.doc_id, r.text) for r in few.select("doc_id", "text").collect()]
    assert results(syn.syncmer_digest(few)) == brute(rows)
    assert syn.syncmer_digest(edge).count() == edge.count() and syn.syncmer_digest(none).count() == 0
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert results(syn.syncmer_digest(one)) == brute([(5, "abcdef")])
    prints = syn.fingerprints(edge)
    assert {r.doc_id: r.fingerprint for r in prints.collect()}[3] == "" and syn.fingerprints(none).count() == 0
    row = {r.doc_id: r for r in prints.collect()}[1]
    assert [(x.hash, x.place) for x in row.anchors] == sorted(plain_anchors(row_text(edge)).items())


def row_text(edge):
    return edge.filter("doc_id = 1").first()["text"]


def test_long_texts_in_pieces_give_the_same_fingerprint():
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdé \U0001f600") for _ in range(9000))
    (want,) = syn.text_anchors([text])
    for step in (13, 100, 4096):
        (got,) = syn.text_anchors([text], step=step)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    few = [text[:700], "", "short", text[:700]]
    assert [syn.packed(x) for x in syn.text_anchors(few)] == [plain_print(x) for x in few]


def test_anchors_are_free_of_context_and_likeness_of_order():
    rnd = random.Random(7)
    passage = "".join(rnd.choice("abcdefghij ") for _ in range(400))
    inside = set(plain_anchors(passage))
    assert inside <= set(plain_anchors("zzz" * 9 + passage + "yy" * 20))
    a = "".join(rnd.choice("abcdefghij ") for _ in range(1500))
    (x, shifted, swapped, none) = syn.text_anchors([a, "new start " + a[:700] + " something between " + a[700:], a[750:] + a[:750], ""])
    assert syn.likeness(x, x) == 1.0 and syn.likeness(none, none) == 1.0 and syn.likeness(x, none) == 0.0
    assert syn.likeness(x, shifted) > 0.85 and 0.35 < syn.likeness(x, swapped) < 0.75
    assert [list(map(int, y)) for y in syn.unpacked(syn.packed(x))] == [list(map(int, y)) for y in x]
