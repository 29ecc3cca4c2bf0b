import hashlib
import random
import re

from murmur.llm import line_chunks


def chunks(text):
    """(first, last) line numbers of the chunks, set by set: boundaries before 0 lines and after 1 lines."""
    lines = text.split("\n")
    wordy = [i for i, x in enumerate(lines) if re.search(r"[^\x09-\x0D\x20]", x)]
    bits = [int(hashlib.md5(lines[i].encode()).hexdigest()[:15], 16) for i in wordy]
    out = set()
    for s in range(line_chunks.SETS):
        cuts = [0, *(j for j in range(1, len(wordy)) if bits[j - 1] >> s & 1 or not bits[j] >> s & 1), len(wordy)]
        out |= {(wordy[x], wordy[y - 1]) for x, y in zip(cuts, cuts[1:]) if y - x > 1}
    assert all(lines[a:b + 1][0] and wordy.index(b) == wordy.index(a) + 1 for a, b in out)
    return sorted(out)


def brute(rows):
    """rows in (doc_id, text) order; the first occurrence of a chunk stays."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        lines, gone, dropped = text.split("\n"), 0, set()
        for a, b in chunks(text):
            body = "\n".join(lines[a:b + 1])
            if body in seen:
                gone += 1
                dropped |= set(range(a, b + 1))
            seen.add(body)
        kept = [x for i, x in enumerate(lines) if i not in dropped]
        out[doc] = (text if not gone else "\n".join(kept), gone, len(dropped))
    return out


def corpus():
    rnd = random.Random(4)
    pool = [f"line number {i} of the pool" for i in range(400)]
    passage = [f"a passage line {i} that many have" for i in range(12)]
    rows = []
    for d in range(80):
        text = [rnd.choice(pool) for _ in range(rnd.randint(1, 25))]
        if d % 2:
            at = rnd.randint(0, len(text))
            text[at:at] = passage
        rows.append((d, "\n".join(text)))
    rows += [(200 + i, rows[3][1]) for i in range(20)] + [(300, "\n\n\n"), (301, "\n\n\n"), (302, ""), (303, "one line"), (304, "one line"),
             (305, "a\n\n \nb"), (306, "x\na\n\n \nb\ny"), (307, "a\n\nb"), (308, "same\nsame\nsame"), (309, "same\nsame\nsame")]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    got = line_chunks.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.text, r.removed_chunks, r.removed_lines) for r in got} == brute(rows)
    gone = {r.doc_id: r.removed_lines for r in got}
    assert all(gone[d] >= 12 for d in range(3, 80, 2))  # the passage
    assert gone[302] == gone[303] == gone[304] == gone[301] == gone[307] == gone[308] == gone[309] == 0
    assert gone[306] == 4 and {r.doc_id: r.text for r in got}[306] == "x\ny"


def test_an_inserted_line_moves_no_boundary(spark):
    lines = [f"text line {i}" for i in range(200)]
    a, b = ({"\n".join(x[i:j + 1]) for i, j in chunks("\n".join(x))} for x in (lines, [*lines[:90], "new line", *lines[90:]]))
    assert len(a - b) == 1 and len(a) == 199
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    got = df.select(line_chunks.chunked(df.text).alias("c")).first()["c"]
    assert [(x["no"], x["last"]) for x in got] == chunks("\n".join(lines))


def test_a_hot_chunk_is_spread_and_a_long_text_takes_linear_time(spark):
    import time

    hot = [(i, f"own line {i}\nhot first line\nhot second line") for i in range(3000)]
    long = "\n".join(f"long line {i} of many words" for i in range(60_000))
    rows = [*hot, (9000, long), (9001, "one more line\n" + long)]
    begin = time.time()
    got = {r.doc_id: r for r in line_chunks.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].text == f"own line {i}" and got[i].removed_lines == 2 for i in range(1, 3000)) and got[0].removed_lines == 0
    assert got[9001].text == "one more line" and got[9001].removed_lines == 60_000 and got[9000].text == long
    assert time.time() - begin < 120


def test_edge_rows(spark, edge, none):
    out = line_chunks.drop_repeated_chunks(edge)
    assert set(out.columns) == set(edge.columns) | {"removed_lines"}
    rows = out.collect()
    assert len(rows) == edge.count()
    texts = {(r.doc_id, r.n_chars): r.text for r in edge.collect()}
    for r in rows:
        assert r.text == texts[(r.doc_id, r.n_chars)] and r.removed_chunks == r.removed_lines == 0
    assert line_chunks.drop_repeated_chunks(none).count() == 0


def test_no_python_in_the_plan(spark, edge):
    plan = line_chunks.drop_repeated_chunks(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def passage_loss(spark, lengths, pairs=1000):
    """Per passage length: passages in two texts, with ten other lines around each, that lose nothing, and lines removed on average."""
    rows, of = [], {}
    for n in lengths:
        for p in range(pairs):
            passage = [f"passage {n} {p} line {i}" for i in range(n)]
            for copy in range(2):
                own = [f"text {n} {p} {copy} line {i}" for i in range(20)]
                of[len(rows)] = n
                rows.append((len(rows), "\n".join(own[:10] + passage + own[10:])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    gone = {n: [] for n in lengths}
    for r in line_chunks.drop_repeated_chunks(df).select("doc_id", "removed_lines").collect():
        if r.doc_id % 2:
            gone[of[r.doc_id]].append(r.removed_lines)
        else:
            assert r.removed_lines == 0
    return {n: (100 * sum(x == 0 for x in v) / pairs, sum(v) / pairs) for n, v in gone.items()}


def test_short_passages_are_removed(spark):
    for n, (untouched, lines) in passage_loss(spark, [1, 2, 3, 4, 6, 8, 12], 300).items():
        assert (untouched, lines) == ((100.0, 0.0) if n == 1 else (0.0, float(n)))
