import pytest
import regex

from murmur.operators import text
from murmur.sources import fixtures as fx


def _comments(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "comment_id long, commentText string")


def test_unicode_tokens(spark):
    df = _comments(spark, ["ét naïve 中文 ²"])
    toks = [r["token"] for r in text.token_table(df).orderBy("pos").collect()]
    assert toks == ["e", "t", "naïve", "中文", "²"]


def test_short_comments_trigrams(spark):
    df = _comments(spark, ["", "a", "a b", "a b c"])
    rows = text.ngram_table(df, 3).collect()
    assert [(r["comment_id"], r["gram"]) for r in rows] == [(3, "a b c")]


def test_doc_freq_counts_comments(spark):
    df = _comments(spark, ["a a b", "a"])
    got = {r["token"]: r["n_comments"] for r in text.token_doc_freq(df, []).collect()}
    assert got == {"a": 2, "b": 1}


def test_doc_freq_first_n(spark):
    df = _comments(spark, ["x", "y", "x y"])
    got = {r["token"]: r["n_comments"] for r in text.token_doc_freq(df, [], limit=2).collect()}
    assert got == {"x": 1, "y": 1}


def test_cased_tokens_split_tails_and_marks(spark):
    df = _comments(spark, ["I don't know... (really)!"])
    got = sorted((r["token"], r["count"]) for r in text.token_counts(df).collect())
    assert ("'t", 1) in got and (".", 3) in got and ("I", 1) in got and ("(", 1) in got


def test_ngram_counts_brute_force(spark):
    docs = ["The cat sat on the mat", "the cat", "", None, "Mat on the cat sat THE"]
    df = _comments(spark, docs)
    word = regex.compile(r"[\p{L}\p{N}_]+")
    expect = {}
    for n in (1, 2, 3):
        grams = set()
        for d in docs:
            t = word.findall((d or "").lower())
            grams |= {" ".join(t[i:i + n]) for i in range(len(t) - n + 1)}
        expect[n] = len(grams)
    got = {r["n"]: r["n_distinct"] for r in text.ngram_counts(df).collect()}
    assert got == expect


def test_top_words_order_and_stopwords(spark):
    df = _comments(spark, ["b b a a c the THE", "c"])
    rows = text.top_words(df, ["The"], n=2).collect()
    assert [(r["token"], r["count"]) for r in rows] == [("a", 2), ("b", 2)]


def test_np_chunks_greedy(spark):
    # the(DT) big(NN) cat(NN) that(JJ) dog(NN): <DT><NN> <NN> <JJ><NN>
    df = _comments(spark, ["the big cat that dog"])
    chunks = [r["chunk"] for r in text.np_chunks(df, fx.fx_tag_lexicon(spark)).orderBy("chunk_no").collect()]
    assert chunks == ["<DT><NN>", "<NN>", "<JJ><NN>"]
    big = text.np_chunks(df, fx.fx_tag_lexicon(spark))
    assert big.count() == 3


def test_remove_words_is_case_sensitive(spark):
    df = spark.createDataFrame([("The",), ("the",), ("x",)], "token string")
    assert sorted(r["token"] for r in text.remove_words(df, ["the"]).collect()) == ["The", "x"]


def test_np_chunks_reject_a_token_with_two_tags(spark):
    lex = fx.fx_tag_lexicon(spark)
    with pytest.raises(ValueError):
        text.np_chunks(_comments(spark, ["the"]), lex.unionByName(lex))
    none = text.np_chunks(_comments(spark, ["big cat", None]), lex.limit(0))
    assert [r["chunk"] for r in none.orderBy("chunk_no").collect()] == ["<NN>", "<NN>"]


def test_regex_once_per_row(spark):
    from murmur.plans import catalog

    for key in ("doc_term_counts", "vocab_unigram", "vocab_trigram", "ngram_counts", "np_chunks"):
        plan = catalog.QUERIES[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("regexp_extract_all(lower") <= 1, key


def _plain_tokens(t):
    import re

    return re.findall(r"\w+", (t or "").lower())


CHUNK_TEXTS = [(1, "The big old dog saw a cat"), (2, None), (3, ""), (4, "big"), (5, "the the dog"), (6, "dog cat dog"), (7, "?! ..."), (None, "a dog"),
               (8, "big big dog the")]
TAGS = [("the", "DT"), ("a", "DT"), ("big", "JJ"), ("old", "JJ"), ("saw", "VB"), ("dog", "NN")]


def test_chunk_words_equal_a_plain_scan(spark):
    import re

    df = spark.createDataFrame(CHUNK_TEXTS, "comment_id long, commentText string")
    lex = spark.createDataFrame(TAGS, "token string, tag string")
    want = []
    for key, t in CHUNK_TEXTS:
        toks = _plain_tokens(t)
        tags = [dict(TAGS).get(w, "NN") for w in toks]
        line, place = "", {}
        for i, g in enumerate(tags):
            place[len(line)] = i
            line += f"<{g}>"
        place[len(line)] = len(tags)
        for no, m in enumerate(re.finditer(text.NP_TAG_PATTERN, line)):
            a, b = place[m.start()], place[m.end()]
            want.append((key, no, a, toks[a:b], tags[a:b], " ".join(f"{w}/{g}" for w, g in zip(toks[a:b], tags[a:b]))))
    got = [tuple(r) for r in text.np_chunk_words(df, lex).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and (1, 0, 0, ["the", "big", "old", "dog"], ["DT", "JJ", "JJ", "NN"],
                                                              "the/DT big/JJ old/JJ dog/NN") in got
    # The chunk shapes are those of the tag strings alone.
    shapes = sorted((r.comment_id or 0, r.chunk_no, r.chunk) for r in text.np_chunks(df, lex).collect())
    assert shapes == sorted((k or 0, no, "".join(f"<{g}>" for g in tags)) for k, no, _, _, tags, _ in want)
    assert text.np_chunk_words(df.limit(0), lex).count() == 0


def test_chunk_words_shuffle_nothing(spark):
    df = spark.createDataFrame(CHUNK_TEXTS, "comment_id long, commentText string")
    plan = text.np_chunk_words(df, spark.createDataFrame(TAGS, "token string, tag string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def _plain_collocations(texts, stops, n, threshold):
    import collections
    import math

    uni, bi = collections.Counter(), collections.Counter()
    for t in texts:
        toks = _plain_tokens(t)
        uni.update(w for w in toks if w not in stops)
        bi.update((a, b) for a, b in zip(toks, toks[1:]) if a not in stops and b not in stops)
    total = sum(uni.values())

    def wlog(k, n, x):
        return math.log(max(x, 1e-10)) * k + math.log(max(1 - x, 1e-10)) * (n - k)

    left = collections.Counter(uni)
    out = []
    for (a, b), c in bi.items():
        c1, c2 = uni[a], uni[b]
        if total <= c1 or total <= c2:
            continue
        p, p1, p2 = c2 / total, c / c1, (c2 - c) / (total - c1)
        score = -2 * (wlog(c, c1, p) + wlog(c2 - c, total - c1, p) - wlog(c, c1, p1) - wlog(c2 - c, total - c1, p2))
        if score > threshold:
            left[a] -= c
            left[b] -= c
            out.append((f"{a} {b}", True, c))
    out += [(w, False, c) for w, c in left.items() if c > 0]
    return sorted(out, key=lambda x: (-x[2], x[0]))[:n]


def test_collocations_equal_plain_loops(spark):
    import random

    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["new york", "the", "red", "car", "ice cream", "new", "york", "Of", "x x"]) for _ in range(rnd.randrange(0, 30)))
             for _ in range(80)] + [None, "", "the of", "x x x x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "comment_id long, commentText string")
    for threshold, n in ((30.0, 200), (0.5, 200), (1e9, 5)):
        got = [(r.term, r.is_pair, r["count"]) for r in text.top_collocations(df, ["the", "OF"], n, threshold).collect()]
        assert got == _plain_collocations(texts, {"the", "of"}, n, threshold)
    pairs = {r.term for r in text.top_collocations(df, ["the", "OF"]).filter("is_pair").collect()}
    assert "new york" in pairs and "ice cream" in pairs and "red car" not in pairs
    one = spark.createDataFrame([(1, "a a a")], "comment_id long, commentText string")
    assert [tuple(r) for r in text.top_collocations(one, []).collect()] == [("a", False, 3, None)]
    assert text.top_collocations(df.limit(0), ["the"]).count() == 0


def test_vocabulary_ids_vectors_and_dot_products(spark):
    import collections

    rows = [(1, "b a b"), (2, None), (3, "é a z"), (4, ""), (5, "Zz 😀 b"), (None, "a"), (6, "unknown")]
    df = spark.createDataFrame(rows, "comment_id long, commentText string").repartition(4)
    ids = text.vocabulary_ids(df)
    want = {w: i for i, w in enumerate(sorted({w for _, t in rows for w in _plain_tokens(t)}, key=str.encode))}
    assert {r.gram: r.id for r in ids.collect()} == want
    assert [r.id for r in text.vocabulary_ids(df, 2).orderBy("gram").collect()] == list(range(text.vocabulary(df, 2).count()))
    small = ids.filter("gram <> 'unknown'")
    v = text.document_vectors(df, small)
    got = {r.comment_id: (r.ids, r.counts) for r in v.collect()}
    assert len(got) == len(rows) and got[2] == got[4] == got[6] == ([], [])
    assert got[1] == ([want["a"], want["b"]], [1, 2]) and got[None] == ([want["a"]], [1])
    dense = {k: collections.Counter(_plain_tokens(t)) for k, t in rows}
    dots = {(r.comment_id, r.other_id): r.dot for r in text.dot_products(v, v.filter("comment_id in (1, 3)")).collect()}
    brute = {(a, b): sum(n * dense[b][w] for w, n in dense[a].items() if w != "unknown") for a in dense for b in (1, 3)}
    assert dots == {k: x for k, x in brute.items() if x}
    assert text.document_vectors(df.limit(0), small).count() == text.vocabulary_ids(df.limit(0)).count() == 0
