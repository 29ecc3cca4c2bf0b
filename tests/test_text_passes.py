"""How often text queries read their texts, and that their faster forms equal plain loops."""

import hashlib
import random
import re

import numpy as np

from murmur.functions.text import MARK_STEPS, PART_STEPS, tokens_parted
from murmur.operators import similarity, text
from murmur.operators.sentiment import score_phrases
from murmur.plans import reports
from murmur.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
TEXTS = ["a b a b c", "", None, "b", "A b  c d", "é a b", "x x x x"]


def _comments(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "comment_id long, commentText string")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _words(t):
    return re.findall(r"\w+", (t or "").lower())


def test_ngram_counts_make_one_row_per_word(spark, monkeypatch):
    df = _comments(spark, TEXTS)
    want = {n: len({tuple(w[i:i + n]) for w in map(_words, TEXTS) for i in range(len(w) - n + 1)}) for n in (1, 2, 3, 5)}
    got = text.ngram_counts(df, (3, 1, 5, 2))
    assert {r["n"]: r["n_distinct"] for r in got.collect()} == {n: c for n, c in want.items() if c}
    assert "transform(" not in _plan(got) and "xxhash64" in _plan(got)
    # Words with one hash are compared as themselves.
    monkeypatch.setattr(text, "_hashes_differ", lambda words, col: False)
    plain = text.ngram_counts(df)
    assert "xxhash64" not in _plan(plain) and {r["n"]: r["n_distinct"] for r in plain.collect()} == {n: want[n] for n in (1, 2, 3)}
    assert text.ngram_counts(df.limit(0)).count() == 0


def test_hashes_differ_counts_repeats(spark):
    words = spark.createDataFrame([("a",), ("b",)], "w string")
    assert text._hashes_differ(words, "w") and not text._hashes_differ(words.union(words), "w")


def test_collocations_read_the_texts_once(spark):
    out = text.top_collocations(_comments(spark, TEXTS), ["c"])
    assert "regexp_extract_all" not in _plan(out)
    assert ("x", False, 4) in [(r.term, r.is_pair, r["count"]) for r in out.collect()]


def test_distribution_report_scores_the_texts_once(spark):
    r = reports.distribution_report(fx.fx_scored(spark, SF), "polarity")
    assert all("regexp_extract_all" not in _plan(r[part]) for part in ("describe", "kurtosis", "histogram"))


def test_hashed_embedding_equals_plain_loops(spark):
    rnd = random.Random(5)
    texts = [*TEXTS, " ".join(rnd.choice("abcdefghijk") * rnd.randrange(1, 4) for _ in range(500))]
    out = similarity.embed(_comments(spark, texts), dim=7)
    assert _plan(out).count("aggregate(") == 1  # the norm; the tokens are not folded once per place
    for r in out.collect():
        v = np.zeros(7)
        for w in _words(texts[r["comment_id"]]):
            h = hashlib.md5(w.encode()).hexdigest()
            v[int(h[:8], 16) % 7] += 1 if int(h[8], 16) % 2 else -1
        norm = np.sqrt((v * v).sum())
        assert np.allclose(r["embedding"], v / norm if norm else v, atol=1e-6)


def test_fitted_vectors_deal_the_texts_out_once(spark):
    df = _comments(spark, TEXTS)
    e = similarity.encode_fitted(df, similarity.fit_term_weights(df), 8)
    v = text.document_vectors(df, text.vocabulary_ids(df))
    for out in (e, v):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"hashpartitioning\(comment_id", plan)) == 1
        assert out.count() == len(TEXTS)


def test_phrases_are_looked_for_where_they_begin(spark):
    lex = spark.createDataFrame([("a b", 0.5, 0.4, None, False), ("b", -0.2, 0.1, None, False), ("c", None, None, 2.0, True), ("x x x", 0.1, 0.2, None, False)],
                                "phrase string, polarity double, subjectivity double, intensity double, negates boolean")
    out = score_phrases(_comments(spark, TEXTS), lex)
    assert "sequence(" not in _plan(out)
    got = {r["comment_id"]: (r["polarity"], r["subjectivity"]) for r in out.collect()}
    assert got == {0: (0.5, 0.4), 1: (0.0, 0.0), 2: (0.0, 0.0), 3: (-0.2, 0.1), 4: (0.5, 0.4), 5: (0.5, 0.4), 6: (0.1, 0.2)}
    more = _comments(spark, ["c b", "c d b", "c c b", "a c b a b", "x x"])
    assert [r["polarity"] for r in score_phrases(more, lex).orderBy("comment_id").collect()] == [0.2, -0.2, 0.4, 0.35, 0.0]


def _parted(t):
    def rewritten(s, steps):
        for pattern, to in steps:
            s = re.sub(pattern, lambda m, to=to: re.sub(r"\\([12])", lambda g: m.group(int(g.group(1))), to), s)
        return s

    pieces = [p for p in re.split(r"[\t\n\x0B\f\r ]+", rewritten(t or "", MARK_STEPS)) if p]
    return [w for w in re.split(" +", rewritten(" " + "  ".join(pieces) + " ", PART_STEPS)) if w]


def test_parted_tokens_equal_the_listed_steps(spark):
    rnd = random.Random(3)
    bits = ["a", "1", ",", ":", ".", "...", "'", '"', " ", "\n", "--", "n't", "'s", "cannot", "Gonna", "d'ye", "'tis", "more'n", "$", "(", ")", "é", "\x01", "\x02", "'LL"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 14))) for _ in range(1500)] + [None, "", "1,2,3,4:5:6 \"cannot.\" x"]
    df = _comments(spark, texts)
    rows = df.select("comment_id", tokens_parted("commentText").alias("t")).collect()
    assert [r["t"] for r in sorted(rows)] == [_parted(t) for t in texts]
    counts = text.token_counts(df, parted=True)
    assert "lambda" not in _plan(counts)
    got = sorted((r["comment_id"], r["token"], r["count"]) for r in counts.collect())
    want = sorted((i, w, c.count(w)) for i, c in ((i, _parted(t)) for i, t in enumerate(texts)) for w in set(c))
    assert got == want
