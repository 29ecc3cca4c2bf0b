"""Treebank-style tokens, ranks by counting, phrase scoring and the fitted encoder, each against plain loops."""

import hashlib
import math
import random
import re

import pytest
from murmur import functions as MF
from murmur.operators import sentiment, similarity, stats, text
from pyspark.sql import functions as F

PARTED = {
    "Don't do that.": ["Do", "n't", "do", "that", "."],
    "It's the dog's, isn't it?": ["It", "'s", "the", "dog", "'s", ",", "is", "n't", "it", "?"],
    "I cannot, CAN'T won't": ["I", "can", "not", ",", "CA", "N'T", "wo", "n't"],
    "They'll we've you're I'm he'd": ["They", "'ll", "we", "'ve", "you", "'re", "I", "'m", "he", "'d"],
    'She said "hi there" (twice).': ["She", "said", "``", "hi", "there", "''", "(", "twice", ")", "."],
    '"Start" and "end"': ["``", "Start", "''", "and", "``", "end", "''"],
    "In 3,141 or 1,2,3 at 10:30, ok: yes": ["In", "3,141", "or", "1,2,3", "at", "10:30", ",", "ok", ":", "yes"],
    "The U.S. army. Wait... what -- no!": ["The", "U.S.", "army", ".", "Wait", "...", "what", "--", "no", "!"],
    "gonna gotta lemme gimme wanna 'tis 'twas d'ye more'n": ["gon", "na", "got", "ta", "lem", "me", "gim", "me", "wan", "na", "'t", "is", "'t",
                                                             "was", "d", "'ye", "more", "'n"],
    "the boys' toys and 'quoted' words": ["the", "boys", "'", "toys", "and", "'quoted", "'", "words"],
    "a;b@c #tag $5 50% x&y [z] {q} <w>": ["a", ";", "b", "@", "c", "#", "tag", "$", "5", "50", "%", "x", "&", "y", "[", "z", "]", "{", "q", "}",
                                          "<", "w", ">"],
    "end.'": ["end", ".", "'"], "don't don't": ["do", "n't", "do", "n't"], "é’s naïve\t\n 中文.": ["é’s", "naïve", "中文", "."],
    "": [], " \t ": [], None: [], "$1 \\1": ["$", "1", "\\1"],
}


def test_parted_tokens(spark):
    rows = [(i, t) for i, t in enumerate(PARTED)]
    df = spark.createDataFrame(rows, "comment_id long, commentText string")
    got = {r.comment_id: r.t for r in df.select("comment_id", MF.tokens_parted("commentText").alias("t")).collect()}
    for i, t in rows:
        assert got[i] == PARTED[t], t
    counts = {(r.comment_id, r.token): r["count"] for r in text.token_counts(df, parted=True).collect()}
    assert counts[([t for t in PARTED].index("don't don't"), "n't")] == 2
    # without parting the tokens are as before
    assert {r.token for r in text.token_counts(df.filter("comment_id = 0")).collect()} == {"Don", "'t", "do", "that", "."}


@pytest.mark.parametrize("kind", ["even", "heavy", "repeated", "special", "few", "none"])
def test_values_at_ranks_without_sorting(spark, kind):
    rnd = random.Random(kind)
    values = {
        "even": [rnd.uniform(-1, 1) for _ in range(4000)],
        "heavy": [rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300) for _ in range(4000)],
        "repeated": [float(rnd.choice([1, 1, 1, 2, 3])) for _ in range(4000)] + [0.5, 2.5],
        "special": [rnd.gauss(0, 1) for _ in range(1000)] + [math.inf] * 3 + [-math.inf] * 2 + [math.nan] * 4 + [0.0, -0.0, None, None],
        "few": [3.0, 1.0], "none": [None],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    kept = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    ranks = sorted({0, 1, len(kept) // 4, len(kept) // 3, len(kept) // 2, max(0, len(kept) - 1), len(kept) + 5, *(rnd.randrange(len(kept) + 1) for _ in range(4))})
    for held in (10_000, 20, 1):
        got = stats.values_at(df, "x", ranks, held)
        assert set(got) == {r for r in ranks if r < len(kept)}
        assert all(got[r] == kept[r] or (math.isnan(got[r]) and math.isnan(kept[r])) for r in got)
    plan = stats.describe_distinct(df, "x")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


LEXICON = [("good", 0.8, 0.6, None, False), ("very", None, None, 1.3, False), ("not", None, None, None, True), ("bad", -0.7, 0.9, None, False),
           ("not bad", 0.3, 0.4, None, False), ("really", 0.2, 0.3, 1.5, False), ("so so bad", -0.95, 1.0, None, False), ("so", None, None, 2.0, None),
           ("plain", 0.0, None, None, False)]


def plain_score(t, lexicon):
    lex = {r[0]: r[1:] for r in lexicon}
    toks = re.findall(r"\w+", (t or "").lower())
    i, x, neg, ps, ss, n = 0, 1.0, False, 0, 0, 0

    def rounded(y):
        return int(math.copysign(math.floor(abs(y) + 0.5), y)) if y else 0

    while i < len(toks):
        for size in range(max(len(p.split()) for p in lex), 0, -1):
            phrase = " ".join(toks[i:i + size])
            if i + size <= len(toks) and phrase in lex:
                break
        else:
            i, x, neg = i + 1, 1.0, False
            continue
        p, s, strength, negates = lex[phrase]
        if p is None:
            x, neg = x * (strength or 1.0), neg or bool(negates)
        else:
            ps += rounded(max(-1000.0, min(1000.0, round(p * 1000) * x * (-0.5 if neg else 1.0))))
            ss += rounded(max(0.0, min(1000.0, round((s or 0) * 1000) * x)))
            n, x, neg = n + 1, strength or 1.0, False
        i += size

    def mean(total):
        return round(math.copysign(math.floor(abs(total / n) / 10 + 0.5) / 100, total), 2) + 0.0 if n else 0.0

    return mean(ps), mean(ss)


def test_phrases_negation_and_strength(spark):
    lex = spark.createDataFrame(LEXICON, "phrase string, polarity double, subjectivity double, intensity double, negates boolean")
    rnd = random.Random(1)
    texts = ["good", "very good", "not good", "not very good", "very not good", "not bad", "so so bad", "so so so bad", "not x good", "really good",
             "very very very very good", "not not bad", "plain not", "", None, "?!", "Not Bad, GOOD"]
    texts += [" ".join(rnd.choice(["good", "very", "not", "bad", "really", "so", "x", "plain"]) for _ in range(rnd.randrange(1, 25))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "comment_id long, commentText string, polarity int")
    got = {r.comment_id: r for r in sentiment.score_phrases(df, lex).collect()}
    for i, t in enumerate(texts):
        assert (got[i].polarity, got[i].subjectivity) == plain_score(t, LEXICON), t
        assert got[i].sentimentBucket == (got[i].polarity > 0) - (got[i].polarity < 0)
    assert got[2].polarity == -0.4 and got[1].polarity == 1.0 and got[5].polarity == 0.3 and got[8].polarity == 0.8
    assert sentiment.score_phrases(df.limit(0), lex).count() == 0
    empty = sentiment.score_phrases(df, lex.limit(0)).collect()
    assert {(r.polarity, r.subjectivity) for r in empty} == {(0.0, 0.0)}
    plan = sentiment.score_phrases(df, lex)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_single_words_score_as_the_plain_lexicon(spark):
    rows = [("good", 0.8, 0.6), ("bad", -0.7, 0.9), ("la", 0.25, 0.4)]
    plain = spark.createDataFrame(rows, "word string, polarity double, subjectivity double")
    lex = spark.createDataFrame([(*r, None, False) for r in rows], "phrase string, polarity double, subjectivity double, intensity double, negates boolean")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["good bad", "la la good x", None, "none"])], "comment_id long, commentText string")
    assert sorted(map(tuple, sentiment.score_phrases(df, lex).collect())) == sorted(map(tuple, sentiment.score_sentiment(df, plain).collect()))


def test_fitted_encoder(spark):
    texts = {1: "red dog red", 2: "dog", 3: None, 4: "", 5: "blue cat dog", 6: "cat"}
    df = spark.createDataFrame(list(texts.items()), "comment_id long, commentText string").repartition(3)
    weights = similarity.fit_term_weights(df)
    toks = {k: re.findall(r"\w+", t or "") for k, t in texts.items()}
    want = {w: math.log(7 / (sum(w in x for x in toks.values()) + 1)) + 1 for w in {w for x in toks.values() for w in x}}
    got = {r.token: r.weight for r in weights.collect()}
    assert got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1e-12 for w in want)
    out = {r.comment_id: r.embedding for r in similarity.encode_fitted(df, weights, 8).collect()}
    for k, ws in toks.items():
        v = [0.0] * 8
        for w in ws:
            h = hashlib.md5(w.encode()).hexdigest()
            v[int(h[:8], 16) % 8] += want[w] * (1 if int(h[8], 16) % 2 else -1)
        norm = math.sqrt(sum(x * x for x in v))
        assert len(out[k]) == 8 and all(abs(a - (b / norm if norm else 0)) < 1e-9 for a, b in zip(out[k], v))
    few = {r.comment_id: r.embedding for r in similarity.encode_fitted(df, weights.filter("token = 'dog'"), 8).collect()}
    assert sum(x * x for x in few[6]) == 0 and abs(sum(x * x for x in few[2]) - 1) < 1e-9
    assert similarity.encode_fitted(df.limit(0), weights).count() == 0 and similarity.fit_term_weights(df.filter(F.lit(False))).count() == 0
