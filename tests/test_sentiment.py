import pytest

from murmur.operators.sentiment import score_sentiment
from murmur.sources import fixtures as fx


def _comments(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "comment_id long, commentText string")


def test_unscorable_is_zero(spark):
    out = score_sentiment(_comments(spark, [None, "", "zzz"]), fx.fx_lexicon(spark)).collect()
    for r in out:
        assert (r["polarity"], r["subjectivity"], r["sentimentBucket"]) == (0.0, 0.0, 0)


def test_mean_over_matched_tokens(spark):
    # 'the' (.1,.2) twice and 'was' (-.45,.7): mean p = -0.25/3 = -0.0833 -> -0.08
    out = score_sentiment(_comments(spark, ["The cat WAS the"]), fx.fx_lexicon(spark)).first()
    assert out["polarity"] == -0.08
    assert out["subjectivity"] == 0.37  # (0.2+0.2+0.7)/3 = 0.3667
    assert out["sentimentBucket"] == -1


def test_large_lexicons_score_alike(spark):
    texts = ["w0 w7 w2999 nothing", "w1 w1 w1 W2", None, "zzz"]
    for n in (8, 3000, 20_000):
        lex = spark.createDataFrame([(f"w{i}", ((i % 21) - 10) / 10, (i % 11) / 10) for i in range(n)],
                                    "word string, polarity double, subjectivity double")
        want = []
        for t in texts:
            hits = [int(w[1:]) for w in (t or "").lower().split() if w[1:].isdigit() and int(w[1:]) < n]
            p = [((i % 21) - 10) * 100 for i in hits]
            mean = sum(p) / len(p) if p else 0
            want.append((1 if mean > 0 else -1) * int(abs(mean) / 10 + 0.5) / 100 if p else 0.0)
        rows = score_sentiment(_comments(spark, texts), lex).orderBy("comment_id").collect()
        assert [r["polarity"] for r in rows] == want


def test_repeated_ids_and_words(spark):
    df = spark.createDataFrame([(1, "is"), (1, "the")], "comment_id long, commentText string")
    got = sorted(r["polarity"] for r in score_sentiment(df, fx.fx_lexicon(spark)).collect())
    assert got == [0.1, 0.35]  # each row on its own
    lex = fx.fx_lexicon(spark)
    with pytest.raises(ValueError):
        score_sentiment(df, lex.unionByName(lex))
    with pytest.raises(ValueError):
        score_sentiment(df, lex, max_words=3)
    empty = score_sentiment(df, lex.limit(0)).collect()
    assert [r["polarity"] for r in empty] == [0.0, 0.0]


def test_no_python_udf_in_scoring_plan(spark):
    df = score_sentiment(_comments(spark, ["the is"]), fx.fx_lexicon(spark))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "Exchange" not in plan  # scoring is a narrow projection


def test_regex_runs_once_under_score_filters(spark):
    from murmur.plans import catalog

    for key in ("filter_cluster", "filter_sentiment", "top_words"):
        df = catalog.QUERIES[key](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        # scoring tokenises once; top_words tokenises the selected rows once more
        limit = 2 if key == "top_words" else 1
        assert plan.count("regexp_extract_all") <= limit, key
