import re

import __spark_entry__ as E
from murmur.plans import catalog
from murmur.sources import fixtures as fx

SURVEY_KEYS = """read_comments_csv read_titles_csv category_dim csv_roundtrip model_roundtrip project_features
category_cast filter_channel filter_sentiment filter_cluster sentiment_bucket log2_views views_bucket views_bucket4
drop_short_videos quote_text join_category join_titles feature_join remove_stopwords dedupe_comments distinct_videos
capped_sample split_rows stratified_folds rank_sentiment rank_subjectivity rank_cluster rank_pivot sort_mixed
ngram_slice channel_counts describe_distinct kurtosis pearson_r histogram70 kmeans_assign kmeans_sentiment wcss_k1
kmeans_elbow cluster_profile tokenize_lower vocab_unigram vocab_bigram vocab_trigram ngram_counts doc_term_counts
token_counts token_doc_freq top_words sentiment_scores np_chunks tag_tokens embedding_similarity embed_hook
training_table pca_scores pca_variance2 lr_predictions cross_validation accuracy confusion_matrix
classification_report channel_cluster_report channel_elbow_report video_features views_model_report
distribution_report""".split()


def test_every_survey_key_registered():
    assert not set(SURVEY_KEYS) - set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"channel", "sentimentBucket", "n_comments", "avg_polarity",
                                        "avg_subjectivity"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_category_join_broadcast(spark):
    plan = _plan(catalog.QUERIES["join_category"](spark, "/root/testdata/sf0.001"))
    assert "BroadcastHashJoin" in plan


def test_channel_filter_pushed_to_titles(spark):
    df = catalog.QUERIES["filter_channel"](spark, "/root/testdata/sf0.001")
    opt = df._jdf.queryExecution().optimizedPlan().toString()
    # the channel predicate sits below the join, on the titles side
    join_at = opt.find("Join Inner")
    assert join_at >= 0 and opt.find("channel", join_at) > join_at


def test_scan_prunes_columns(spark):
    df = catalog.QUERIES["channel_counts"](spark, "/root/testdata/sf0.001")
    plan = _plan(df)
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert "text" not in schema and "n_chars" not in schema


def test_no_row_python_udf_on_main_paths(spark):
    for key in ("entry_summary", "sentiment_scores", "rank_pivot", "ngram_counts", "np_chunks", "top_words"):
        plan = _plan(catalog.QUERIES[key](spark, "/root/testdata/sf0.001"))
        assert "BatchEvalPython" not in plan, key
