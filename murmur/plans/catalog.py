"""Registered queries: key -> callable(spark, sf_dir) -> DataFrame.

Each runs over the whole driver tables (through the fixtures) and aliases
every computed column to the name used by the matching SQL in
``murmur.plans.oracle``. Float results are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur import functions as MF
from murmur.operators import cluster, evaluate, features, model, prepare, similarity, stats, text
from murmur.operators.sentiment import score_phrases, sentiment_summary
from murmur.schemas import COMMENTS_SCHEMA, TITLES_SCHEMA, TOP_WORDS_EXTRA_STOPWORDS
from murmur.session import scratch_path
from murmur.sources import fixtures as fx
from murmur.sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CHANNEL = "ch1"
SENTIMENT = 1
CLUSTER = 2
SEED = 0
SPLIT_SEED = 1
SAMPLE = 100
K_VIDEO = 5


def register(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


# --------------------------------------------------------------- flagship
@register("entry_summary")
def entry_summary(spark, d):
    """Comments and mean scores per (channel, sentiment bucket)."""
    scored = fx.fx_scored(spark, d)
    joined = prepare.join_titles(scored, fx.fx_titles(spark, d))
    return sentiment_summary(joined, ["channel", "sentimentBucket"])


# ------------------------------------------------------ sources and sinks
@register("read_comments_csv")
def read_comments_csv(spark, d):
    path = scratch_path(spark, "comments-csv")
    io.write_table(fx.fx_comments(spark, d), path, fmt="csv")
    return io.read_table_csv(spark, path, COMMENTS_SCHEMA)


@register("read_titles_csv")
def read_titles_csv(spark, d):
    path = scratch_path(spark, "titles-csv")
    io.write_table(fx.fx_titles(spark, d), path, fmt="csv")
    return io.read_table_csv(spark, path, TITLES_SCHEMA)


def _categories(spark, d):
    return io.category_dim(io.read_categories(spark, fx.write_category_json(spark, d)))


@register("category_dim")
def category_dim(spark, d):
    return _categories(spark, d)


@register("csv_roundtrip")
def csv_roundtrip(spark, d):
    from pyspark.sql import types as T

    cols = ["comment_id", "videoID", "polarity", "subjectivity", "sentimentBucket"]
    schema = T.StructType([T.StructField("comment_id", T.LongType()), T.StructField("videoID", T.StringType()),
                           T.StructField("polarity", T.DoubleType()), T.StructField("subjectivity", T.DoubleType()),
                           T.StructField("sentimentBucket", T.IntegerType())])
    path = scratch_path(spark, "scored-csv")
    io.write_table(fx.fx_scored(spark, d).select(*cols), path, fmt="csv")
    return io.read_table_csv(spark, path, schema)


# ------------------------------------------- projections and derived cols
@register("project_features")
def project_features(spark, d):
    return prepare.project(fx.fx_comments(spark, d), ["comment_id", "videoID", "categoryID", "views"])


@register("category_cast")
def category_cast(spark, d):
    raw = io.read_categories(spark, fx.write_category_json(spark, d))
    flat = raw.select(F.posexplode("items").alias("pos", "item")).select(
        "pos", F.col("item.id").alias("categoryID"), F.col("item.snippet.title").alias("category"))
    return prepare.cast_category_id(flat)


@register("filter_channel")
def filter_channel(spark, d):
    j = prepare.join_titles(fx.fx_comments(spark, d), fx.fx_titles(spark, d))
    return prepare.filter_equals(j, "channel", CHANNEL).select("comment_id", "videoID", "channel", "title")


@register("filter_sentiment")
def filter_sentiment(spark, d):
    return prepare.filter_sentiment(fx.fx_scored(spark, d), SENTIMENT).select("comment_id", "polarity",
                                                                               "sentimentBucket")


@register("filter_cluster")
def filter_cluster(spark, d):
    return prepare.filter_equals(fx.fx_clustered(spark, d), "clusters", CLUSTER).select(
        "comment_id", "polarity", "subjectivity", "clusters")


@register("sentiment_bucket")
def sentiment_bucket(spark, d):
    return fx.fx_scored(spark, d).select("comment_id", "polarity", "sentimentBucket")


@register("log2_views")
def log2_views(spark, d):
    c = fx.fx_comments(spark, d)
    return c.select("comment_id", "views", F.round(MF.log2_or_neg_inf("views"), 6).alias("log2_views"))


@register("views_bucket")
def views_bucket(spark, d):
    c = fx.fx_comments(spark, d)
    return c.select("comment_id", "views", MF.views_bucket("views").alias("viewsBucket"))


@register("views_bucket4")
def views_bucket4(spark, d):
    c = fx.fx_comments(spark, d)
    return c.select("comment_id", "views", MF.views_bucket4("views").alias("viewsBucket4"))


@register("drop_short_videos")
def drop_short_videos(spark, d):
    piv = features.rank_pivot(fx.fx_short(spark, d), ["quantity"])
    return features.drop_short(piv, ["quantity_41"])


@register("quote_text")
def quote_text(spark, d):
    return fx.fx_comments(spark, d).select("comment_id", MF.quote("commentText").alias("quoted"))


# ------------------------------------------------------------------ joins
@register("join_category")
def join_category(spark, d):
    j = prepare.join_categories(fx.fx_comments(spark, d), _categories(spark, d))
    return j.select("comment_id", "categoryID", "category")


@register("join_titles")
def join_titles(spark, d):
    j = prepare.join_titles(fx.fx_comments(spark, d), fx.fx_titles(spark, d))
    return j.select("comment_id", "videoID", "title", "channel", "commentCount")


@register("feature_join")
def feature_join(spark, d):
    feats = features.video_features(fx.fx_measures(spark, d))
    return features.feature_join(fx.fx_videos(spark, d), feats)


@register("remove_stopwords")
def remove_stopwords(spark, d):
    toks = text.token_table(fx.fx_comments(spark, d, spread=True))
    return text.remove_words(toks, fx.stopword_list())


# ------------------------------------------------ distinct, sample, split
@register("dedupe_comments")
def dedupe_comments(spark, d):
    j = prepare.join_titles(fx.fx_comments(spark, d), fx.fx_titles(spark, d))
    return prepare.dedupe(j, ["videoID", "categoryID", "commentText", "channel"])


@register("distinct_videos")
def distinct_videos(spark, d):
    return features.distinct_videos(fx.fx_comments(spark, d))


@register("capped_sample")
def capped_sample(spark, d):
    j = prepare.filter_equals(prepare.join_titles(fx.fx_comments(spark, d), fx.fx_titles(spark, d)),
                              "channel", CHANNEL)
    return prepare.sample_n(j, SAMPLE, "comment_id", SEED).select("comment_id", "videoID")


@register("first_rows")
def first_rows(spark, d):
    """The first 100 comments by id (#40)."""
    return prepare.first_n(fx.fx_comments(spark, d), 100).select("comment_id", "videoID")


@register("split_rows")
def split_rows(spark, d):
    return prepare.split_bucket(fx.fx_videos(spark, d), "videoID", SPLIT_SEED).select("videoID", "split")


def _labelled_videos(spark, d):
    v = fx.fx_videos(spark, d)
    return v.withColumn("viewsBucket", MF.views_bucket("views")).filter(F.col("viewsBucket").isNotNull())


@register("stratified_folds")
def stratified_folds(spark, d):
    return prepare.stratified_folds(_labelled_videos(spark, d), "viewsBucket", "videoID", 8).select(
        "videoID", "viewsBucket", "fold")


# --------------------------------------------------- window, pivot, sort
def _ranked(spark, d, col):
    ev = fx.fx_scored_events(spark, d)
    return features.rank_measure(ev, col).select("comment_id", "videoID", col, "rn")


@register("rank_sentiment")
def rank_sentiment(spark, d):
    return _ranked(spark, d, "sentimentBucket")


@register("rank_subjectivity")
def rank_subjectivity(spark, d):
    return _ranked(spark, d, "subjectivity")


@register("rank_cluster")
def rank_cluster(spark, d):
    return _ranked(spark, d, "clusters")


@register("rank_pivot")
def rank_pivot(spark, d):
    return features.rank_pivot(fx.fx_measures(spark, d))


@register("sort_mixed")
def sort_mixed(spark, d):
    m = fx.fx_measures(spark, d)
    return features.sort_positions(m, "videoID", "value", ("comment_id", "measure")).select(
        "position", "comment_id", "videoID", "measure", "value")


@register("ngram_slice")
def ngram_slice(spark, d):
    return text.sorted_slice(text.vocabulary(fx.fx_comments(spark, d, spread=True), 3), "gram", 400, 50)


# ------------------------------------------------------------- statistics
@register("channel_counts")
def channel_counts(spark, d):
    j = prepare.join_titles(fx.fx_comments(spark, d), fx.fx_titles(spark, d))
    return prepare.count_by(j, "channel")


@register("describe_distinct")
def describe_distinct(spark, d):
    return stats.describe_distinct(fx.table(spark, d, "events"), "value")


@register("kurtosis")
def kurtosis(spark, d):
    return stats.kurtosis_of(fx.table(spark, d, "events"), "value")


@register("pearson_r")
def pearson_r(spark, d):
    return stats.pearson(fx.fx_scored(spark, d), [("polarity", "subjectivity")], with_p=False)


@register("pearson_p")
def pearson_p(spark, d):
    """Correlations of three pairs with their two-sided p-values."""
    scored = fx.fx_scored(spark, d)
    out = stats.pearson(scored, [("polarity", "subjectivity"), ("views", "subjectivity"), ("polarity", "comment_id")], with_p=True)
    return out.select("x", "y", "r", "n", F.round("p_value", 6).alias("p_value"))


@register("histogram70")
def histogram70(spark, d):
    return stats.histogram(fx.table(spark, d, "events"), "value", 70)


# ------------------------------------------------------------- clustering
@register("kmeans_assign")
def kmeans_assign(spark, d):
    return fx.fx_clustered(spark, d).select("comment_id", "polarity", "subjectivity", "clusters")


@register("kmeans_sentiment")
def kmeans_sentiment(spark, d):
    scored = fx.fx_scored(spark, d)
    centres, _ = cluster.fit_kmeans(scored, k=3, starts=10, seed=SEED)
    return cluster.assign(scored, centres).select("comment_id", "polarity", "subjectivity", "clusters")


@register("kmeans_seeds")
def kmeans_seeds(spark, d):
    """The k-means++ draws of ten starts, and the cost of the centres drawn so far."""
    points = cluster.prepared_points(fx.fx_scored(spark, d))
    rows = [(start, place, c[0] / 100, c[1] / 100, w / 10_000) for start, (centres, costs) in enumerate(cluster.seed_centres(points, 10, 10, SEED))
            for place, (c, w) in enumerate(zip(centres, costs))]
    return spark.createDataFrame(rows, "start int, place int, polarity double, subjectivity double, cost double")


@register("wcss_k1")
def wcss_k1(spark, d):
    w = cluster.wcss_k1(fx.fx_scored(spark, d))
    return w.select(MF.round_half_away("wcss", 6).alias("wcss"))


@register("kmeans_elbow")
def kmeans_elbow(spark, d):
    e = cluster.elbow(fx.fx_scored(spark, d), ks=range(1, 11), starts=10, seed=SEED)
    return e.withColumn("wcss", MF.round_half_away("wcss", 9))


@register("cluster_profile")
def cluster_profile(spark, d):
    return cluster.cluster_profile(fx.fx_clustered(spark, d))


# ------------------------------------------------------------------- text
@register("tokenize_lower")
def tokenize_lower(spark, d):
    return text.token_table(fx.fx_comments(spark, d, spread=True))


@register("vocab_unigram")
def vocab_unigram(spark, d):
    return text.vocabulary(fx.fx_comments(spark, d, spread=True), 1)


@register("vocab_bigram")
def vocab_bigram(spark, d):
    return text.vocabulary(fx.fx_comments(spark, d, spread=True), 2)


@register("vocab_trigram")
def vocab_trigram(spark, d):
    return text.vocabulary(fx.fx_comments(spark, d, spread=True), 3)


@register("ngram_counts")
def ngram_counts(spark, d):
    return text.ngram_counts(fx.fx_comments(spark, d, spread=True), (1, 2, 3))


@register("doc_term_counts")
def doc_term_counts(spark, d):
    return text.doc_term_counts(fx.fx_comments(spark, d, spread=True), 1)


@register("token_counts")
def token_counts(spark, d):
    return text.token_counts(fx.fx_comments(spark, d, spread=True))


@register("token_doc_freq")
def token_doc_freq(spark, d):
    return text.token_doc_freq(fx.fx_comments(spark, d, spread=True), fx.stopword_list(), limit=None)


@register("top_words")
def top_words(spark, d):
    sel = prepare.filter_equals(fx.fx_clustered(spark, d), "clusters", CLUSTER)
    return text.top_words(sel, fx.stopword_list() + list(TOP_WORDS_EXTRA_STOPWORDS), 200)


@register("sentiment_scores")
def sentiment_scores(spark, d):
    return fx.fx_scored(spark, d).select("comment_id", "videoID", "polarity", "subjectivity",
                                          "sentimentBucket")


@register("np_chunks")
def np_chunks(spark, d):
    return text.chunk_counts(text.np_chunks(fx.fx_comments(spark, d, spread=True), fx.fx_tag_lexicon(spark)))


@register("parted_token_counts")
def parted_token_counts(spark, d):
    """Counts of treebank-style tokens per comment, contractions and quotes split."""
    return text.token_counts(_with_contractions(fx.fx_comments(spark, d, spread=True)), parted=True)


def _with_contractions(comments):
    """Comments whose words take apostrophe endings, marks and quotes by a rule on neighbouring letters: the tables hold hardly any."""
    c = F.col("commentText")
    for pattern, to in CONTRACTED:
        c = F.replace(c, F.lit(pattern), F.lit(to))  # fixed strings
    return comments.withColumn("commentText", c)


#: Stand-in spellings for the given prose: (pattern, replacement), valid in Java regex and RE2.
CONTRACTED = (("on ", "on't "), ("re ", "re's "), ("th the", "\"th the\""), ("and ", "cannot "), (" in ", " in... "), (" that ", " 3,141:59 'that' "))


@register("phrase_scores")
def phrase_scores(spark, d):
    """Comments scored by a lexicon of phrases, negations and intensities."""
    out = score_phrases(fx.fx_comments(spark, d, spread=True), fx.fx_phrase_lexicon(spark))
    return out.select("comment_id", "polarity", "subjectivity", "sentimentBucket")


@register("fitted_embeddings")
def fitted_embeddings(spark, d):
    """Every value of the corpus-fitted embedding of every comment."""
    comments = fx.fx_comments(spark, d, spread=True)
    e = similarity.encode_fitted(fx.fx_comments(spark, d), similarity.fit_term_weights(comments), 64)
    return e.select("comment_id", F.posexplode("embedding").alias("place", "v")).withColumn("v", F.round("v", 5))


@register("np_chunk_words")
def np_chunk_words(spark, d):
    """Every noun-phrase chunk with the words it holds."""
    out = text.np_chunk_words(fx.fx_comments(spark, d, spread=True), fx.fx_tag_lexicon(spark))
    return out.select("comment_id", "chunk_no", "start", F.array_join("words", " ").alias("words"), F.array_join("tags", " ").alias("tags"), "tagged")


@register("top_collocations")
def top_collocations(spark, d):
    """The chosen cluster's words and word pairs, pairs joined by likelihood ratio."""
    sel = prepare.filter_equals(fx.fx_clustered(spark, d), "clusters", CLUSTER)
    out = text.top_collocations(sel, fx.stopword_list() + list(TOP_WORDS_EXTRA_STOPWORDS), 200)
    return out.withColumn("score", MF.round_half_away("score", 3))


@register("vocab_ids")
def vocab_ids(spark, d):
    """Column numbers of the words."""
    return text.vocabulary_ids(fx.fx_comments(spark, d, spread=True), 1)


@register("bigram_ids")
def bigram_ids(spark, d):
    """Column numbers of the word pairs."""
    return text.vocabulary_ids(fx.fx_comments(spark, d, spread=True), 2)


@register("doc_vectors")
def doc_vectors(spark, d):
    """The sparse vector of every comment, as text."""
    comments = fx.fx_comments(spark, d, spread=True)
    v = text.document_vectors(fx.fx_comments(spark, d), text.vocabulary_ids(comments, 1))
    cells = F.zip_with("ids", "counts", lambda i, c: F.concat_ws(":", i.cast("string"), c.cast("string")))
    return v.select("comment_id", F.size("ids").alias("n_columns"), F.array_join(cells, " ").alias("vector"))


@register("vector_dots")
def vector_dots(spark, d):
    """Dot products of every comment's word vector with those of ten sampled comments."""
    comments = fx.fx_comments(spark, d, spread=True)
    vocab = text.vocabulary_ids(comments, 1)
    plain = fx.fx_comments(spark, d)  # dealt out by document_vectors
    chosen = prepare.sample_n(plain.select("comment_id"), 10, "comment_id", SEED)
    few = plain.join(F.broadcast(chosen), "comment_id", "left_semi")
    return text.dot_products(text.document_vectors(plain, vocab), text.document_vectors(few, vocab))


@register("tag_tokens")
def tag_tokens(spark, d):
    return text.tag_tokens(fx.fx_comments(spark, d, spread=True), fx.fx_tag_lexicon(spark))


# -------------------------------------------------------------- embedding
@register("embedding_similarity")
def embedding_similarity(spark, d):
    return similarity.similarity_pairs(fx.fx_embeddings(spark, d), 10, SEED)


@register("embed_hook")
def embed_hook(spark, d):
    e = similarity.embed(fx.fx_comments(spark, d, spread=True).select("comment_id", "commentText"), dim=64)
    return e.select("comment_id", F.size("embedding").alias("dim"),
                    F.round(similarity.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm2"))


# ------------------------------------------------------------------ model
def _training(spark, d):
    return features.training_table(fx.fx_videos(spark, d), features.video_features(fx.fx_measures(spark, d)))


@register("training_table")
def training_table(spark, d):
    return _training(spark, d)


@register("unlabelled_videos")
def unlabelled_videos(spark, d):
    """Training rows kept, and dropped for want of a label."""
    return features.unlabelled(fx.fx_videos(spark, d), features.video_features(fx.fx_measures(spark, d)))


def _fitted(spark, d):
    from murmur.session import cut_lineage

    t = cut_lineage(prepare.split_bucket(_training(spark, d), "videoID", SPLIT_SEED))
    train = t.filter(F.col("split") == "train")
    cols = model.feature_columns(t)
    return t, train, cols, model.fit_views_model(train, cols)


@register("pca_scores")
def pca_scores(spark, d):
    t, _, _, m = _fitted(spark, d)
    return model.pca_scores(m, t)


@register("pca_summary")
def pca_summary(spark, d):
    """Variance ratio and singular value of the components fitted on the training videos."""
    _, train, cols, m = _fitted(spark, d)
    return model.pca_summary(m, train, cols)


@register("pca_variance2")
def pca_variance2(spark, d):
    return model.pca_variance2(fx.fx_scored(spark, d), "polarity", "subjectivity")


@register("lr_predictions")
def lr_predictions(spark, d):
    t, _, _, m = _fitted(spark, d)
    return model.predictions(m, t.filter(F.col("split") == "test"))


@register("model_roundtrip")
def model_roundtrip(spark, d):
    t, _, _, m = _fitted(spark, d)
    path = scratch_path(spark, "views-model")
    io.save_model(m, path)
    return model.predictions(io.load_model(path), t.filter(F.col("split") == "test"))


@register("cross_validation")
def cross_validation(spark, d):
    t, train, cols, _ = _fitted(spark, d)
    return model.cross_validate(train.drop("split"), 8, cols)


@register("accuracy")
def accuracy(spark, d):
    return evaluate.accuracy(fx.fx_predictions(spark, d))


@register("confusion_matrix")
def confusion_matrix(spark, d):
    return evaluate.confusion_matrix(fx.fx_predictions(spark, d), ["0", "1"])


@register("classification_report")
def classification_report(spark, d):
    return evaluate.classification_report(fx.fx_predictions(spark, d), ["0", "1"])


# ---------------------------------------------------------------- reports
@register("channel_cluster_report")
def channel_cluster_report(spark, d):
    from murmur.plans import reports

    return reports.report_rows(reports.channel_cluster_report(reports.tables_from_fixtures(spark, d), CHANNEL, SENTIMENT, 2, 0))


@register("channel_elbow_report")
def channel_elbow_report(spark, d):
    from murmur.plans import reports

    e = reports.channel_elbow_report(reports.tables_from_fixtures(spark, d), CHANNEL, SENTIMENT)["elbow"]
    return e.withColumn("wcss", MF.round_half_away("wcss", 9))


@register("video_features")
def video_features(spark, d):
    from murmur.plans import reports

    return reports.video_feature_job(reports.tables_from_fixtures(spark, d), k=K_VIDEO)


@register("views_model_report")
def views_model_report(spark, d):
    from murmur.plans import reports

    return reports.views_model_report(_training(spark, d), "test set")["report"]


@register("distribution_report")
def distribution_report(spark, d):
    """All four results in one long table: describe, kurtosis and histogram
    of commentCount over the titled comments, Pearson of the two scores."""
    from murmur.plans import reports

    j = prepare.join_titles(fx.fx_scored(spark, d), fx.fx_titles(spark, d))
    r = reports.distribution_report(j, "commentCount")
    none = F.lit(None).cast("double")

    def long(df, part, cols):
        one = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols]))
        return df.select(F.lit(part).alias("part"), one.alias("x")).select("part", "x.name", "x.value", none.alias("hi"))

    hist = r["histogram"].select(F.lit("histogram").alias("part"), F.col("bin").cast("string").alias("name"),
                                 F.col("count").cast("double").alias("value"), F.col("bin_hi").alias("hi"))
    return (long(r["describe"], "describe", ["count", "mean", "std", "min", "q25", "q50", "q75", "max"])
            .unionByName(long(r["kurtosis"], "kurtosis", ["n", "kurtosis"]))
            .unionByName(long(r["pearson"], "pearson", ["r", "n", "t"])).unionByName(hist))


# --------------------------------------- invariants of fitted results
# Fits depend on seeds and iteration order, so the fitted numbers have no
# SQL; what must hold of them does, and is counted here over all rows.
@register("kmeans_check")
def kmeans_check(spark, d):
    """n comments and ids, labels that are nearest, centres that are means."""
    scored = fx.fx_scored(spark, d)
    centres, _ = cluster.fit_kmeans(scored, k=3, starts=10, seed=SEED)
    lab = cluster.assign(scored, centres)
    cx, cy = (F.array(*[F.lit(c[i]) for c in centres]) for i in (0, 1))
    dist = F.zip_with(cx, cy, lambda x, y: (F.col("polarity") - x) * (F.col("polarity") - x)
                      + (F.col("subjectivity") - y) * (F.col("subjectivity") - y))
    near = F.element_at(dist, F.col("clusters") + 1) <= F.array_min(dist)
    means = lab.groupBy("clusters").agg(F.avg("polarity").alias("mx"), F.avg("subjectivity").alias("my"))
    off = F.greatest(F.abs(F.col("mx") - F.element_at(cx, F.col("clusters") + 1)), F.abs(F.col("my") - F.element_at(cy, F.col("clusters") + 1)))
    counted = lab.agg(F.count("*").alias("n"), F.countDistinct("comment_id").alias("n_ids"), F.count_if(near).alias("n_nearest"))
    return counted.crossJoin(means.agg(F.count_if(off < 1e-6).alias("n_centres_mean")))  # one row each


@register("elbow_check")
def elbow_check(spark, d):
    """k, whether the cost does not rise with k, and the exact cost at k = 1."""
    from pyspark.sql import Window

    scored = fx.fx_scored(spark, d)
    e = cluster.elbow(scored, ks=range(1, 11), starts=10, seed=SEED)
    before = F.lag("wcss").over(Window.orderBy("k"))  # ten rows
    one = cluster.wcss_k1(scored).select(F.col("wcss").alias("exact"))
    return e.withColumn("falls", F.coalesce(F.col("wcss") <= before + 1e-9, F.lit(True))).crossJoin(one).select(
        "k", "falls", F.when(F.col("k") == 1, F.abs(F.col("wcss") - F.col("exact")) < 1e-6).otherwise(F.lit(True)).alias("exact_k1"),
        MF.round_half_away("exact", 6).alias("wcss_k1"))


@register("video_features_exact")
def video_features_exact(spark, d):
    """The feature job's columns that no k-means enters."""
    from murmur.plans import reports

    out = reports.video_feature_job(reports.tables_from_fixtures(spark, d), k=2, starts=1)
    return out.select(*[c for c in out.columns if not c.startswith("cluster_")])


@register("model_roundtrip_check")
def model_roundtrip_check(spark, d):
    """Test rows, and those whose prediction a saved and loaded model repeats."""
    t, _, _, m = _fitted(spark, d)
    path = scratch_path(spark, "views-model")
    io.save_model(m, path)
    test = t.filter(F.col("split") == "test")
    a = model.predictions(m, test).select("videoID", F.col("prediction").alias("a"))
    b = model.predictions(io.load_model(path), test).select("videoID", F.col("prediction").alias("b"))
    return a.join(b, "videoID").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("n_equal"))


@register("cross_validation_folds")
def cross_validation_folds(spark, d):
    """Rows per fold, and whether each fold's accuracy is a share."""
    t, train, cols, _ = _fitted(spark, d)
    cv = model.cross_validate(train.drop("split"), 8, cols)
    return cv.select("fold", "n", F.col("accuracy").between(0.0, 1.0).alias("is_share"))


@register("pca_check")
def pca_check(spark, d):
    """Rows, and whether each loading is a unit eigenvector of the training covariance."""
    import numpy as np
    from pyspark.ml.stat import Correlation, Summarizer

    t, train, _, m = _fitted(spark, d)
    raw = m.transform(train)
    sd = raw.select(Summarizer.std(F.col("_raw")).alias("s")).first()["s"].toArray()
    c = np.nan_to_num(Correlation.corr(raw, "_raw").first()[0].toArray()) * np.outer(sd, sd)
    pc = m.stages[3].pc.toArray()
    good = [bool(np.abs(c @ v - (v @ c @ v) * v).max() < 1e-6 * max(1.0, np.abs(c).max())) and abs(float(v @ v) - 1) < 1e-9 for v in pc.T]
    n = model.pca_scores(m, t).agg(F.count("*").alias("n"))
    return n.select("n", F.lit(good[0]).alias("pc1_eigen"), F.lit(good[1]).alias("pc2_eigen"))


@register("lr_check")
def lr_check(spark, d):
    """Test rows, and whether the fitted regression's gradient is zero on the training rows."""
    from pyspark.ml.functions import vector_to_array

    t, train, _, m = _fitted(spark, d)
    lr = m.stages[4]
    w, b = lr.coefficients.toArray(), lr.intercept
    rows = m.transform(train).select("label", vector_to_array("pca").alias("x"))
    z = sum((F.col("x")[i] * float(v) for i, v in enumerate(w)), F.lit(float(b)))
    err = rows.withColumn("e", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - F.col("label"))
    grads = [F.abs(F.avg(F.col("e") * F.col("x")[i]) + F.lit(float(v)) * F.lit(lr.getRegParam())) for i, v in enumerate(w)]
    flat = err.agg(F.greatest(*grads, F.abs(F.avg("e"))).alias("g"))
    n = model.predictions(m, t.filter(F.col("split") == "test")).agg(F.count("*").alias("n"))
    return n.crossJoin(flat).select("n", (F.col("g") < 1e-4).alias("gradient_zero"))


@register("views_model_operations")
def views_model_operations(spark, d):
    """All three operations of the views report: rows per class, and per fold."""
    from murmur.plans import reports

    t = _training(spark, d)
    parts = []
    for op in ("validation set", "test set"):
        rep = reports.views_model_report(t, op)["report"].filter(F.col("class").isin("1", "2"))
        parts.append(rep.select(F.lit(op).alias("operation"), F.col("class").alias("name"), F.col("support").alias("n")))
    cv = reports.views_model_report(t, "cross validation")["cv"]
    parts.append(cv.select(F.lit("cross validation").alias("operation"), F.col("fold").cast("string").alias("name"), "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("channel_report_counts")
def channel_report_counts(spark, d):
    """Both channel reports: selected comments, the profile's total, and the parts' sizes that SQL knows."""
    from murmur.plans import reports

    tables = reports.tables_from_fixtures(spark, d)
    r = reports.channel_cluster_report(tables, CHANNEL, SENTIMENT, 2, 0, starts=2)
    e = reports.channel_elbow_report(tables, CHANNEL, SENTIMENT, ks=range(1, 4), starts=2)
    sizes = [("scored", r["scored"].agg(F.count("*").alias("n"))), ("profile", r["profile"].agg(F.sum("n_comments").alias("n"))),
             ("centres", r["centres"].agg(F.count("*").alias("n"))), ("elbow", e["elbow"].agg(F.count("*").alias("n"))),
             ("elbow_selected", e["selected"].agg(F.count("*").alias("n"))),
             ("similarity", r["similarity"].agg(F.count("*").alias("n")) if r["similarity"] is not None else spark.range(1).select(F.lit(0).cast("long").alias("n"))),
             ("slice", r["trigram_slice"].agg(F.count("*").alias("n"))), ("top_words", r["top_words"].agg(F.count("*").alias("n")))]
    out = None
    for name, df in sizes[:5]:
        one = df.select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    # The sizes of the chosen cluster's parts depend on the fit: each is held against a recount of the
    # selected rows, and gives the bound that SQL knows only if it is equal.
    selected, bound = r["selected"], {"similarity": 45, "slice": 50, "top_words": 200}
    words = text.remove_words(text.token_table(selected), [w.lower() for w in [*tables["stopwords"], *TOP_WORDS_EXTRA_STOPWORDS]])
    trigrams = text.doc_term_counts(selected, 3).select("gram").distinct().count()
    want = {"similarity": 45 if selected.count() >= 10 else 0, "slice": min(50, max(0, trigrams - 400)),
            "top_words": min(200, words.select("token").distinct().count())}
    for name, df in sizes[5:]:
        out = out.unionByName(df.select(F.lit(name).alias("part"), F.when(F.col("n") == want[name], F.lit(bound[name])).cast("long").alias("n")))
    return out
