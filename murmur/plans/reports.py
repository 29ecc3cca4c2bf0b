"""Report jobs (#74-#78): the reference's console flows as job functions.

Each returns a dict of DataFrames. Values that reach the driver are
bounded by parameters (k centres, 10 elbow rows, fold scores), never by
the data size. The selected-cluster table, which the reference writes to
CSV and re-reads six times, is cut once into the shared checkpoint folder
and shared by the downstream results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators import cluster, evaluate, features, model, prepare, similarity, stats, text
from murmur.operators.sentiment import score_sentiment
from murmur.schemas import (
    CATEGORY_ID, CHANNEL, COMMENT_ID, TEXT, TOP_WORDS_EXTRA_STOPWORDS, VIDEO_ID,
)
from murmur.session import cut_lineage
from murmur.sources import fixtures as fx
from murmur.sources import io


def tables_from_fixtures(spark: SparkSession, sf_dir: str) -> dict:
    """The inputs of the report jobs, built from the driver tables."""
    return {
        "comments": fx.fx_comments(spark, sf_dir),
        "titles": fx.fx_titles(spark, sf_dir),
        "categories": io.category_dim(io.read_categories(spark, fx.write_category_json(spark, sf_dir))),
        "lexicon": fx.fx_lexicon(spark),
        "stopwords": fx.stopword_list(),
        "tag_lexicon": fx.fx_tag_lexicon(spark),
    }


def _selection(tables: dict, channel: str, cap: int | None, seed) -> DataFrame:
    """comments x categories x titles, one channel, capped sample, distinct.

    The channel filter is written last, as in the reference; Catalyst
    pushes it below both joins onto the titles scan."""
    c = prepare.join_categories(tables["comments"], tables["categories"])
    j = prepare.filter_equals(prepare.join_titles(c, tables["titles"]), CHANNEL, channel)
    s = j if cap is None else prepare.sample_n(j, cap, COMMENT_ID, seed)
    data_cols = [x for x in s.columns if x != COMMENT_ID]
    # distinct over the data columns; the smallest id names each kept row
    return s.groupBy(*data_cols).agg(F.min(COMMENT_ID).alias(COMMENT_ID))


def _scored_selection(tables, channel, sentiment, cap, seed):
    sel = _selection(tables, channel, cap, seed)
    scored = score_sentiment(sel, tables["lexicon"])
    return prepare.filter_sentiment(scored, sentiment)


def channel_cluster_report(tables: dict, channel: str, sentiment, k: int, cluster_id: int,
                           cap: int | None = None, seed=0, starts: int = 10, slice_=(400, 50),
                           n_similar: int = 10, embed_fn=None, dim: int = 64) -> dict:
    """Entry B: select, score, cluster, pick one cluster, then its trigram
    vocabulary, noun-phrase chunks, top words and embedding similarity."""
    scored = cut_lineage(_scored_selection(tables, channel, sentiment, cap, seed))
    centres, wcss = cluster.fit_kmeans(scored, k=k, starts=starts, seed=seed)
    labelled = cluster.assign(scored, centres)
    if not 0 <= cluster_id < k:
        raise ValueError(f"cluster must be in 0..{k - 1}")
    selected = cut_lineage(prepare.filter_equals(labelled, "clusters", cluster_id))
    trigrams = text.vocabulary(selected, 3)
    out = {
        "scored": labelled,
        "centres": scored.sparkSession.createDataFrame(
            [(i, float(x), float(y)) for i, (x, y) in enumerate(centres)],
            "clusters int, polarity double, subjectivity double"),
        "profile": cluster.cluster_profile(labelled),
        "selected": selected,
        "trigram_count": trigrams.agg(F.count(F.lit(1)).alias("n_trigrams")),
        "trigram_slice": text.sorted_slice(trigrams, "gram", slice_[0], slice_[1]),
        "chunks": text.chunk_counts(text.np_chunks(selected, tables["tag_lexicon"])),
        "top_words": text.top_words(selected, list(tables["stopwords"]) + list(TOP_WORDS_EXTRA_STOPWORDS)),
    }
    emb = similarity.embed(selected.select(COMMENT_ID, TEXT), embed_fn, dim)
    enough = selected.count() >= n_similar
    out["similarity"] = similarity.similarity_pairs(emb, n_similar, seed, key=COMMENT_ID) if enough else None
    return out


def report_rows(r: dict) -> DataFrame:
    """All parts of a cluster report in one long table (part, name, n, x, y).

    profile: label, comments, mean coordinates. centres: label, coordinates.
    trigram_count: n. trigram_slice: gram. chunks: chunk, times, x its tokens.
    top_words: word, times. similarity: places and keys, inner product and
    the value shown; no rows if the cluster has too few comments.
    """
    def part(name, df, key=None, n=None, x=None, y=None):
        def value(c, kind):
            return (F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c).cast(kind)
        return df.select(F.lit(name).alias("part"), value(key, "string").alias("name"), value(n, "long").alias("n"),
                         value(x, "double").alias("x"), value(y, "double").alias("y"))

    out = part("profile", r["profile"], "clusters", "n_comments", "avg_polarity", "avg_subjectivity")
    rest = [part("centres", r["centres"], "clusters", None, "polarity", "subjectivity"),
            part("trigram_count", r["trigram_count"], None, "n_trigrams"),
            part("trigram_slice", r["trigram_slice"], "gram"),
            part("chunks", r["chunks"], "chunk", "n", "n_tokens"),
            part("top_words", r["top_words"], "token", "count")]
    if r["similarity"] is not None:
        rest.append(part("similarity", r["similarity"], F.concat_ws(",", "i", "j", "key_i", "key_j"), None, "inner_product", "shown"))
    for df in rest:
        out = out.unionByName(df)
    return out


def channel_elbow_report(tables: dict, channel: str, sentiment, cap: int | None = None, seed=0,
                         ks=range(1, 11), starts: int = 10) -> dict:
    """Entry C: select and score as above, then WCSS for k = 1..10."""
    scored = cut_lineage(_scored_selection(tables, channel, sentiment, cap, seed))
    return {"selected": scored, "elbow": cluster.elbow(scored, ks=ks, starts=starts, seed=seed)}


def video_feature_job(tables: dict, k: int = 5, seed=0, starts: int = 10, out_path: str | None = None) -> DataFrame:
    """Join the titles (untitled videos drop out, a repeated title fans out),
    score every comment, cluster, rank the three measures per video and
    pivot to one feature row per video with at least 41 comments."""
    titled = prepare.join_titles(tables["comments"], tables["titles"].select(VIDEO_ID))
    scored = cut_lineage(score_sentiment(titled, tables["lexicon"]))
    centres, _ = cluster.fit_kmeans(scored, k=k, starts=starts, seed=seed)
    labelled = cluster.assign(scored, centres)
    feats = features.video_features(features.to_measures(labelled))
    if out_path:
        io.write_table(feats, out_path)
        return feats.sparkSession.read.parquet(out_path)
    return feats


def training_from_tables(tables: dict, feats: DataFrame) -> DataFrame:
    videos = tables["comments"].select(VIDEO_ID, "views", CATEGORY_ID)
    return features.training_table(videos, feats)


def views_model_report(table: DataFrame, operation: str, seed: int = 1, folds: int = 8) -> dict:
    """Entry A: split 60/20/20, fit centred PCA + logistic regression on the
    training rows, then cross validation or a validation / test report."""
    ops = ("cross validation", "validation set", "test set")
    if operation not in ops:
        raise ValueError(f"operation must be one of {ops}")
    t = cut_lineage(prepare.split_bucket(table, VIDEO_ID, seed))
    cols = model.feature_columns(t)
    train = t.filter(F.col("split") == "train").drop("split")
    m = model.fit_views_model(train, cols)
    out = {"model": m, "pca": model.pca_summary(m, train, cols),
           "train_accuracy": evaluate.accuracy(model.predictions(m, train))}
    if operation == "cross validation":
        out["cv"] = model.cross_validate(train, folds, cols)
        return out
    part = "validation" if operation == "validation set" else "test"
    preds = model.predictions(m, t.filter(F.col("split") == part))
    labels = model.label_names(m)
    out.update({"predictions": preds, "accuracy": evaluate.accuracy(preds),
                "confusion": evaluate.confusion_matrix(preds, labels),
                "report": evaluate.classification_report(preds, labels)})
    return out


def distribution_report(df: DataFrame, col: str, pairs=(("polarity", "subjectivity"),), bins: int = 70) -> dict:
    """describe of distinct values, kurtosis, Pearson r with p, histogram.

    Each of them passes over its columns several times, so these are stored
    first: what made them (scores of whole texts, joins) runs once."""
    df = cut_lineage(df.select(*dict.fromkeys([col, *(c for pair in pairs for c in pair)])))
    return {
        "describe": stats.describe_distinct(df, col),
        "kurtosis": stats.kurtosis_of(df, col),
        "pearson": stats.pearson(df, list(pairs), with_p=True),
        "histogram": stats.histogram(df, col, bins),
    }
