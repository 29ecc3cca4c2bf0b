"""Driver tables -> the comment-analytics shapes (see FIXTURES.md, part B).

Every fixture is a lazy DataFrame derived from the parquet tables, so the
work of every query grows with the data. Caller-supplied parameter tables
(lexicon, word lists, tag lexicon) are small literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.schemas import (
    CATEGORY_ID, CLUSTERS, COMMENT_ID, LEXICON_SCHEMA, PUNCTUATION, SENTIMENT_BUCKET,
    SUBJECTIVITY, TAG_LEXICON_SCHEMA, TEXT, VIDEO_ID, VIEWS,
)

# Fixture parameters (FIXTURES.md).
LANG_CATEGORY = (("en", 24), ("de", 22), ("fr", 10), ("es", 17))
VIEWS_PER_CHAR = 711
CHANNELS = 4
# Languages listed in the derived category file; 'es' is left out so that
# Spanish comments drop out of the category join.
CATEGORY_LANGS = ("de", "en", "fr")
FIXED_CENTRES = ((-0.2, 0.5), (0.0, 0.0), (0.1, 0.3))
LEXICON = (
    ("the", 0.1, 0.2), ("is", 0.35, 0.5), ("that", -0.3, 0.6), ("was", -0.45, 0.7),
    ("la", 0.25, 0.4), ("der", -0.2, 0.3), ("en", 0.15, 0.9), ("die", -0.6, 0.8),
    ("que", 0.5, 0.1), ("with", -0.05, 0.35),
)
# (phrase, polarity, subjectivity, intensity, negates)
PHRASE_LEXICON = (
    ("the", 0.1, 0.2, None, False), ("is", 0.35, 0.5, None, False), ("that", -0.3, 0.6, 1.5, False), ("of the", 0.4, 0.3, None, False),
    ("and the that", -0.9, 0.9, None, False), ("in the", 0.7, None, None, False), ("with", None, None, 1.3, False), ("on", None, None, 0.6, False),
    ("for", None, None, None, True), ("and", None, None, None, True), ("la", 0.25, 0.4, None, False), ("de", None, None, 2.0, False),
    ("de la", 0.85, 0.75, None, None), ("der", -0.2, 0.3, None, False), ("und", None, None, 1.2, True), ("und der", -0.65, 0.8, 1.1, False),
)
STOPWORDS = ("the", "of", "and", "to", "in", "a", "is", "it", "for", "on",
             "de", "la", "der", "und", "et")
TAG_LEXICON = (
    ("the", "DT"), ("a", "DT"), ("la", "DT"), ("der", "DT"), ("le", "DT"),
    ("that", "JJ"), ("this", "JJ"), ("en", "JJ"),
    ("is", "VBZ"), ("was", "VBZ"), ("are", "VBZ"),
    ("of", "IN"), ("in", "IN"), ("for", "IN"), ("on", "IN"), ("with", "IN"), ("de", "IN"),
    ("and", "CC"), ("und", "CC"), ("et", "CC"),
)
EVENT_BUCKET = (("purchase", 1), ("signup", 1), ("view", 0), ("click", -1), ("error", -1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lang_category(col):
    expr = None
    for lang, cid in LANG_CATEGORY:
        expr = F.when(col == lang, F.lit(cid)) if expr is None else expr.when(col == lang, F.lit(cid))
    return expr.otherwise(F.lit(-1)).cast("int")


def fx_comments(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``spread`` is for CPU-heavy text work over a source of few files."""
    from murmur.operators.common import spread_if_coarse

    d = table(spark, sf_dir, "documents")
    return (spread_if_coarse(d, key="doc_id") if spread else d).select(
        F.col("doc_id").alias(COMMENT_ID),
        F.col("source").alias(VIDEO_ID),
        _lang_category(F.col("lang")).alias(CATEGORY_ID),
        (F.col("n_chars") * VIEWS_PER_CHAR).cast("long").alias(VIEWS),
        F.col("text").alias(TEXT),
    )


def fx_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    num = F.regexp_extract(F.col("source"), r"(\d+)", 1).cast("int")
    return (d.groupBy("source").agg(F.count(F.lit(1)).alias("commentCount"))
            .select(F.col("source").alias(VIDEO_ID),
                    F.concat(F.lit("Video "), F.col("source")).alias("title"),
                    F.concat(F.lit("ch"), (num % CHANNELS).cast("string")).alias("channel"),
                    F.col("commentCount")))


def category_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One category JSON document derived from the comment languages:
    ``{"items": [{"id": "<code>", "snippet": {"title": "Category <lang> ..."}}]}``.
    The item list is bounded by the number of languages."""
    d = table(spark, sf_dir, "documents").filter(F.col("lang").isin(list(CATEGORY_LANGS)))
    per = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    item = F.struct(
        _lang_category(F.col("lang")).cast("string").alias("id"),
        F.struct(F.concat(F.lit("Category "), F.col("lang")).alias("title")).alias("snippet"),
    )
    return per.agg(F.sort_array(F.collect_list(F.struct(F.col("lang"), item.alias("item")))).alias("x")) \
        .select(F.transform("x", lambda e: e["item"]).alias("items"))


def write_category_json(spark: SparkSession, sf_dir: str) -> str:
    from murmur.session import scratch_path

    path = scratch_path(spark, "categories")
    category_items(spark, sf_dir).select(F.to_json(F.struct("items")).alias("value")) \
        .coalesce(1).write.mode("overwrite").text(path)
    return path


def fx_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON), LEXICON_SCHEMA)


def fx_phrase_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PHRASE_LEXICON), "phrase string, polarity double, subjectivity double, intensity double, negates boolean")


def stopword_list() -> list[str]:
    """Fixture stop words plus every character of the punctuation strings."""
    return sorted(set(STOPWORDS) | set("".join(PUNCTUATION)))


def fx_tag_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TAG_LEXICON), TAG_LEXICON_SCHEMA)


def fx_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmur.operators.sentiment import score_sentiment

    return score_sentiment(fx_comments(spark, sf_dir, spread=True), fx_lexicon(spark))


def fx_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmur.operators.cluster import assign

    return assign(fx_scored(spark, sf_dir), FIXED_CENTRES)


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.withColumn("cents", F.round(F.col("value") * 100).cast("long"))


def _event_bucket(col):
    expr = None
    for t, b in EVENT_BUCKET:
        expr = F.when(col == t, F.lit(b)) if expr is None else expr.when(col == t, F.lit(b))
    return expr.cast("int")


def fx_scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-event comment-like rows: id, video, bucket, subjectivity, cluster."""
    e = _events(spark, sf_dir)
    return e.select(
        F.col("event_id").alias(COMMENT_ID),
        F.col("user_id").cast("string").alias(VIDEO_ID),
        _event_bucket(F.col("event_type")).alias(SENTIMENT_BUCKET),
        ((F.col("cents") % 101).cast("double") / F.lit(100.0)).alias(SUBJECTIVITY),
        (F.col("event_id") % 5).cast("int").alias(CLUSTERS),
    )


def fx_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table (comment_id, videoID, measure, value)."""
    from murmur.operators.features import to_measures

    return to_measures(fx_scored_events(spark, sf_dir))


def fx_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return (e.groupBy("user_id")
            .agg(F.expr("(sum(cents) * 32) div 10").cast("long").alias(VIEWS))
            .select(F.col("user_id").cast("string").alias(VIDEO_ID),
                    F.col(VIEWS),
                    (F.col("user_id") % 8).cast("int").alias(CATEGORY_ID)))


def fx_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias(COMMENT_ID),
        F.col("l_partkey").cast("string").alias(VIDEO_ID),
        F.lit("quantity").alias("measure"),
        F.col("l_quantity").cast("double").alias("value"),
    )


def fx_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("quality").cast("string").alias("label"),
        F.when(F.col("n_chars") >= 1000, F.lit("1")).otherwise(F.lit("0")).alias("prediction"),
    )


def fx_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
