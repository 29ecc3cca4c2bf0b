"""Schemas, default column names and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column names (the reference names its four feature columns at run time;
# here they are parameters with these defaults).
# ---------------------------------------------------------------------------
COMMENT_ID = "comment_id"
VIDEO_ID = "videoID"
CATEGORY_ID = "categoryID"
VIEWS = "views"
TEXT = "commentText"
CHANNEL = "channel"
POLARITY = "polarity"
SUBJECTIVITY = "subjectivity"
SENTIMENT_BUCKET = "sentimentBucket"
CLUSTERS = "clusters"
VIEWS_BUCKET = "viewsBucket"

# ---------------------------------------------------------------------------
# Fixed values. These must stay exactly as written for results to match.
# ---------------------------------------------------------------------------

# Spellings that pandas' CSV reader turns into a missing value by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Rank columns kept from each per-video rank pivot: ranks 21 to 38, 40, 41
# (rank 39 is skipped by the original column slice).
DEFAULT_RANKS = tuple(list(range(21, 39)) + [40, 41])

# The rank a video must reach to be kept ("at least 41 comments").
REQUIRED_RANK = 41

# Two-level views label: log2(views) < 20 -> '1', > 20 -> '2', exactly 20 -> missing.
VIEWS_LOG2_THRESHOLD = 20

# Four-level views label edges on log2(views): <=18, (18,20], (20,22], >22.
VIEWS_LOG2_EDGES4 = (18, 20, 22)

# Punctuation strings removed before counting token document frequency.
PUNCTUATION = ("-?", "!", ",", ":", ";", "()", "''", ".", "``", "|", "^",
               "..", "...", "--", "=")

# Extra words dropped from the top-words table of a cluster.
TOP_WORDS_EXTRA_STOPWORDS = ("dtype", "commentText", "object", "video", "Name")

# Noun-phrase chunk grammar over tag strings: optional DT, any JJ, then NN.
NP_TAG_PATTERN = r"(?:<DT>)?(?:<JJ>)*<NN>"

# Default part-of-speech tag for a token missing from the tag lexicon.
DEFAULT_TAG = "NN"

# ---------------------------------------------------------------------------
# Spark schemas
# ---------------------------------------------------------------------------
COMMENTS_SCHEMA = T.StructType([
    T.StructField(COMMENT_ID, T.LongType(), False),
    T.StructField(VIDEO_ID, T.StringType(), True),
    T.StructField(CATEGORY_ID, T.IntegerType(), True),
    T.StructField(VIEWS, T.LongType(), True),
    T.StructField(TEXT, T.StringType(), True),
])

TITLES_SCHEMA = T.StructType([
    T.StructField(VIDEO_ID, T.StringType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField(CHANNEL, T.StringType(), True),
    T.StructField("commentCount", T.LongType(), True),
])

CATEGORIES_SCHEMA = T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType(), True),
        T.StructField("snippet", T.StructType([
            T.StructField("title", T.StringType(), True),
        ]), True),
    ])), True),
])

LEXICON_SCHEMA = T.StructType([
    T.StructField("word", T.StringType(), False),
    T.StructField(POLARITY, T.DoubleType(), False),
    T.StructField(SUBJECTIVITY, T.DoubleType(), False),
])

TAG_LEXICON_SCHEMA = T.StructType([
    T.StructField("token", T.StringType(), False),
    T.StructField("tag", T.StringType(), False),
])
