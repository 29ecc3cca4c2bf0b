"""Per-video rank features (#17, #18, #25, #34-#38, #65).

The reference ranks comments inside each video three times (sentiment
bucket, subjectivity, cluster label; each descending), pivots each ranking
to one column per rank, keeps ranks 21-38, 40, 41 and drops videos with
fewer than 41 comments, then joins the three tables and the videos.

Here the three measures are one long table (comment_id, videoID, measure,
value). One window over (videoID, measure) keeps rank <= 41, planned as
WindowGroupLimit, which also trims each group inside every map task
before the shuffle, so a very hot video ships at most 41 rows per task.
One pivot with an explicit column list then builds all 60 columns in a
single aggregation with partial (map-side) pivoting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.scalar import nullif_blank, views_bucket
from murmur.operators.rank import rank_within, sorted_places, top_n_within
from murmur.schemas import (
    CATEGORY_ID, CLUSTERS, COMMENT_ID, DEFAULT_RANKS, REQUIRED_RANK, SENTIMENT_BUCKET,
    SUBJECTIVITY, VIDEO_ID, VIEWS, VIEWS_BUCKET,
)

# Measure name -> source column; order of the feature blocks in the table.
MEASURES = (("cluster", CLUSTERS), ("subjectivity", SUBJECTIVITY), ("sentiment", SENTIMENT_BUCKET))


def to_measures(scored: DataFrame, measures=MEASURES, key: str = COMMENT_ID,
                video: str = VIDEO_ID) -> DataFrame:
    """Reshape per-comment measures to (comment_id, videoID, measure, value)."""
    parts = ", ".join(f"'{name}', cast(`{col}` as double)" for name, col in measures)
    return scored.select(F.col(key), F.col(video),
                         F.expr(f"stack({len(measures)}, {parts}) as (measure, value)"))


def rank_measure(df: DataFrame, value: str, video: str = VIDEO_ID, tie: str = COMMENT_ID,
                 col: str = "rn") -> DataFrame:
    """Row number from 1 per video, ``value`` descending, ties by comment id.

    Exact for every row, and safe when one video is very large (see
    ``murmur.operators.rank``)."""
    return rank_within(df, [video], value, tie, descending=True, col=col)


def sort_mixed(df: DataFrame, asc_col: str = VIDEO_ID, desc_col: str = "value", ties=(COMMENT_ID,)) -> DataFrame:
    """Global sort: first column ascending, second descending, then ``ties``
    (range-partitioned; the ties let equal pairs be split over tasks)."""
    return df.orderBy(F.col(asc_col).asc(), F.col(desc_col).desc(), *ties)


def sort_positions(df: DataFrame, asc_col: str = VIDEO_ID, desc_col: str = "value", ties=(COMMENT_ID,),
                   col: str = "position") -> DataFrame:
    """The order of ``sort_mixed`` as a column, from 1."""
    s = sorted_places(df, [F.col(asc_col).asc(), F.col(desc_col).desc(), *[F.col(t) for t in ties]])
    # One row per partition of the sort.
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c")).select("_pid", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    return s.join(before, "_pid").select((F.col("_off") + F.col("_li") + 1).alias(col), *df.columns)


def feature_columns(measure_names: Sequence[str], ranks: Sequence[int] = DEFAULT_RANKS) -> list[str]:
    return [f"{m}_{r}" for m in measure_names for r in ranks]


def rank_pivot(measures: DataFrame, measure_names: Sequence[str] = tuple(m for m, _ in MEASURES),
               ranks: Sequence[int] = DEFAULT_RANKS, video: str = VIDEO_ID,
               tie: str = COMMENT_ID) -> DataFrame:
    """One row per video, one column ``<measure>_<rank>`` per kept rank.

    Videos shorter than a rank get NULL in that column."""
    max_rank = max(ranks)
    top = top_n_within(measures, [video, "measure"], "value", tie, max_rank)
    keep = top.filter(F.col("rn").isin(list(ranks)))
    cols = feature_columns(measure_names, ranks)
    keyed = keep.select(F.col(video), F.concat_ws("_", F.col("measure"), F.col("rn").cast("string")).alias("_c"),
                        F.col("value"))
    return keyed.groupBy(video).pivot("_c", cols).agg(F.first("value"))


def drop_short(pivot: DataFrame, required_cols: Sequence[str]) -> DataFrame:
    """Blank -> missing, then drop rows missing any of ``required_cols``
    (keeps the videos that reach the required rank)."""
    for c in required_cols:
        if c not in pivot.columns:
            raise KeyError(c)
    blank = [nullif_blank(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
             for f in pivot.schema.fields]
    return pivot.select(*blank).dropna(subset=list(required_cols))


def video_features(measures: DataFrame, measure_names=tuple(m for m, _ in MEASURES),
                   ranks=DEFAULT_RANKS, required_rank: int = REQUIRED_RANK) -> DataFrame:
    """Rank pivot of all measures, only videos that reach ``required_rank``."""
    piv = rank_pivot(measures, measure_names, ranks)
    return drop_short(piv, [f"{m}_{required_rank}" for m in measure_names])


def distinct_videos(df: DataFrame, cols=(VIDEO_ID, VIEWS, CATEGORY_ID)) -> DataFrame:
    """Distinct (videoID, views, categoryID): a video seen with several view
    counts keeps several rows."""
    return df.select(*cols).distinct()


def feature_join(videos: DataFrame, features: DataFrame, video: str = VIDEO_ID) -> DataFrame:
    """Distinct videos joined to their rank features (inner, on video id)."""
    return distinct_videos(videos).join(features, video, "inner")


def training_table(videos: DataFrame, features: DataFrame, threshold_log2: int = 20,
                   keep_all: bool = False, keep_unlabelled: bool = False) -> DataFrame:
    """categoryID, rank features and the views label per video.

    By default a video's largest view count is used (one row per video);
    ``keep_all=True`` keeps every distinct view count as the reference
    does. Rows whose views sit exactly on 2^threshold get no label and are
    dropped unless ``keep_unlabelled``.
    """
    v = distinct_videos(videos)
    if not keep_all:
        v = v.groupBy(VIDEO_ID, CATEGORY_ID).agg(F.max(VIEWS).alias(VIEWS))
    t = v.join(features, VIDEO_ID, "inner").withColumn(VIEWS_BUCKET, views_bucket(F.col(VIEWS), threshold_log2))
    t = t.drop(VIEWS)
    if not keep_unlabelled:
        t = t.filter(F.col(VIEWS_BUCKET).isNotNull())
    fcols = [c for c in features.columns if c != VIDEO_ID]
    return t.select(VIDEO_ID, CATEGORY_ID, *fcols, VIEWS_BUCKET)


def unlabelled(videos: DataFrame, features: DataFrame, threshold_log2: int = 20) -> DataFrame:
    """How many rows ``training_table`` keeps, and drops for want of a label."""
    t = training_table(videos, features, threshold_log2, keep_unlabelled=True)
    missing = F.col(VIEWS_BUCKET).isNull()
    return t.agg(F.count_if(~missing).alias("n_kept"), F.count_if(missing).alias("n_dropped"))
