"""Structured Streaming use of the batch operators.

The reference only reads files whole; nothing in it is a stream. Scoring
is stateless per row, so the same ``score_sentiment`` plan applies
unchanged to a streaming DataFrame of comments, and the per-(channel,
bucket) summary becomes a streaming aggregation whose state is one row
per group. Checkpoints go under the shared checkpoint folder so a
restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from murmur.operators.prepare import join_titles
from murmur.operators.sentiment import score_sentiment
from murmur.schemas import CHANNEL, POLARITY, SENTIMENT_BUCKET, SUBJECTIVITY, TEXT
from murmur.session import scratch_path


def score_stream(comments: DataFrame, lexicon: DataFrame, text: str = TEXT) -> DataFrame:
    """Streaming comments -> scored comments (stateless, no shuffle)."""
    return score_sentiment(comments, lexicon, text)


def channel_sentiment_stream(comments: DataFrame, titles: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Running comment count and score sums per (channel, sentiment bucket).

    Stream-static join with the titles, then an aggregation whose state is
    one row per group; sums (not averages) keep the state mergeable."""
    scored = score_stream(comments, lexicon)
    return (join_titles(scored, titles)
            .groupBy(CHANNEL, SENTIMENT_BUCKET)
            .agg(F.count(F.lit(1)).alias("n_comments"),
                 F.sum(POLARITY).alias("sum_polarity"),
                 F.sum(SUBJECTIVITY).alias("sum_subjectivity")))


def start(df: DataFrame, sink: str, name: str, output_mode: str = "update",
          checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Start a query into ``sink`` ('memory' or a path for Parquet) with its
    checkpoint in the shared folder; ``available_now`` processes what is
    there and stops."""
    spark: SparkSession = df.sparkSession
    ckpt = checkpoint or scratch_path(spark, f"stream-{name}")
    w = df.writeStream.outputMode(output_mode).option("checkpointLocation", ckpt)
    if available_now:
        w = w.trigger(availableNow=True)
    if sink == "memory":
        return w.format("memory").queryName(name).start()
    return w.format("parquet").option("path", sink).start()
