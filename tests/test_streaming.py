from pyspark.sql import functions as F

from murmur.plans import catalog
from murmur.sources import fixtures as fx
from murmur.streaming import scoring

SF = "/root/testdata/sf0.001"


def test_streaming_summary_equals_batch(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stream = (spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1)
              .option("pathGlobFilter", "documents.parquet").parquet(SF))
    comments = stream.select(F.col("doc_id").alias("comment_id"), F.col("source").alias("videoID"),
                             F.col("text").alias("commentText"))
    agg = scoring.channel_sentiment_stream(comments, fx.fx_titles(spark, SF), fx.fx_lexicon(spark))
    q = scoring.start(agg, "memory", "murmur_stream_test", output_mode="complete")
    q.awaitTermination(120)
    got = {(r["channel"], r["sentimentBucket"]): r["n_comments"]
           for r in spark.sql("select * from murmur_stream_test").collect()}
    batch = {(r["channel"], r["sentimentBucket"]): r["n_comments"]
             for r in catalog.QUERIES["entry_summary"](spark, SF).collect()}
    assert got == batch
