"""The training-text pipeline: five filtering and encoding stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept (an empty table gives an empty one), and returns a DataFrame; ``run`` writes it as Parquet into the shared
scratch folder and reads it back for the next one. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import stored, table
from murmur.llm.importance import keep_sampled
from murmur.llm.line_chunks import drop_repeated_chunks
from murmur.llm.minhash import drop_near_duplicates
from murmur.llm.pieces import encode_decode
from murmur.llm.queries import tokenizer_file
from murmur.llm.winnowing import drop_contaminated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling; documents that it does not draw, or that hold a passage it rejects, go.

    Null and empty texts have weight 0 and stay or go by it; repeated rows and
    ties of the sampling key share their fate; null ids draw noise from their
    text; without good labels all stay; long texts are counted in pieces.
    """
    return keep_sampled(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of two lines and more go, and documents that consisted of nothing else.

    n_chars, where present, counts the text that is left. Null, empty and
    one-line texts stay as they are; rows that repeat an id and a text are one
    document; null ids come first in the order; long texts are taken whole.
    """
    out = drop_repeated_chunks(docs)
    out = out.filter((F.col("removed_chunks") == 0) | F.col("text").rlike(r"[^\x09-\x0D\x20]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("removed_chunks") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, 0.8).

    Texts without words, and rows with a null id, link with nothing and stay;
    rows that repeat a kept id stay together; of a group the least id stays.
    """
    return drop_near_duplicates(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a ten-word window with a benchmark item go.

    Shorter items are one window; null texts and items have none; repeated
    rows share their fate; without items all stay.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, the text's SentencePiece ids (end id last) and what they decode to.

    A null text counts as empty: the end id alone, which decodes to nothing.
    Repeated rows and null ids are encoded each; long texts in pieces.
    """
    return encode_decode(docs, tokenizer_file("piece_bpe_32k.model"), end_id=2)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("near-dedup", near_dedup),
          ("decontamination", decontaminate), ("SentencePiece", pieces)]

#: Importance weights, MinHash and SentencePiece have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
