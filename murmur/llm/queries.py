"""The registered queries opN_<name>: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmur.llm import aho_resample, line_chunks, minhash, winnowing
from murmur.llm.common import table
from murmur.llm.compression import quality_rules
from murmur.llm.histogram_sort import shard_digest
from murmur.llm.importance import importance_sample
from murmur.llm.language import identify
from murmur.llm.minhash import near_duplicates
from murmur.llm.periodic_runs import run_digest
from murmur.llm.pieces import piece_digest
from murmur.llm.syncmers import syncmer_digest
from murmur.llm.token_counts import count_tokens
from murmur.llm.token_files import token_digest


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a Gumbel top-k sample by importance weight keeps."""
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text in bit-packed files; per document what the files hold."""
    return token_digest(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2,
                        vocabulary_size=50_257)


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and benchmark items that every text shares ten-word windows with."""
    return winnowing.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the chunks of lines that an earlier one has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_chunks.drop_repeated_chunks(docs)


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, compression ratios and verdict of every text, by bands learned from the labels."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every text, learned outside the held-out fold."""
    return identify(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 80 % of their two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return shard_digest(table(spark, sf_dir, "documents"), shards=24)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text and the text they decode to, as digests."""
    return piece_digest(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), end_id=2)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text and whether they exceed 1024."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=1024)


def op11_dictionary_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, resampled towards the benchmark's words."""
    return aho_resample.target_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op12_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its half-edited text, and how alike they and the next text's are."""
    return syncmer_digest(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every text's words, planted ones among them, and what is left without repeats."""
    return run_digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_importance_sample, op2_token_files, op3_winnowing, op4_line_chunks, op5_compression_bands, op6_language, op7_near_duplicates,
    op8_histogram_shards, op9_pieces, op10_token_counts, op11_dictionary_resample,
    op12_closed_syncmers, op13_periodic_runs)}

ORACLE = {"op3_winnowing": winnowing.SQL, "op4_line_chunks": line_chunks.SQL, "op7_near_duplicates": minhash.SQL,
          "op11_dictionary_resample": aho_resample.SQL}
