"""Embedding similarity of sampled comments (#26, #31, #63, #64).

The reference embeds 10 randomly sampled comments and shows the strict
lower triangle of their 10 x 10 inner products. Here the sample is a
seeded top-n by md5 over the whole table (per-task top-n, then a merge of
n rows per task), and only those n rows take part in the pair join, so
its size is n(n-1)/2 whatever the table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.scalar import md5_key
from murmur.functions.text import tokens_lower
from murmur.operators.common import small_side
from murmur.operators.prepare import sample_n
from murmur.session import cut_lineage


def dot(a, b):
    """Inner product of two array<float> columns, accumulated in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def similarity_pairs(df: DataFrame, n: int = 10, seed=0, key: str = "vec_id",
                     emb: str = "embedding", max_n: int = 1000) -> DataFrame:
    """Inner products of all pairs i > j among ``n`` sampled rows.

    Output: i, j (sample positions from 0), their keys, the product and the
    display value clipped to [0, 1]. Fewer than ``n`` rows is an error, as
    is a sample of more than ``max_n`` rows (its pairs are all compared).
    """
    if n > max_n:
        raise ValueError(f"the pair sample is limited to {max_n} rows (max_n)")
    s = sample_n(df.select(key, emb), n, key, seed, exact=True)
    # n rows only: a single-partition window over the sample is bounded.
    pos = s.withColumn("pos", (F.row_number().over(Window.orderBy(md5_key(F.col(key), seed), F.col(key))) - 1)
                       .cast("int"))
    a = pos.select(F.col("pos").alias("i"), F.col(key).alias("key_i"), F.col(emb).alias("e_i"))
    b = pos.select(F.col("pos").alias("j"), F.col(key).alias("key_j"), F.col(emb).alias("e_j"))
    pairs = a.join(F.broadcast(b), F.col("i") > F.col("j"), "inner")
    d = dot(F.col("e_i"), F.col("e_j"))
    return pairs.select("i", "j", "key_i", "key_j",
                        F.round(d, 6).alias("inner_product"),
                        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), d)), 6).alias("shown"))


def _place_and_sign(token, dim: int):
    """A token's place (the first 8 hex digits of its md5 mod ``dim``) and whether its sign is plus (the ninth digit is odd)."""
    h = F.coalesce(F.conv(F.substring(F.md5(token), 1, 9), 16, 10).cast("long"), F.lit(0).cast("long"))
    return (F.shiftright(h, 4) % dim).cast("int"), (h % 2).cast("int")


def hashed_embedding(text, dim: int = 64):
    """A deterministic stand-in encoder as a column expression: signed
    feature hashing of the word tokens, L2-normalised (zeros for no token).

    A token's md5 gives its place (first 8 hex digits mod ``dim``) and its
    sign (the ninth digit's parity). Place and sign make one small number; the
    tokens' numbers are sorted with each possible one added once, so a number's
    run begins where it differs from its neighbour, and the row is read once
    whatever ``dim`` is."""
    def signed(t):
        place, plus = _place_and_sign(t, dim)
        return F.coalesce(place * 2 + plus, F.lit(0))

    def starts(s):
        return F.concat(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))), F.array(F.size(s)))

    def counted(at):
        # Number c's tokens: its run without the added one. The added ones of plus and minus cancel out.
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (
            F.get(at, i * 2 + 2) - F.get(at, i * 2 + 1) * 2 + F.get(at, i * 2)).cast("long"))

    def scaled(v):
        norm = F.sqrt(F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x * x).cast("double"))
        return F.transform(F.array(norm), lambda z: F.transform(v, lambda x: F.when(z > 0, F.try_divide(x.cast("double"), z)).otherwise(0.0).cast("float")))[0]

    numbers = F.sort_array(F.concat(F.transform(tokens_lower(text), signed), F.sequence(F.lit(0), F.lit(2 * dim - 1))))
    return F.transform(F.transform(F.transform(F.array(numbers), starts), counted), scaled)[0]


def embed(df: DataFrame, embed_fn=None, dim: int = 64, text: str = "commentText",
          col: str = "embedding", batch_size: int = 256) -> DataFrame:
    """Add an ``array<float>`` embedding column.

    With a caller's batch encoder (text[] -> float[n, dim]) Arrow batches go
    through ``predict_batch_udf``; the default encoder is the column
    expression above."""
    if embed_fn is None:
        return df.select("*", F.inline(F.array(F.struct(hashed_embedding(F.col(text), dim).alias(col)))))
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(lambda: embed_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(col, udf(F.coalesce(F.col(text), F.lit(""))))


def fit_term_weights(df: DataFrame, text: str = "commentText", key: str = "comment_id") -> DataFrame:
    """(token, weight): each word's inverse document frequency ln((n + 1) / (df + 1)) + 1 over the rows of ``df``.

    Words are counted once per row, inside each task before the shuffle. The
    table is the fitted encoder: write it with ``write_table`` to keep it."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    found = df.select(F.explode(F.array_distinct(tokens_lower(F.col(text)))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    weight = F.log((F.col("_total") + 1).cast("double") / (F.col("_df") + 1).cast("double")) + 1.0
    # Stored: those who use the table read it more than once.
    return cut_lineage(found.crossJoin(F.broadcast(total)).select("token", weight.alias("weight")))  # one row


def encode_fitted(df: DataFrame, weights: DataFrame, dim: int = 64, text: str = "commentText", key: str = "comment_id") -> DataFrame:
    """(comment_id, embedding): the rows' weighted words projected on ``dim`` places, L2-normalised.

    A word's md5 gives its place and sign, as in ``hashed_embedding``; its part
    is occurrences times weight. Words without a weight count nothing; a row
    without words has zeros. The texts are dealt out by their key once, and parts
    are added per row and place there; a weight's place and sign are found once
    per word of the table, which is broadcast after a size check. Rows of one
    key are one text."""
    place, plus = _place_and_sign(F.col("token"), dim)
    fitted = weights.select("token", place.alias("_at"), (F.col("weight") * F.when(plus == 1, 1.0).otherwise(-1.0)).alias("_w"))
    texts = df.select(key, text).repartition(F.col(key))
    counted = texts.select(F.col(key), F.explode_outer(tokens_lower(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("_n"))
    parts = counted.join(small_side(fitted), "token", "left").select(key, "_at", (F.col("_n") * F.col("_w")).alias("_v"))
    places = (parts.groupBy(key, "_at").agg(F.sum("_v").alias("_v")).groupBy(key)
              .agg(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "_v"))).alias("_p"), F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_norm")))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                         lambda i: F.when(F.col("_norm") > 0, F.coalesce(F.col("_m")[i], F.lit(0.0)) / F.col("_norm")).otherwise(F.lit(0.0)))
    # Through a one-row generator: the map is made once per row, not once per place.
    mapped = places.select(key, "_norm", F.inline(F.array(F.struct(F.map_from_entries("_p").alias("_m")))))
    return mapped.select(key, vector.alias("embedding"))
