"""Benchmark decontamination by winnowing.

Texts are word sequences. Every run of K words has a hash, and a text keeps
the least hash of every WINDOW neighbouring runs. Two texts that share
K + WINDOW - 1 = 10 words in a row therefore keep a common hash: the least of
that span is the same in both. Joining the kept hashes of documents with
those of the items finds every document that can share a whole 10-word
window; only these are looked at again.

There the hits are extended: all equal K-word runs of document and item that
follow each other on one diagonal form a span, and a span of 10 words or more
holds the windows of the item that occur. Items shorter than 10 words are one
window each; for these, all runs of exactly their length are compared, one
pass for each such length (nine at most).

DataFrame functions only. The items' hashes are broadcast when they are few
by count, else joined by a shuffle, with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import fresh, stored

SPAN, K = 10, 5
WINDOW = SPAN - K + 1
#: Item runs that may be broadcast (20 bytes each).
BROADCAST_RUNS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text) -> F.Column:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased; null has none."""
    plain = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(plain) == F.char_length(plain), F.lower(plain)).otherwise(F.translate(plain, UPPER, LOWER))
    # Splitting between words is quicker than matching them; only the first and last part can be empty.
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def bind(value, use) -> F.Column:
    """``use(value)`` with the value computed once, as a lambda's variable."""
    return F.transform(F.array(value), use)[0]


def word_hashes(w) -> F.Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def runs(h, k: int) -> F.Column:
    """Hashes of all runs of k words."""
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0))),
                       lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))


def word_runs(w, k: int) -> F.Column:
    return bind(word_hashes(w), lambda h: runs(h, k))


def least_of_windows(g) -> F.Column:
    """The least hash of every WINDOW neighbouring runs; none if there are fewer."""
    return F.transform(F.slice(g, 1, F.greatest(F.size(g) - (WINDOW - 1), F.lit(0))),
                       lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, WINDOW)]))


def fingerprints(w) -> F.Column:
    return F.array_distinct(bind(word_runs(w, K), least_of_windows))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Hit spans: id, text_hash, item, start and length in words, each span maximal.

    A null text has no words and no span, nor has an item with a null id or
    without words. Rows that repeat an id and a text are one document here;
    null ids are told apart by their texts. Items of fewer than ten words are
    one window; equal items are hit alike. Long texts are taken whole. Empty
    tables give an empty result. Columns other than the named ones play no part.
    """
    own = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    item = stored(items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), words(F.col(item_text)).alias("w"))
                  .filter("size(w) > 0").distinct().withColumn("item_hash", F.xxhash64(F.concat_ws(" ", "w"))), "items")
    shape = item.agg(F.sum(F.size("w")), F.collect_set(F.when(F.size("w") < SPAN, F.size("w")))).first()
    n_words, short = shape[0] or 0, sorted(shape[1])

    def lookup(table):
        return F.broadcast(table) if n_words <= BROADCAST_RUNS else table

    found = []
    if n_words:
        long_items = item.filter(F.size("w") >= SPAN)
        prints = long_items.select(F.explode(fingerprints(F.col("w"))).alias("print")).distinct()
        # explode_outer: Spark would otherwise infer a filter on the array and compute it twice.
        kept = own.select("id", "text_hash", F.explode_outer(fingerprints(words(F.col("text")))).alias("print"))
        suspects = stored(kept.join(lookup(prints), "print", "left_semi").select("id", "text_hash").distinct(), "suspects")
        grams = long_items.select("item", "item_hash", F.posexplode(word_runs(F.col("w"), K)).alias("at", "run"))
        near = own.join(suspects.withColumnsRenamed({"id": "sid", "text_hash": "sth"}),
                        F.col("id").eqNullSafe(F.col("sid")) & (F.col("text_hash") == F.col("sth")), "left_semi")
        dense = near.select("id", "text_hash", F.posexplode_outer(word_runs(words(F.col("text")), K)).alias("pos", "run"))
        hits = (dense.join(lookup(grams), "run").select("id", "text_hash", "item", "item_hash", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
                .distinct())
        line = Window.partitionBy("id", "text_hash", "item", "item_hash", "diagonal").orderBy("pos")
        spans = (hits.withColumn("island", F.col("pos") - F.row_number().over(line))
                 .groupBy("id", "text_hash", "item", "item_hash", "diagonal", "island")
                 .agg(F.min("pos").alias("start"), (F.count("*") + (K - 1)).cast("int").alias("length")).filter(F.col("length") >= SPAN))
        found.append(spans.select("id", "text_hash", "item", "start", "length"))
    for n in short:
        whole = item.filter(F.size("w") == n).select("item", word_runs(F.col("w"), n)[0].alias("run"))
        dense = own.select("id", "text_hash", F.posexplode_outer(word_runs(words(F.col("text")), n)).alias("start", "run"))
        found.append(dense.join(lookup(whole), "run").select("id", "text_hash", "item", "start", F.lit(n).alias("length")))
    if not found:
        return own.select("id", "text_hash", F.lit(None).cast("string").alias("item"), F.lit(0).alias("start"), F.lit(0).alias("length")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``.

    n_hit counts words inside any span, each once. Items are listed by id,
    sorted as strings. An empty table, of documents or of items, is no error.
    """
    spans = stored(contamination(docs, items), "spans")
    before = F.max(F.col("start") + F.col("length")).over(
        Window.partitionBy("id", "text_hash").orderBy("start", "length", "item").rowsBetween(Window.unboundedPreceding, -1))
    fresh_words = F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest("start", F.coalesce(before, F.lit(0))))
    hits = (spans.withColumn("fresh", fresh_words).groupBy("id", "text_hash")
            .agg(F.sum("fresh").alias("n_hit"), F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items")))
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return (rows.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("text_hash")), "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of an item; a null text holds none."""
    sid, sth = fresh(docs, "span_id", "span_hash")
    spans = contamination(docs, items, doc_id, text).select(F.col("id").alias(sid), F.col("text_hash").alias(sth)).distinct()
    return docs.join(spans, F.col(doc_id).eqNullSafe(F.col(sid)) & (F.xxhash64(F.col(text)) == F.col(sth)), "left_anti")


#: The same report in DuckDB, by comparing all windows as text.
SQL = r"""
WITH b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n,
              unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
       FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i,
              unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g
       FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
