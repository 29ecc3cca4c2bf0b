"""Line dedup by content-defined chunks of lines.

Boundaries between lines are chosen by hashes of the lines themselves (a
rolling hash whose window is one line), under ``SETS`` salted sets at once: in
set s a boundary stands before every line whose s-th hash bit is 0 and after
every line whose bit is 1. Boundaries depend on the line next to them alone, so
inserted lines move none, and a passage has the same chunks wherever it
stands. A set's chunks of several lines are those where a 0 line is followed by
a 1 line; two neighbouring lines are therefore a chunk in some set exactly if
one of the second line's bits is 1 where the first line's is 0, and the
united sets need one row per pair of lines, not one per set. Only pairs of
equal lines are a chunk in no set (and unequal ones with probability
(3/4)^60). Lines without a word are part of the chunk around them.

Every passage of two or more lines thus grows line by line out of chunks that
overlap by a line. Chunks that occur twice or more in the corpus are removed
after their first occurrence, in the order of (id, text hash, place); the
candidates come from a 64-bit hash, and a chunk goes only if its bytes equal
the first occurrence's.

DataFrame functions only. Shuffled are one digest row per pair of lines, and
the texts once (one exchange serves both joins with them) plus the bytes of
repeated chunks. Joins on a chunk are salted, so a chunk that a third of all
texts hold is spread over many tasks: ``SALTS`` for the digests, one for each
``SHARE`` occurrences for the bytes (the first occurrence's go to each).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import fresh, stored, without

#: Boundary sets (bits of a line's hash), tasks that share one chunk's digests, and occurrences whose bytes one task compares.
SETS, SALTS, SHARE = 60, 8, 1024
WORDY = r"[^\x09-\x0D\x20]"


def bind(value, use) -> F.Column:
    """``use(value)`` with the value computed once, as a lambda's variable."""
    return F.transform(F.array(value), use)[0]


def body(lines, first, last) -> F.Column:
    """The bytes of lines ``first`` to ``last``."""
    return F.array_join(F.slice(lines, first + 1, last - first + 1), "\n")


def chunked(text) -> F.Column:
    """array<struct<no, last, key>> of a text's chunks: first line, last line, hash of the bytes; null for a null text."""

    def digests(lines):
        wordy = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(WORDY))
        return bind(wordy, lambda w: bind(F.transform(w, lambda i: line_bits(F.get(lines, i))), lambda h: pairs(lines, w, h)))

    def line_bits(line):
        return F.conv(F.substring(F.md5(line), 1, SETS // 4), 16, 10).cast("long")

    def pairs(lines, w, h):
        rises = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda j: F.bitwise_not(F.get(h, j)).bitwiseAND(F.get(h, j + 1)) != 0)
        return F.transform(F.when(F.size(w) > 1, rises).otherwise(F.array().cast("array<int>")), lambda j: F.struct(
            F.get(w, j).alias("no"), F.get(w, j + 1).alias("last"), F.xxhash64(body(lines, F.get(w, j), F.get(w, j + 1))).alias("key")))

    return F.when(text.isNotNull(), bind(F.split(text, "\n", -1), digests))


def drop_repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated chunks gone from the text, and removed_chunks and removed_lines.

    A text without a removed chunk stays as it is; one whose lines all go
    becomes empty; a null text stays null, an empty one or one of white space
    or of a single line as it is. Rows that repeat an id and a text count as
    that one document. Null ids come first in the order; equal ids are told
    apart by their texts. Texts of any length are taken whole, in time that
    grows with their lines. An empty table gives an empty result. Columns
    named removed_chunks or removed_lines are replaced.
    """
    docs = without(docs, "removed_chunks", "removed_lines")
    th, gone, wid, wth, wanted_at = fresh(docs, "text_hash", "gone", "wanted_id", "wanted_hash", "wanted_places")
    rows = docs.withColumn(th, F.xxhash64(F.col(text)))
    place = F.struct("id", "th", "no")
    spread = F.xxhash64("id", "th", "no")

    def salts(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("salt")

    digests = stored(rows.select(F.col(doc_id).alias("id"), F.col(th).alias("th"), F.explode(chunked(F.col(text))).alias("c"))
                     .select("id", "th", "c.no", "c.last", "c.key"), "chunks")
    repeated = (digests.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last_place"), F.count("*").alias("n"))
                .filter("first <> last_place").select("key", "first", F.ceil(F.col("n") / SHARE).alias("shares")))
    met = digests.select("*", F.pmod(spread, F.lit(SALTS)).alias("salt")).join(
        repeated.select("*", salts(F.lit(SALTS).cast("long"))), ["key", "salt"])
    wanted = met.groupBy(F.col("id").alias(wid), F.col("th").alias(wth)).agg(
        F.collect_set(F.struct("no", "last", "key", "shares", (place == F.col("first")).alias("is_first"))).alias(wanted_at))

    def own(other_id, other_hash):
        return F.col(doc_id).eqNullSafe(F.col(other_id)) & (F.col(th) == F.col(other_hash))

    # The candidates' bytes, and the first occurrence's among them.
    # Joined like the texts below, by the same keys, so that one exchange of them serves both.
    lines = F.split(F.col(text), "\n", -1)
    held = rows.join(wanted, own(wid, wth)).select(F.col(doc_id).alias("id"), F.col(th).alias("th"), F.explode(bind(lines, lambda x: F.transform(
        F.col(wanted_at), lambda c: F.struct(
            c["no"].alias("no"), c["last"].alias("last"), c["key"].alias("key"), c["shares"].alias("shares"), c["is_first"].alias("is_first"),
            body(x, c["no"], c["last"]).alias("body"))))).alias("c")).select("id", "th", "c.*")
    firsts = held.filter("is_first").select("key", "shares", F.col("body").alias("first_body")).distinct().select("key", "first_body", salts(F.col("shares")))
    removed = held.filter(~F.col("is_first")).withColumn("salt", F.pmod(spread, F.col("shares"))).join(firsts, ["key", "salt"]).filter(F.col("body") == F.col("first_body"))
    per_text = removed.groupBy(F.col("id").alias(wid), F.col("th").alias(wth)).agg(
        F.collect_set(F.struct("no", "last")).alias(gone))  # a set: repeated rows remove the same chunks
    joined = rows.join(per_text, own(wid, wth), "left")
    # Lines that no removed chunk holds; set functions keep the order and take linear time.
    dropped = F.array_distinct(F.flatten(F.transform(F.col(gone), lambda c: F.sequence(c["no"], c["last"]))))
    kept = bind(lines, lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), dropped), lambda i: F.get(x, i)), "\n"))
    rebuilt = F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept)
    return joined.select(*[rebuilt.alias(c) if c == text else F.col(c) for c in docs.columns],
                         F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("removed_chunks"),
                         F.when(F.col(gone).isNull(), 0).otherwise(F.size(dropped)).cast("long").alias("removed_lines"))


#: The same result in DuckDB, chunks compared by their text.
SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
w AS (SELECT doc_id, i, ('0x' || md5(line)[1:15])::BIGINT AS h FROM l WHERE regexp_matches(line, '[^\x09-\x0D\x20]')),
p AS (SELECT doc_id, i AS a, lead(i) OVER w AS b, h, lead(h) OVER w AS next_h FROM w WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT p.doc_id, a, b, array_to_string(lines[a:b], chr(10)) AS body FROM p JOIN d USING (doc_id) WHERE b IS NOT NULL AND (~h) & next_h <> 0),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS n FROM c) WHERE n > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM g),
r AS (SELECT doc_id, count(*) AS removed_lines FROM x GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS removed_chunks FROM g GROUP BY doc_id),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.i = x.i
      WHERE x.i IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(removed_chunks, 0)::BIGINT AS removed_chunks, coalesce(removed_lines, 0)::BIGINT AS removed_lines
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)
"""
