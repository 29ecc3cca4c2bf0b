"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds its distinct k-word shingles. Two small collections of
m hashes each are drawn, every one of t minhashes; the m * m tables take as
key one hash of the first and one of the second collection. Two sets with
similarity s meet in a table with probability (1 - (1 - s^t)^m)^2: with
m = 8 and t = 2, 0.9994 at s = 0.8, from 32 minhashes in place of 256.

Equal sets are one class (a 128-bit fingerprint of the whole set), so exact
copies cost one row each. Class representatives are compared as follows.

1. Star: every member of a table's bucket is paired with the bucket's least
   id, in one aggregation and one join. Confirmed pairs are contracted.
2. Strays: a bucket whose members now belong to several components holds
   unchecked pairs. Its members join the family of the bucket's largest
   component, the main one; all others are strays. Main members are connected
   already, so only strays are compared, with main members and with each
   other. Both are cut into chunks of about ``BLOCK`` shingles; each pair of a
   stray chunk with a main or stray chunk is one task group, and small
   families share groups: a family of n with s strays costs n * s pairs, and
   a main set is copied once per chunk of strays. Inside a group numpy compares
   those pairs that meet in a table and lie in different components, and only
   confirmed links leave it, one per set and component.

Step 1 makes a large group of near copies one component at a linear cost;
step 2 leaves no pair of a bucket that could change a component unchecked.
Every link is confirmed on the full sets.
"""

from __future__ import annotations

import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import SLICE_BYTES, fresh, per_slice, stored
from murmur.llm.components import contract
from murmur.llm.flat import byte_texts, hash_spans, long_cuts, mix64, spans, symbol_values, windows
from murmur.operators.common import small_side

#: Hashes in each collection, and minhashes in each hash.
COLLECTION, PER_HASH = 8, 2
#: Shingles in one chunk of a family (8 bytes each); a task group holds two chunks.
BLOCK = 1 << 18
#: Leaves of one star's centre that one task compares.
LEAVES = 256
#: A cut through a long text may follow any white space.
CUT = re.compile(rb"[\x20\x09-\x0D]")


def _word_symbols() -> tuple[np.ndarray, np.ndarray]:
    """A random value per byte with A-Z as a-z, and which bytes are not white space."""
    values = symbol_values(7)
    values[0x41:0x5B] = values[0x61:0x7B]
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return values, word


def word_hashes(column: pa.Array, step: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the n + 1 numbers of each text's first word; a single text longer than ``step`` is taken in pieces."""
    values, word = _word_symbols()
    raw, offsets = byte_texts(column)
    if len(offsets) == 2 and len(raw) > step:
        parts = []
        for piece in long_cuts(raw.tobytes(), step, CUT):
            part = np.frombuffer(piece, np.uint8)
            parts.append(hash_spans(values[part], *spans(word[part], np.array([0, len(part)]))))
        h = np.concatenate(parts)
        return h, np.array([0, len(h)])
    starts, ends = spans(word[raw], offsets)
    return hash_spans(values[raw], starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, k: int, step: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts end to end (ascending in each), and n + 1 offsets.

    Words are runs without ASCII white space, A-Z lower-cased. A text of
    fewer than k words has its whole sequence as one shingle; one without
    words (or null) has none.
    """
    h, first = word_hashes(column, step)
    n = len(first) - 1
    shingles, owner = windows(h, first, k)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            more = counts[short] > j
            extra[more] = mix64(extra[more] * np.uint64(0xD6E8FEB86659FD93) + h[first[short[more]] + j])
        extra = mix64(extra ^ np.uint64(0x5851F42D4C957F2D) ^ counts[short].astype(np.uint64))
        shingles, owner = np.r_[shingles, extra], np.r_[owner, short]
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    if len(shingles):
        new = np.r_[True, (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])]
        shingles, owner = shingles[new], owner[new]
    return shingles, np.searchsorted(owner, np.arange(n + 1))


def signatures(shingles: np.ndarray, offsets: np.ndarray, m: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, 2m) collection hashes and two 64-bit set fingerprints; zero for empty sets."""
    n = len(offsets) - 1
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((n, 2 * m), np.uint64)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if not len(full):
        return out, one, two
    at = offsets[:-1][full]
    one[full] = np.add.reduceat(mix64(shingles), at)
    two[full] = np.add.reduceat(mix64(shingles ^ np.uint64(0x2545F4914F6CDD1D)), at)
    multipliers = mix64(np.arange(1, 2 * m * t + 1, dtype=np.uint64)) | np.uint64(1)
    for i in range(2 * m):
        for j in range(t):
            hashed = shingles * multipliers[i * t + j]
            hashed ^= hashed >> np.uint64(32)
            hashed *= np.uint64(0xD6E8FEB86659FD93)
            least = np.minimum.reduceat(hashed, at)
            out[full, i] = mix64(out[full, i] * np.uint64(31) + least)
    return out, one, two


def shingle_table(docs: DataFrame, doc_id: str, text: str, k: int, m: int, t: int) -> DataFrame:
    """doc_id, n_shingles, set fingerprints and the two collections of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("one", pa.int64()), ("two", pa.int64()),
                        ("hashes", pa.list_(pa.int64()))])

    def sign(batch):
        shingles, offsets = shingle_sets(batch.column("text"), k)
        sig, one, two = signatures(shingles, offsets, m, t)
        flat = pa.array(sig.ravel().view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, 2 * m), pa.int32()), flat)
        return {"doc_id": batch.column("doc_id"), "n_shingles": np.diff(offsets), "one": one.view(np.int64),
                "two": two.view(np.int64), "hashes": lists}

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(per_slice(sign, schema),
                           "doc_id long, n_shingles long, one long, two long, hashes array<long>")


def buckets(reps: DataFrame, m: int) -> DataFrame:
    """One row per representative and table: the table's key and the id."""
    keys = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(m - 1)),
        lambda j: F.xxhash64(i, j, F.get(F.col("hashes"), i), F.get(F.col("hashes"), j + m)))))
    return reps.select("rep", "n_shingles", F.explode(keys).alias("key"))


def common_items(a: np.ndarray, b: np.ndarray) -> int:
    """How many items two ascending, non-empty arrays share."""
    if len(a) < len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum())


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets have 100 * intersection >= percent * union.

    A centre ``a`` of many pairs has them spread over tasks of about ``LEAVES``
    pairs, and its set goes to each."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches):
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for i in range(batch.num_rows):
                if a[i] not in held:  # a star's centre comes with many leaves
                    held[a[i]] = np.frombuffer(batch.column("set_a")[i].as_py(), np.uint64)
                    if len(held) > 64:
                        held.popitem(last=False)
                left, right = held[a[i]], np.frombuffer(batch.column("set_b")[i].as_py(), np.uint64)
                shared = common_items(left, right)
                keep.append(100 * shared >= percent * (len(left) + len(right) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], schema=schema)

    pairs = stored(pairs, "pairs")
    hot = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > LEAVES).select("a", F.ceil(F.col("n") / LEAVES).alias("shares"))
    hot = small_side(stored(hot, "centres"))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("shares")), F.lit(0)).alias("salt"))
    centres = (sets.select(F.col("rep").alias("a"), F.col("members").alias("set_a")).join(pairs.select("a").distinct(), "a", "left_semi")
               .join(hot, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shares", F.lit(1)) - 1))))
    both = (dealt.join(sets.select(F.col("rep").alias("b"), F.col("members").alias("set_b")), "b")
            .join(centres.select("a", "salt", "set_a"), ["a", "salt"]))
    return both.select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long")


def set_table(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """rep and its set (ascending 64-bit shingle hashes as bytes) for the wanted ids."""
    schema = pa.schema([("rep", pa.int64()), ("members", pa.binary())])

    def collect(batch):
        shingles, offsets = shingle_sets(batch.column("text"), k)
        raw = shingles.tobytes()
        return {"rep": batch.column("rep"),
                "members": [raw[8 * a:8 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]}

    rows = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text")).join(wanted, "rep", "left_semi")
    return rows.mapInArrow(per_slice(collect, schema), "rep long, members binary")


def stray_links(family: DataFrame, reps: DataFrame, sets: DataFrame, m: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Confirmed (a, b) between strays of a family and its other members, where they lie in different components.

    ``family`` has (family, rep, label), ``reps`` (rep, n_shingles, hashes), ``sets`` (rep, members)."""
    main = F.col("label") == F.col("family")
    sized = family.join(reps, "rep").withColumn("main", main)
    count = (sized.groupBy("family").agg(F.sum(F.when(F.col("main"), F.col("n_shingles")).otherwise(0)).alias("main_size"),
                                         F.sum(F.when(F.col("main"), 0).otherwise(F.col("n_shingles"))).alias("stray_size"))
             .withColumn("mains", F.greatest(F.lit(1), F.ceil(F.col("main_size") / block)).cast("int"))
             .withColumn("strays", F.greatest(F.lit(1), F.ceil(F.col("stray_size") / block)).cast("int"))
             .withColumn("small", F.col("main_size") + F.col("stray_size") <= block))
    held = count.filter("small").agg(F.sum(F.col("main_size") + F.col("stray_size"))).first()[0] or 0
    bins = max(1, -(-held // block))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("strays"))).cast("int")

    def groups(kind, n, i, j):
        return F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.struct(F.lit(kind).alias("kind"), i(x).alias("i"), j(x).alias("j")))

    # kind 0: a small family whole; 1: stray chunk i with main chunk j; 2: stray chunks i <= j.
    chunk = F.col("chunk")
    with_main = groups(1, F.col("strays"), lambda x: x, lambda x: chunk)
    as_stray = F.concat(groups(1, F.col("mains"), lambda x: chunk, lambda x: x),
                        groups(2, F.col("strays"), lambda x: F.least(x, chunk), lambda x: F.greatest(x, chunk)))
    places = (F.when(F.col("small"), groups(0, F.lit(1), lambda x: x, lambda x: x)).when(F.col("main"), with_main).otherwise(as_stray))
    rows = (sized.join(count.drop("main_size", "stray_size"), "family").withColumn("chunk", own).withColumn("g", F.explode(places))
            .withColumn("slot", F.when(F.col("small"), F.expr(f"pmod(xxhash64(family), {bins}) - {bins}")).otherwise(F.col("family"))).join(sets, "rep"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        def column(name):
            return np.asarray(group.column(name).combine_chunks().to_numpy(zero_copy_only=False))

        rep, label, fam, chunk, main, n = (column(x) for x in ("rep", "label", "family", "chunk", "main", "n_shingles"))
        kind, i, j = (int(group.column(c)[0].as_py()) for c in ("kind", "i", "j"))
        flat = group.column("hashes").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rep), 2 * m)
        raw = group.column("members")
        members: dict[int, np.ndarray] = {}

        def members_of(x):
            if x not in members:
                members[x] = np.frombuffer(raw[x].as_py(), np.uint64)
            return members[x]

        main = main.astype(bool)
        left = np.flatnonzero(~main & ((chunk == i) | (kind == 0)))
        out_a, out_b = [], []
        for x in left.tolist():
            other = main if kind == 1 else ~main & (rep > rep[x]) if kind == 2 and i == j else ~main & (chunk == j) if kind == 2 else main | (rep > rep[x])
            lo, hi = np.minimum(n, n[x]), np.maximum(n, n[x])
            y = np.flatnonzero(other & (fam == fam[x]) & (label != label[x]) & (100 * lo >= percent * hi))
            if not len(y):
                continue
            same = flat[y] == flat[x]
            y = y[same[:, :m].any(1) & same[:, m:].any(1)]
            linked: set[int] = set()
            for z in y.tolist():
                if label[z] in linked:
                    continue
                a, b = members_of(x), members_of(z)
                shared = common_items(a, b)
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    linked.add(int(label[z]))
                    out_a.append(int(rep[x]))
                    out_b.append(int(rep[z]))
        return pa.Table.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], schema=schema)

    return (rows.select("slot", "g.kind", "g.i", "g.j", "family", "rep", "label", "chunk", "main", "n_shingles", "hashes", "members")
            .groupBy("slot", "kind", "i", "j").applyInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
                    m: int = COLLECTION, t: int = PER_HASH) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable over links) and kept, one row per row of ``docs``.

    Links join documents whose shingle sets have 100 * intersection >=
    percent * union. A text that is null, empty or white space has an empty
    set and links with nothing. Rows with a null id link with nothing, have
    a null component and are kept. Rows that repeat an id count as linked.
    The words of a long text are hashed in pieces, its shingles held as a
    whole. An empty table gives an empty result. Columns of ``docs`` other than
    the two named ones play no part, whatever their names.
    """
    signed = stored(shingle_table(docs, doc_id, text, words, m, t), "shingles")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    # max_by needs no row order: members of a class have equal hashes.
    classes = stored(full.groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("rep"),
                                                                  F.any_value("hashes").alias("hashes")), "classes")
    rows = buckets(classes, m)
    centres = rows.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("size")).filter("size > 1")
    member = stored(rows.join(centres.select("key", "centre"), "key"), "buckets")
    close = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"))

    def plausible(pairs):
        """Distinct pairs whose sizes alone allow the similarity."""
        lo, hi = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
        return pairs.filter(100 * lo >= percent * hi).select("a", "b").distinct()

    star = (member.filter("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"))
            .distinct().join(close, "a"))
    sets = stored(set_table(docs, member.select("rep").distinct(), doc_id, text, words), "sets")
    links = stored(confirmed(plausible(star), sets, percent), "links")
    labels = contract(links, classes.select(F.col("rep").alias("node")))
    placed = member.join(labels.withColumnRenamed("node", "rep"), "rep").select("key", "rep", "label")
    sizes = placed.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = (sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("family"), F.count("*").alias("labels"))
            .filter("labels > 1").select("key", "family"))
    family = stored(placed.join(main, "key").select("family", "rep", "label").distinct(), "families")
    more = stored(stray_links(family, classes.select("rep", "n_shingles", "hashes"), sets, m, percent), "links")
    final = contract(links.unionByName(more), classes.select(F.col("rep").alias("node")))
    by_class = classes.join(final.withColumnRenamed("node", "rep"), "rep").select("one", "two", "n_shingles", F.col("label").alias("component"))
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return (signed.drop("hashes").join(by_class, ["one", "two", "n_shingles"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that with the least id.

    Rows with a null id all stay; rows that repeat a kept id stay together.
    """
    (gone_id,) = fresh(docs, "gone_id")
    gone = near_duplicates(docs, doc_id, text, words, percent).filter("not kept").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col(doc_id).cast("long") == F.col(gone_id), "left_anti")


#: near_duplicates(words=2, percent=80) in DuckDB, by counting the shingles all pairs share.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g
      FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id,
       coalesce(m.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
