"""Tokens, n-grams, vocabularies, counts, word lists and tag chunks
(#27, #39, #40, #50-#58, #61, #62).

Tokens stay arrays inside each row as long as possible. Explodes happen
right before an aggregation, where partial (map-side) aggregation merges
repeated words inside each task before the shuffle, so a word used in a
third of all comments costs one row per task, not one row per use.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.text import marked_pieces, ngrams, piece_tokens, tokens_cased, tokens_lower
from murmur.operators.common import constant_lookup, small_side, word_list_df
from murmur.operators.rank import sorted_places
from murmur.schemas import COMMENT_ID, DEFAULT_TAG, NP_TAG_PATTERN, TEXT
from murmur.session import cut_lineage


def _toks(df: DataFrame, text: str, lower: bool):
    return tokens_lower(F.col(text)) if lower else tokens_cased(F.col(text))


def with_tokens(df: DataFrame, text: str = TEXT, lower: bool = True, col: str = "_toks") -> DataFrame:
    """Add the token array as its own column through a one-row generator:
    no later filter or projection can substitute the regex, so it runs once
    per row."""
    return df.select("*", F.inline(F.array(F.struct(_toks(df, text, lower).alias(col)))))


def token_table(df: DataFrame, text: str = TEXT, key: str = COMMENT_ID, lower: bool = True) -> DataFrame:
    """(comment_id, pos, token) with pos from 0 in text order."""
    return df.select(F.col(key), F.posexplode(_toks(df, text, lower)).alias("pos", "token"))


def ngram_table(df: DataFrame, n: int, text: str = TEXT, key: str = COMMENT_ID) -> DataFrame:
    """(comment_id, pos, gram) of lower-cased word n-grams."""
    t = with_tokens(df, text)
    return t.select(F.col(key), F.posexplode(ngrams(F.col("_toks"), n)).alias("pos", "gram"))


def word_windows(df: DataFrame, n: int, text: str = TEXT) -> DataFrame:
    """(w1, ..., wn): each word with the n - 1 words after it, NULL beyond the text's last one.

    One row per word in plain columns: no string is joined and no function
    runs per array element before equal windows are merged."""
    at = with_tokens(df.select(text), text).select("_toks", F.posexplode("_toks").alias("_i", "w1"))
    return at.select("w1", *[F.get("_toks", F.col("_i") + j).alias(f"w{j + 1}") for j in range(1, n)])


def vocabulary(df: DataFrame, n: int = 1, text: str = TEXT) -> DataFrame:
    """Distinct n-grams (the fitted vectoriser's feature names)."""
    found = word_windows(df, n, text).filter(F.col(f"w{n}").isNotNull()).distinct()
    return found.select(F.concat_ws(" ", *found.columns).alias("gram"))


def _hashes_differ(words: DataFrame, col: str) -> bool:
    """Whether no two of the distinct words have one 64-bit hash (counted, not assumed)."""
    hashes = words.groupBy(F.xxhash64(col)).agg(F.count(F.lit(1)).alias("_n"))
    return hashes.filter("_n > 1").isEmpty()


def ngram_counts(df: DataFrame, orders: Sequence[int] = (1, 2, 3), text: str = TEXT) -> DataFrame:
    """Vocabulary size per n-gram order, all orders in one pass over the text.

    A shorter gram begins a window of the longest order, so its distinct
    values are counted among the distinct windows: one row per word and no
    gram of each order. Words stand as 64-bit hashes there, after all words of
    the text were found to have different ones; if not, as themselves."""
    longest = max(orders)
    words = [f"w{k}" for k in range(1, longest + 1)]
    found, counts = word_windows(df, longest, text), []
    if _hashes_differ(vocabulary(df, 1, text), "gram"):
        found = found.select(*[F.when(F.col(w).isNotNull(), F.xxhash64(w)).alias(w) for w in words])
    found = found.distinct()
    for k in range(longest, 0, -1):
        # Rows are distinct windows of k words here: those with a k-th word are the grams of order k.
        sums = [F.sum(c).alias(c) for c in counts] + ([F.count(words[k - 1]).alias(f"_n{k}")] if k in orders else [])
        counts += [f"_n{k}"] if k in orders else []
        found = found.groupBy(*words[:k - 1]).agg(*sums) if sums else found.select(*words[:k - 1]).distinct()
    rows = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"_n{n}").alias("n_distinct")) for n in sorted(set(orders))])
    return found.select(F.inline(rows)).filter("n_distinct > 0")


def doc_term_counts(df: DataFrame, n: int = 1, text: str = TEXT, key: str = COMMENT_ID) -> DataFrame:
    """(comment_id, gram, count): the document-term matrix in long form.
    A comment's grams live in one task, so partial aggregation already
    produces final counts before the shuffle."""
    t = with_tokens(df.select(key, text), text)
    ex = t.select(F.col(key), F.explode(ngrams(F.col("_toks"), n)).alias("gram"))
    return ex.groupBy(key, "gram").agg(F.count(F.lit(1)).alias("count"))


def vocabulary_ids(df: DataFrame, n: int = 1, text: str = TEXT) -> DataFrame:
    """(id, gram): every distinct n-gram with its column number, 0 to n - 1 in sorted order.

    The grams are range-partitioned and sorted; a gram's number is its place
    in its partition plus the rows of the partitions before it, so no task
    sees the whole vocabulary."""
    # Stored first: planning a sort by ranges reads its input more than once.
    placed = sorted_places(cut_lineage(vocabulary(df, n, text)), ["gram"])
    before = F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    offsets = (placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
               .select("_pid", F.coalesce(before, F.lit(0)).alias("_before")))
    return placed.join(F.broadcast(offsets), "_pid").select((F.col("_before") + F.col("_li")).alias("id"), "gram")


def document_vectors(df: DataFrame, vocab: DataFrame, n: int = 1, text: str = TEXT, key: str = COMMENT_ID) -> DataFrame:
    """(comment_id, ids, counts): a sparse vector per row of ``df``, ids ascending.

    Grams that ``vocab`` (see ``vocabulary_ids``) lacks are no columns; a row
    without any has empty arrays. The texts are dealt out by their key once, and
    everything else happens there: the vocabulary is broadcast after a size
    check, else joined by a shuffle on the gram. Rows of one key are one document."""
    t = with_tokens(df.select(key, text).repartition(F.col(key)), text)
    terms = t.select(key, F.explode_outer(ngrams(F.col("_toks"), n)).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("count"))
    cells = terms.join(small_side(vocab.select("id", "gram")), "gram", "left")
    cell = F.when(F.col("id").isNotNull(), F.struct("id", "count"))
    pairs = cells.groupBy(key).agg(F.sort_array(F.collect_list(cell)).alias("_p"))
    return pairs.select(key, F.col("_p.id").alias("ids"), F.col("_p.count").alias("counts"))


def dot_products(vectors: DataFrame, others: DataFrame, key: str = COMMENT_ID) -> DataFrame:
    """(comment_id, other_id, dot) for every pair of vectors that share a column.

    The columns of ``others`` are broadcast after a size check; products are
    added per pair inside each task before the shuffle."""
    def long(v, names):
        return v.select(F.col(key).alias(names[0]), F.explode(F.arrays_zip("ids", "counts")).alias("_p")).select(
            names[0], F.col("_p.ids").alias("id"), F.col("_p.counts").alias(names[1]))

    left, right = long(vectors, (key, "_a")), long(others, ("other_id", "_b"))
    return left.join(small_side(right), "id").groupBy(key, "other_id").agg(F.sum(F.col("_a") * F.col("_b")).alias("dot"))


def sorted_slice(df: DataFrame, col: str, start: int, length: int, desc: bool = False) -> DataFrame:
    """Rows ``start`` .. ``start+length-1`` of ``df`` sorted by ``col``
    (top-k plan: TakeOrderedAndProject, no global sort)."""
    o = F.col(col).desc() if desc else F.col(col).asc()
    return df.orderBy(o).offset(start).limit(length) if start else df.orderBy(o).limit(length)


def token_counts(df: DataFrame, text: str = TEXT, key: str = COMMENT_ID, parted: bool = False) -> DataFrame:
    """Case-kept token counts per comment (words, apostrophe tails, marks);
    with ``parted`` of treebank-style tokens, contractions split."""
    if parted:  # as tokens_parted, without a function per array element
        pieces = df.select(F.col(key), F.explode(marked_pieces(F.col(text))).alias("_piece"))
        ex = pieces.select(key, F.explode(piece_tokens("_piece")).alias("token")).filter(F.col("token") != "")
    else:
        ex = df.select(F.col(key), F.explode(tokens_cased(F.col(text))).alias("token"))
    return ex.groupBy(key, "token").agg(F.count(F.lit(1)).alias("count"))


def remove_words(df: DataFrame, words: Iterable[str] | DataFrame, col: str = "token") -> DataFrame:
    """Anti join against a word list (case-sensitive). The list is broadcast
    after a size check; a larger list is shuffle-joined."""
    if not isinstance(words, DataFrame):
        words = word_list_df(df.sparkSession, words, col)
    return df.join(small_side(words.select(col).distinct()), col, "left_anti")


def token_doc_freq(df: DataFrame, stopwords: Iterable[str], limit: int | None = None,
                   text: str = TEXT, key: str = COMMENT_ID) -> DataFrame:
    """In how many comments each case-kept token occurs, after removing the
    given stop words and punctuation (case-sensitive). ``limit`` keeps the
    first n comments by id (``None`` = all)."""
    from murmur.operators.prepare import first_n

    base = first_n(df, limit, key)
    ex = base.select(F.explode(F.array_distinct(tokens_cased(F.col(text)))).alias("token"))
    kept = remove_words(ex, stopwords, "token")
    return kept.groupBy("token").agg(F.count(F.lit(1)).alias("n_comments"))


def top_words(df: DataFrame, stopwords: Iterable[str], n: int = 200, text: str = TEXT) -> DataFrame:
    """The n most frequent lower-cased words after stop-word removal
    (ties by word); the table behind the word cloud."""
    ex = df.select(F.explode(tokens_lower(F.col(text))).alias("token"))
    kept = remove_words(ex, [w.lower() for w in stopwords], "token")
    counts = kept.groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("token")).limit(n)


def _weighted_log(k, n, x):
    """k ln x + (n - k) ln(1 - x), each probability at least 1e-10."""
    least = F.lit(1e-10)
    return F.log(F.greatest(x, least)) * k + F.log(F.greatest(F.lit(1.0) - x, least)) * (n - k)


def likelihood_ratio(c12, c1, c2, n):
    """Dunning's G2 of a pair: its count, those of its words, and all words; 0 where one word makes up the text."""
    c12, c1, c2, n = (c.cast("double") for c in (c12, c1, c2, n))
    p, p1, p2 = c2 / n, c12 / c1, F.try_divide(c2 - c12, n - c1)
    score = (_weighted_log(c12, c1, p) + _weighted_log(c2 - c12, n - c1, p)
             - _weighted_log(c12, c1, p1) - _weighted_log(c2 - c12, n - c1, p2))
    return F.when((n > c1) & (n > c2), -2.0 * score).otherwise(F.lit(0.0))


def top_collocations(df: DataFrame, stopwords: Iterable[str], n: int = 200, threshold: float = 30.0, text: str = TEXT) -> DataFrame:
    """(term, is_pair, count, score): the n most frequent words and word pairs (ties by term).

    Neighbouring words, neither of them a stop word, are a term of their own
    where their G2 exceeds ``threshold``; both words then lose the pair's
    occurrences, and words with none left go. ``score`` is NULL for words. A
    lower-cased word counts everywhere, stop words nowhere. Words and pairs are
    counted in one pass, a row per word with its next one, added up inside each
    task before the shuffle and stored: what follows reads the counts, not the
    texts. Stop words leave the counted vocabulary, not every token."""
    counted = cut_lineage(word_windows(df, 2, text).groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")))
    stops = [w.lower() for w in stopwords]
    counted = remove_words(counted, stops, "w1")
    single = cut_lineage(counted.groupBy(F.col("w1").alias("word")).agg(F.sum("c").alias("c")))
    double = remove_words(counted.filter("w2 IS NOT NULL"), stops, "w2")
    total = single.agg(F.sum("c").alias("n"))
    scored = (double.join(single.select(F.col("word").alias("w1"), F.col("c").alias("c1")), "w1")
              .join(single.select(F.col("word").alias("w2"), F.col("c").alias("c2")), "w2")
              .crossJoin(F.broadcast(total))  # one row
              .withColumn("score", likelihood_ratio(F.col("c"), F.col("c1"), F.col("c2"), F.col("n"))).filter(F.col("score") > threshold))
    scored = cut_lineage(scored)
    lost = (scored.select(F.explode(F.array("w1", "w2")).alias("word"), "c").groupBy("word").agg(F.sum("c").alias("lost")))
    words = (single.join(lost, "word", "left").select(F.col("word").alias("term"), F.lit(False).alias("is_pair"),
                                                      (F.col("c") - F.coalesce("lost", F.lit(0))).alias("count"),
                                                      F.lit(None).cast("double").alias("score")).filter("count > 0"))
    terms = words.unionByName(scored.select(F.concat_ws(" ", "w1", "w2").alias("term"), F.lit(True).alias("is_pair"), F.col("c").alias("count"), "score"))
    return terms.orderBy(F.desc("count"), F.asc("term")).limit(n)


def tag_tokens(df: DataFrame, tag_lexicon: DataFrame, default: str = DEFAULT_TAG,
               text: str = TEXT, key: str = COMMENT_ID) -> DataFrame:
    """(comment_id, pos, token, tag): lexicon tag, else ``default``."""
    toks = token_table(df, text, key, lower=True)
    lex = tag_lexicon.select("token", "tag")
    return (toks.join(small_side(lex), "token", "left")
            .select(key, "pos", "token", F.coalesce(F.col("tag"), F.lit(default)).alias("tag")))


def np_chunks(df: DataFrame, tag_lexicon: DataFrame, default: str = DEFAULT_TAG,
              pattern: str = NP_TAG_PATTERN, text: str = TEXT, key: str = COMMENT_ID) -> DataFrame:
    """Noun-phrase chunks per comment: (comment_id, chunk_no, chunk) where
    ``chunk`` is the matched tag sequence, e.g. '<DT><JJ><NN>'.

    Each comment's tags are matched greedily left to right in the order of
    its tokens. The tag lexicon is a constant table (see ``constant_lookup``),
    so nothing is shuffled; a token given two tags is an error."""
    base = _tagged(df, tag_lexicon, default, text, key).select(key, F.array_join(_bracketed(F.col("_tags")), "").alias("_line"))
    chunks = F.regexp_extract_all(F.col("_line"), F.lit(pattern), 0)
    return base.select(F.col(key), F.posexplode(chunks).alias("chunk_no", "chunk"))


def _tagged(df: DataFrame, tag_lexicon: DataFrame, default: str, text: str, key: str) -> DataFrame:
    """(comment_id, _toks, _tags): the lower-cased tokens and their tags, found once per row."""
    entry = constant_lookup(tag_lexicon.select(F.col("token").cast("string").alias("token"), "tag"), "token")
    toks = with_tokens(df.select(key, text), text).select(key, "_toks")
    tags = F.transform(F.col("_toks"), lambda t: F.coalesce(entry(t)["tag"], F.lit(default)))
    return toks.select(key, "_toks", F.inline(F.array(F.struct(tags.alias("_tags")))))


def _bracketed(tags):
    return F.transform(tags, lambda t: F.concat(F.lit("<"), t, F.lit(">")))


def np_chunk_words(df: DataFrame, tag_lexicon: DataFrame, default: str = DEFAULT_TAG,
                   pattern: str = NP_TAG_PATTERN, text: str = TEXT, key: str = COMMENT_ID) -> DataFrame:
    """(comment_id, chunk_no, start, words, tags, tagged): each noun-phrase chunk with its words.

    ``start`` is the number of its first token (from 0), ``words`` and ``tags``
    are arrays, ``tagged`` reads 'detail/JJ assure/NN'. The matches of the
    pattern on the row's tag string are marked where they begin and end; cut
    at the closing brackets the string falls into one piece per token, so a
    mark's piece number is its token's place. A match holds one tag or more; a
    tag holds neither brackets nor control characters. Nothing is shuffled."""
    first, last = "\x01", "\x02"
    tagged = _tagged(df, tag_lexicon, default, text, key)
    marked = F.regexp_replace(F.array_join(_bracketed(F.col("_tags")), ""), f"({pattern})", f"{first}$1{last}")
    parts = tagged.select(key, "_toks", "_tags", F.inline(F.array(F.struct(F.split(marked, ">", -1).alias("_parts")))))
    # Where pieces begin with a mark: the first token of a chunk, and the one after its last.
    at = F.sequence(F.lit(0), F.size("_parts") - 1)
    starts = F.filter(at, lambda i: F.contains(F.get("_parts", i), F.lit(first)))
    ends = F.filter(at, lambda i: F.startswith(F.get("_parts", i), F.lit(last)))
    out = parts.select(key, "_toks", "_tags", F.posexplode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("chunk_no", "_c"))
    size = F.col("_c.e") - F.col("_c.s")
    words, tags = (F.slice(c, F.col("_c.s") + 1, size) for c in ("_toks", "_tags"))
    return out.select(key, "chunk_no", F.col("_c.s").alias("start"), words.alias("words"), tags.alias("tags"),
                      F.array_join(F.zip_with(words, tags, lambda w, t: F.concat_ws("/", w, t)), " ").alias("tagged"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """How often each chunk shape occurs, and its length in tokens."""
    return (chunks.groupBy("chunk")
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("n_tokens", F.size(F.split(F.col("chunk"), "><")).cast("int")))
