"""Lexicon sentiment: polarity and subjectivity of each comment in one pass.

Contract (kept from the reference): polarity in [-1, 1], subjectivity in
[0, 1], both rounded to 2 places half away from zero, 0 when nothing in the
text can be scored, and a -1/0/1 bucket taken from the rounded polarity.

The lexicon (word, polarity, subjectivity) is supplied by the caller. A
comment's score is the mean over its lower-cased word tokens that appear in
the lexicon (every occurrence counts). Lexicon values are used as integer
thousandths, so the sum is exact and the result is independent of the
order in which Spark adds values.

Plan: the lexicon becomes a constant table of small maps picked by the
word's hash, and every comment is scored in place with array functions: one
narrow stage for any lexicon size, no shuffle, no Python, and a cost per
token that does not grow with the lexicon. Each row is scored on its own, so
repeated comment ids never merge. A word given twice or missing is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.scalar import sentiment_bucket
from murmur.functions.text import tokens_lower
from murmur.operators.common import MAX_LEXICON_WORDS, constant_lookup
from murmur.schemas import POLARITY, SENTIMENT_BUCKET, SUBJECTIVITY, TEXT


def _milli(c):
    return F.round(c * F.lit(1000.0)).cast("long")


def mean_milli_to_2dp(total, n):
    """mean = total / n (thousandths) -> value rounded to 2 places, 0 if n = 0."""
    x = F.try_divide(total.cast("double"), n.cast("double"))
    r = F.signum(x) * F.floor(F.abs(x) / F.lit(10.0) + F.lit(0.5)) / F.lit(100.0)
    # n = 0 -> 0; also maps -0.0 to 0.0
    return F.when((n > 0) & (r != 0), r).otherwise(F.lit(0.0))


def score_sentiment(df: DataFrame, lexicon: DataFrame, text: str = TEXT,
                    max_words: int = MAX_LEXICON_WORDS) -> DataFrame:
    """Add ``polarity``, ``subjectivity`` and ``sentimentBucket`` columns.

    A lexicon of more than ``max_words`` words raises ValueError."""
    lex = lexicon.select(F.col("word").cast("string").alias("word"),
                         _milli(F.col(POLARITY)).alias("p"), _milli(F.col(SUBJECTIVITY)).alias("s"))
    entry = constant_lookup(lex, "word", max_words)
    found = F.filter(F.transform(tokens_lower(F.col(text)), entry), lambda x: x.isNotNull())

    def sums(hits):
        def total(name):
            return F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a + x[name])
        return F.struct(F.size(hits).alias("_n"), total("p").alias("_p"), total("s").alias("_s"))

    # Through a one-row generator: filters on the scores cannot be pushed
    # below it, so the token regex runs exactly once per comment.
    scored = df.select("*", F.inline(F.transform(F.array(found), sums)))
    n = F.col("_n")
    out = (scored.withColumn(POLARITY, mean_milli_to_2dp(F.col("_p"), n))
           .withColumn(SUBJECTIVITY, mean_milli_to_2dp(F.col("_s"), n)).drop("_n", "_p", "_s"))
    return out.withColumn(SENTIMENT_BUCKET, sentiment_bucket(F.col(POLARITY)))


#: What a negated word's polarity is multiplied by (a fixed value of the scoring rule).
NEGATED = -0.5


def score_phrases(df: DataFrame, lexicon: DataFrame, text: str = TEXT, max_words: int = MAX_LEXICON_WORDS) -> DataFrame:
    """Add ``polarity``, ``subjectivity`` and ``sentimentBucket`` from a lexicon of phrases and modifiers.

    ``lexicon`` has (phrase, polarity, subjectivity, intensity, negates): a
    phrase is one or more lower-cased words joined by one space. From left to
    right the longest phrase that begins at a word is taken, and its words are
    used up. One that negates turns the next scored phrase (polarity times
    ``NEGATED``); one with an intensity but no polarity multiplies the next
    scored phrase's values, and intensities in a row multiply; one with a
    polarity is scored, with both limited to their range, and its own
    intensity (if any) then works on the next. A word in no phrase ends what
    negations and intensities there are. Scores are means over scored phrases,
    rounded to 2 places; a null or empty text has 0.

    One narrow stage: a constant table says which words begin a phrase and how
    many words it may have; only there are phrases looked for, and a fold over
    those found carries the state. Values are whole thousandths, so sums are exact.
    """
    lex = lexicon.select(F.col("phrase").cast("string").alias("phrase"), _milli(F.col(POLARITY)).alias("p"),
                         _milli(F.coalesce(F.col(SUBJECTIVITY), F.lit(0.0))).alias("s"), F.col("intensity").cast("double").alias("x"),
                         F.coalesce("negates", F.lit(False)).alias("neg"), F.size(F.split("phrase", " ")).alias("n"))
    longest = lex.agg(F.max("n")).first()[0] or 1
    entry = constant_lookup(lex, "phrase", max_words)
    head = constant_lookup(lex.groupBy(F.split("phrase", " ")[0].alias("word")).agg(F.max("n").alias("most")), "word", max_words)

    def matches(toks):
        """The places where phrases begin, in order, each with the entry of the longest one."""
        def longest_at(t, i):
            def found(n):
                if n == 1:
                    return entry(t)
                words = [t, *[F.get(toks, i + j) for j in range(1, n)]]
                whole = F.transform(F.array(F.concat_ws(" ", *words)), entry)[0]
                return F.when((head(t)["most"] >= n) & words[-1].isNotNull(), whole)
            return F.when(head(t).isNotNull(), F.struct(i.alias("at"), F.coalesce(*[found(n) for n in range(longest, 0, -1)]).alias("e")))
        return F.filter(F.transform(toks, longest_at), lambda m: m["e"].isNotNull())

    # The state: the first word that no taken phrase uses, and what modifiers and sums there are.
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("next"), F.lit(1.0).alias("x"), F.lit(False).alias("neg"), zero.alias("p"), zero.alias("s"), zero.alias("n"))

    def step(a, m):
        e = m["e"]
        scored = e["p"].isNotNull()
        # Words lie between: they are in no phrase and end the modifiers.
        apart = m["at"] > a["next"]
        x = F.when(apart, F.lit(1.0)).otherwise(a["x"])
        neg = ~apart & a["neg"]
        flip = F.when(neg, F.lit(NEGATED)).otherwise(F.lit(1.0))

        def part(value, least):
            return F.transform(F.array(F.greatest(F.lit(least), F.least(F.lit(1000.0), value))),
                               lambda y: (F.signum(y) * F.floor(F.abs(y) + F.lit(0.5))).cast("long"))[0]

        taken = F.struct(
            (m["at"] + e["n"]).alias("next"),
            (F.when(scored, F.lit(1.0)).otherwise(x) * F.coalesce(e["x"], F.lit(1.0))).alias("x"),
            (~scored & (neg | e["neg"])).alias("neg"),
            (a["p"] + F.when(scored, part(e["p"].cast("double") * x * flip, -1000.0)).otherwise(zero)).alias("p"),
            (a["s"] + F.when(scored, part(e["s"].cast("double") * x, 0.0)).otherwise(zero)).alias("s"),
            (a["n"] + F.when(scored, 1).otherwise(0)).alias("n"))
        return F.when(m["at"] < a["next"], a).otherwise(taken)

    held = df.select("*", F.inline(F.array(F.struct(tokens_lower(F.col(text)).alias("_toks")))))
    found = held.select("*", F.inline(F.array(F.struct(matches(F.col("_toks")).alias("_found"))))).drop("_toks")
    folded = F.aggregate("_found", start, step)
    scored = found.select("*", F.inline(F.transform(F.array(folded), lambda a: F.struct(a["p"].alias("_p"), a["s"].alias("_s"), a["n"].alias("_n"))))).drop("_found")
    n = F.col("_n")
    out = (scored.withColumn(POLARITY, mean_milli_to_2dp(F.col("_p"), n))
           .withColumn(SUBJECTIVITY, mean_milli_to_2dp(F.col("_s"), n)).drop("_n", "_p", "_s"))
    return out.withColumn(SENTIMENT_BUCKET, sentiment_bucket(F.col(POLARITY)))


def exact_mean(col: str, decimals: int = 2):
    """Mean of a column holding values with ``decimals`` places, as an
    aggregate: the values are summed as exact integers and divided once, so
    the result does not depend on the order in which rows are added."""
    scale = float(10 ** decimals)
    total = F.sum(F.round(F.col(col) * F.lit(scale)).cast("long")).cast("double")
    return F.try_divide(total, F.count(F.col(col)).cast("double")) / F.lit(scale)


def sentiment_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """Comments and mean scores per group (map-side partial aggregation).
    Means are exact (2-decimal scores) and rounded half away from zero."""
    from murmur.functions.scalar import round_half_away

    return (scored.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n_comments"),
                 round_half_away(exact_mean(POLARITY), 6).alias("avg_polarity"),
                 round_half_away(exact_mean(SUBJECTIVITY), 6).alias("avg_subjectivity")))
