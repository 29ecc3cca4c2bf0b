"""Projection, filters, joins, distinct, sampling and splits (#8-#12, #23-#33, #41)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.scalar import md5_bucket, md5_key
from murmur.operators.common import small_side
from murmur.operators.rank import ntile_within
from murmur.schemas import CATEGORY_ID, COMMENT_ID, SENTIMENT_BUCKET, VIDEO_ID


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the named columns in the given order; an unknown name fails."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"unknown columns: {missing}")
    return df.select(*cols)


def filter_equals(df: DataFrame, col: str, value) -> DataFrame:
    """Exact, case-sensitive equality (channel, cluster, category)."""
    return df.filter(F.col(col) == F.lit(value))


def filter_sentiment(df: DataFrame, sentiment, col: str = SENTIMENT_BUCKET) -> DataFrame:
    """Keep one sentiment bucket; the user's value is compared as a float."""
    return df.filter(F.col(col).cast("double") == F.lit(float(sentiment)))


def cast_category_id(df: DataFrame, col: str = CATEGORY_ID, strict: bool = True) -> DataFrame:
    """String id -> int. Strict mode fails on a bad value (ANSI cast)."""
    c = F.col(col).cast("int") if strict else F.expr(f"try_cast(`{col}` as int)")
    return df.withColumn(col, c)


def join_categories(comments: DataFrame, categories: DataFrame, key: str = CATEGORY_ID) -> DataFrame:
    """Inner join on the category id; unknown categories drop out.

    The category list is a small dimension: broadcast after a size check.
    """
    return comments.join(small_side(categories), key, "inner")


def join_titles(comments: DataFrame, titles: DataFrame, key: str = VIDEO_ID) -> DataFrame:
    """Inner join on the video id; duplicate titles fan out.

    No hint: AQE broadcasts the titles when they are small at run time and
    otherwise sort-merge joins, splitting skewed videos.
    """
    return titles.join(comments, key, "inner")


def dedupe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows over ``cols`` (all columns when None)."""
    return df.distinct() if cols is None else df.select(*cols).distinct()


def sample_n(df: DataFrame, n: int, key: str = COMMENT_ID, seed=0, exact: bool = False,
             oversample: float = 1.5) -> DataFrame:
    """Seeded sample of ``n`` rows without replacement (all rows if fewer):
    the n rows with the smallest md5('key|seed'), ties by key.

    A plain ``orderBy(...).limit(n)`` merges n rows from *every* input
    partition in one task. Instead the rows are first cut by the md5 prefix
    to an expected ``oversample * n`` candidates (the cut is monotone in the
    sort key, so the candidates are always a prefix of the full order; if
    fewer than n pass, the cut is widened), and only those are top-n sorted.
    ``exact=True`` raises when the table has fewer than n rows."""
    total = df.count()
    if exact and total < n:
        raise ValueError(f"need {n} rows to sample, found {total}")
    order = [md5_key(F.col(key), seed), F.col(key)]
    if total <= n:
        return df
    head = F.conv(F.substring(md5_key(F.col(key), seed), 1, 8), 16, 10).cast("long")
    frac = min(1.0, oversample * n / total + 64.0 / total)
    while True:
        cut = int(frac * (1 << 32))
        # A missing key sorts first, so it is a candidate at every cut.
        cand = df.filter((head < F.lit(cut)) | head.isNull()) if frac < 1.0 else df
        if frac >= 1.0 or cand.count() >= n:
            return cand.orderBy(*order).limit(n)
        frac = min(1.0, frac * 2)


def first_n(df: DataFrame, n: int | None, key: str = COMMENT_ID) -> DataFrame:
    """The first n rows in key order (``None`` = all rows)."""
    return df if n is None else df.orderBy(F.col(key)).limit(n)


def split_bucket(df: DataFrame, key: str = VIDEO_ID, seed: int = 1,
                 bounds: tuple[int, int] = (60, 80), col: str = "split") -> DataFrame:
    """train / validation / test by a hash bucket of the key (60/20/20).

    Stable when rows are added and independent of partitioning.
    """
    b = md5_bucket(F.col(key), seed)
    lo, hi = bounds
    return df.withColumn(col, F.when(b < lo, "train").when(b < hi, "validation").otherwise("test"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 8, col: str = "fold") -> DataFrame:
    """Unshuffled stratified folds: within each label, rows in key order are
    cut into k contiguous blocks whose sizes differ by at most one."""
    return ntile_within(df, [label], key, k, col=col)


def count_by(df: DataFrame, col: str) -> DataFrame:
    """Rows per value of ``col`` for all values at once."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n_comments"))
