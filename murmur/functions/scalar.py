"""Column -> Column helpers. All are built-in Spark expressions (codegen'd)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_away(c, places: int = 2) -> Column:
    """Round half away from zero: sign(x) * floor(|x| * 10^p + 0.5) / 10^p.

    Written out so that Spark and SQL engines compute the same IEEE steps;
    the built-in ``round`` functions of different engines disagree on ties.
    """
    c = _c(c)
    scale = float(10 ** places)
    return F.signum(c) * F.floor(F.abs(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def sentiment_bucket(polarity) -> Column:
    """-1 / 0 / 1 by the sign of the (already rounded) polarity."""
    return F.signum(_c(polarity)).cast("int")


def log2_or_neg_inf(c) -> Column:
    """Base-2 log with log2(0) = -inf (Spark's ``log2(0)`` is NULL)."""
    c = _c(c)
    return F.when(c == 0, F.lit(float("-inf"))).otherwise(F.log2(c))


def views_bucket(views, threshold_log2: int = 20) -> Column:
    """'1' below 2^t views, '2' above, missing at exactly 2^t.

    Compared on the raw count, so there is no floating-point edge and a
    count of 0 (log2 = -inf) lands in '1'.
    """
    v = _c(views)
    edge = 2 ** threshold_log2
    return F.when(v < edge, F.lit("1")).when(v > edge, F.lit("2"))


def bucket_by(c, thresholds: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Right-closed buckets: c <= t0 -> labels[0], (t0, t1] -> labels[1] ... > t_last -> last.

    NULL input gives NULL.
    """
    c = _c(c)
    labels = list(labels) if labels is not None else [str(i + 1) for i in range(len(thresholds) + 1)]
    if len(labels) != len(thresholds) + 1:
        raise ValueError("need one more label than thresholds")
    expr = None
    for t, lab in zip(thresholds, labels):
        expr = F.when(c <= t, F.lit(lab)) if expr is None else expr.when(c <= t, F.lit(lab))
    return expr.when(c.isNotNull(), F.lit(labels[-1]))


def views_bucket4(views, edges_log2: Sequence[int] = (18, 20, 22)) -> Column:
    """Four views labels on log2 edges, evaluated on the raw count."""
    return bucket_by(views, [2 ** e for e in edges_log2])


def quote(c) -> Column:
    """Wrap text in double quotes; missing stays missing."""
    return F.concat(F.lit('"'), _c(c), F.lit('"'))


def md5_key(key, seed) -> Column:
    """Hex md5 of 'key|seed': a seeded, partition-independent random order."""
    return F.md5(F.concat(_c(key).cast("string"), F.lit("|"), F.lit(str(seed))))


def md5_bucket(key, seed, modulo: int = 100) -> Column:
    """First 32 bits of md5('key|seed') as a number, modulo ``modulo``."""
    head = F.substring(md5_key(key, seed), 1, 8)
    return (F.conv(head, 16, 10).cast("long") % F.lit(modulo)).cast("int")


def nullif_blank(c) -> Column:
    """Blank or whitespace-only string -> NULL."""
    c = _c(c)
    return F.when(F.trim(c) == "", F.lit(None).cast("string")).otherwise(c)
