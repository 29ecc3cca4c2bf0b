"""Scoring a labelled prediction table (#71-#73): one aggregation each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of rows whose prediction equals the label; a missing one is wrong."""
    hit = F.coalesce(F.col(label) == F.col(prediction), F.lit(False)).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 6).alias("accuracy"))


def confusion_matrix(df: DataFrame, labels: Sequence[str], label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """Rows = true label (every one of ``labels``), one column per predicted
    label (sorted), counts."""
    labels = sorted(labels)
    counted = df.groupBy(F.col(label).alias("_true")).pivot(prediction, labels).count()
    all_labels = df.sparkSession.createDataFrame([(x,) for x in labels], f"{label} string")
    return (all_labels.join(counted, F.col(label) == F.col("_true"), "left").drop("_true")
            .fillna(0, subset=labels))


def classification_report(df: DataFrame, labels: Sequence[str], label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """Per label precision, recall, F1 and support, then the accuracy,
    macro-average and support-weighted average rows; 0 for an empty
    denominator."""
    labels = sorted(labels)
    aggs = [F.count(F.lit(1)).alias("_total"),
            F.sum((F.col(label) == F.col(prediction)).cast("long")).alias("_hits")]
    for i, lab in enumerate(labels):
        aggs += [
            F.sum(((F.col(label) == lab) & (F.col(prediction) == lab)).cast("long")).alias(f"_tp{i}"),
            F.sum((F.col(label) == lab).cast("long")).alias(f"_sup{i}"),
            F.sum((F.col(prediction) == lab).cast("long")).alias(f"_pred{i}"),
        ]
    counts = df.agg(*aggs)

    def ratio(a, b):
        return F.when(b > 0, F.try_divide(a.cast("double"), b.cast("double"))).otherwise(F.lit(0.0))

    per = []
    for i, lab in enumerate(labels):
        tp, sup, pred = F.col(f"_tp{i}"), F.col(f"_sup{i}"), F.col(f"_pred{i}")
        p, r = ratio(tp, pred), ratio(tp, sup)
        f1 = F.when(p + r > 0, F.try_divide(2 * p * r, p + r)).otherwise(F.lit(0.0))
        per.append((F.lit(lab), p, r, f1, sup))
    n = len(labels)
    total = F.col("_total")
    macro = [sum((x[k] for x in per), F.lit(0.0)) / F.lit(float(n)) for k in (1, 2, 3)]
    weighted = [ratio(sum((x[k] * x[4] for x in per), F.lit(0.0)), total) for k in (1, 2, 3)]
    acc = ratio(F.col("_hits"), total)
    rows = [*per,
            (F.lit("accuracy"), F.lit(None).cast("double"), F.lit(None).cast("double"), acc, total),
            (F.lit("macro avg"), *macro, total),
            (F.lit("weighted avg"), *weighted, total)]
    arr = F.array(*[F.struct(c.alias("class"), p.alias("precision"), r.alias("recall"),
                             f.alias("f1"), s.cast("long").alias("support"))
                    for c, p, r, f, s in rows])
    out = counts.select(F.explode(arr).alias("x")).select("x.*")
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")
