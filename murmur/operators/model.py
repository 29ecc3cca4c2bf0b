"""Views model (#6, #66-#70): centred PCA to 2 components, then logistic
regression on the components, all as one Spark ML Pipeline.

* Centring: scikit-learn's PCA centres the data; Spark's PCA transform
  does not, so a mean-only StandardScaler comes first.
* Logistic regression: scikit-learn's default minimises
  0.5 * |w|^2 + C * sum(logloss) with C = 1 and an unpenalised intercept.
  Spark minimises mean(logloss) + regParam/2 * |w|^2, so regParam = C/n
  with standardization off gives the same optimum.
* Cross validation fits the whole pipeline (PCA included) per fold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators.prepare import split_bucket, stratified_folds
from murmur.schemas import VIDEO_ID, VIEWS_BUCKET


def feature_columns(df: DataFrame, key: str = VIDEO_ID, label: str = VIEWS_BUCKET,
                    exclude: Sequence[str] = ("split", "fold")) -> list[str]:
    """Every column but the key, the label and bookkeeping columns."""
    return [c for c in df.columns if c not in (key, label, *exclude)]


def views_pipeline(feature_cols: Sequence[str], n_rows: int, components: int = 2, c: float = 1.0,
                   label: str = VIEWS_BUCKET):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler

    if n_rows <= 0:
        raise ValueError("no training rows")
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=list(feature_cols), outputCol="_raw"),
        StandardScaler(withMean=True, withStd=False, inputCol="_raw", outputCol="_centred"),
        PCA(k=components, inputCol="_centred", outputCol="pca"),
        LogisticRegression(featuresCol="pca", labelCol="label", regParam=c / n_rows,
                           elasticNetParam=0.0, standardization=False, tol=1e-9, maxIter=500),
    ])


def fit_views_model(train: DataFrame, feature_cols: Sequence[str] | None = None, components: int = 2,
                    c: float = 1.0):
    cols = list(feature_cols) if feature_cols else feature_columns(train)
    n = train.count()
    return views_pipeline(cols, n, components, c).fit(train)


def label_names(model) -> list[str]:
    return list(model.stages[0].labels)


def predictions(model, df: DataFrame, key: str = VIDEO_ID) -> DataFrame:
    """(key, true label, predicted label) as the original label strings."""
    labels = label_names(model)
    out = model.transform(df)
    pred = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
    return out.select(F.col(key), F.col(VIEWS_BUCKET).alias("label"), pred.alias("prediction"))


def component_signs(model) -> list[float]:
    """+1/-1 per component so that its largest-magnitude loading is positive."""
    pc = model.stages[3].pc.toArray()
    signs = []
    for j in range(pc.shape[1]):
        col = pc[:, j]
        signs.append(1.0 if col[np.argmax(np.abs(col))] >= 0 else -1.0)
    return signs


def pca_scores(model, df: DataFrame, key: str = VIDEO_ID) -> DataFrame:
    """(key, pc1, pc2, ...) with the sign rule applied."""
    from pyspark.ml.functions import vector_to_array

    signs = component_signs(model)
    out = model.transform(df).select(F.col(key), vector_to_array("pca").alias("_v"))
    return out.select(F.col(key), *[(F.col("_v")[i] * F.lit(s)).alias(f"pc{i + 1}") for i, s in enumerate(signs)])


def pca_summary(model, train: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """Explained variance ratio and singular value per component.

    singular value = sqrt(ratio * total variance * (n - 1)), the value
    numpy's SVD of the centred matrix gives."""
    ratios = [float(x) for x in model.stages[3].explainedVariance.toArray()]
    tot = train.agg(F.count(F.lit(1)).alias("n"),
                    *[F.var_samp(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(feature_cols)])
    total_var = sum(F.coalesce(F.col(f"v{i}"), F.lit(0.0)) for i in range(len(feature_cols)))
    arr = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(r).alias("explained_variance_ratio"))
                    for i, r in enumerate(ratios)])
    return (tot.select(F.explode(arr).alias("x"), total_var.alias("tv"), "n")
            .select("x.component", F.round("x.explained_variance_ratio", 6).alias("explained_variance_ratio"),
                    F.round(F.sqrt(F.col("x.explained_variance_ratio") * F.col("tv") * (F.col("n") - 1)), 6)
                    .alias("singular_value")))


def pca_variance2(df: DataFrame, x: str, y: str) -> DataFrame:
    """Closed-form 2-feature PCA: explained variance ratio and singular
    value of both components from one covariance aggregation."""
    a, b, c = F.var_samp(x), F.covar_samp(x, y), F.var_samp(y)
    m = df.agg(F.count(F.lit(1)).alias("n"), a.alias("a"), b.alias("b"), c.alias("c"))
    half = (F.col("a") + F.col("c")) / 2
    rad = F.sqrt(((F.col("a") - F.col("c")) / 2) * ((F.col("a") - F.col("c")) / 2) + F.col("b") * F.col("b"))
    lam = F.array(F.struct(F.lit(1).alias("component"), (half + rad).alias("lam")),
                  F.struct(F.lit(2).alias("component"), (half - rad).alias("lam")))
    tot = F.col("a") + F.col("c")
    return (m.select("n", tot.alias("tot"), F.explode(lam).alias("x"))
            .select("x.component",
                    F.round(F.try_divide(F.col("x.lam"), F.col("tot")), 6).alias("explained_variance_ratio"),
                    F.round(F.sqrt(F.greatest(F.col("x.lam"), F.lit(0.0)) * (F.col("n") - 1)), 6)
                    .alias("singular_value")))


def cross_validate(train: DataFrame, k: int = 8, feature_cols: Sequence[str] | None = None,
                   key: str = VIDEO_ID, components: int = 2, c: float = 1.0,
                   parallelism: int = 4) -> DataFrame:
    """k stratified folds; per fold the whole pipeline is fitted on the
    other folds and scored on it. Result: (fold, n, accuracy).

    Folds are fitted from ``parallelism`` driver threads at once (as Spark
    ML's CrossValidator does), so their small jobs share the cluster."""
    from concurrent.futures import ThreadPoolExecutor

    from murmur.session import cut_lineage

    cols = list(feature_cols) if feature_cols else feature_columns(train)
    folded = cut_lineage(stratified_folds(train, VIEWS_BUCKET, key, k))

    def one(f: int):
        tr = folded.filter(F.col("fold") != f)
        te = folded.filter(F.col("fold") == f)
        fitted = views_pipeline(cols, tr.count(), components, c).fit(tr)
        p = predictions(fitted, te, key)
        r = p.agg(F.count(F.lit(1)).alias("n"),
                  F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("acc")).first()
        return (f, int(r["n"]), float(r["acc"]) if r["acc"] is not None else None)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        rows = list(pool.map(one, range(1, k + 1)))
    return train.sparkSession.createDataFrame(rows, "fold int, n long, accuracy double")


def split_train(table: DataFrame, seed: int = 1, key: str = VIDEO_ID) -> DataFrame:
    return split_bucket(table, key, seed)
