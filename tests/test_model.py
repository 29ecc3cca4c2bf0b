import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from murmur.operators import model


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 240
    z = rng.normal(size=(n, 2))
    x = np.column_stack([z[:, 0] * 3, z[:, 0] + z[:, 1], z[:, 1] * 2, rng.normal(size=n) * 0.1])
    y = np.where(z[:, 0] + 0.5 * rng.normal(size=n) > 0, "2", "1")
    rows = [(str(i), *map(float, x[i]), y[i]) for i in range(n)]
    return spark.createDataFrame(rows, "videoID string, f1 double, f2 double, f3 double, f4 double, viewsBucket string")


def test_pca_matches_numpy_svd(spark, table):
    cols = ["f1", "f2", "f3", "f4"]
    m = model.fit_views_model(table, cols)
    pdf = table.toPandas()
    x = pdf[cols].to_numpy()
    xc = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(xc, full_matrices=False)
    ratio = s ** 2 / (s ** 2).sum()
    summ = {r["component"]: r for r in model.pca_summary(m, table, cols).collect()}
    assert abs(summ[1]["explained_variance_ratio"] - ratio[0]) < 1e-6
    assert abs(summ[2]["singular_value"] - s[1]) < 1e-4
    sc = model.pca_scores(m, table).toPandas().sort_values("videoID", key=lambda k: k.astype(int))
    ref = xc @ vt[:2].T
    for j in range(2):
        col = ref[:, j] * np.sign(vt[j][np.argmax(np.abs(vt[j]))])
        assert np.allclose(sc[f"pc{j + 1}"].to_numpy(), col, atol=1e-6)


def test_lr_matches_c1_objective(spark, table):
    cols = ["f1", "f2", "f3", "f4"]
    m = model.fit_views_model(table, cols)
    out = m.transform(table).select("label", vector_to_array("pca").alias("z")).toPandas()
    z = np.vstack(out["z"].to_numpy())
    y = out["label"].to_numpy()
    lr = m.stages[-1]
    w, b = lr.coefficients.toArray(), lr.intercept
    p = 1 / (1 + np.exp(-(z @ w + b)))
    grad_w = w + z.T @ (p - y)
    grad_b = (p - y).sum()
    assert np.abs(grad_w).max() < 1e-3 and abs(grad_b) < 1e-3


def test_cross_validation_and_roundtrip(spark, table, tmp_path):
    cols = ["f1", "f2", "f3", "f4"]
    cv = model.cross_validate(table, 8, cols).collect()
    assert len(cv) == 8 and sum(r["n"] for r in cv) == table.count()
    m = model.fit_views_model(table, cols)
    path = str(tmp_path / "m")
    from murmur.sources import io

    io.save_model(m, path)
    a = model.predictions(m, table).orderBy("videoID").collect()
    b = model.predictions(io.load_model(path), table).orderBy("videoID").collect()
    assert a == b


def test_pca_variance2_equals_ml(spark, table):
    cols = ["f1", "f2"]
    m = model.fit_views_model(table, cols)
    a = {r["component"]: r for r in model.pca_summary(m, table, cols).collect()}
    b = {r["component"]: r for r in model.pca_variance2(table, "f1", "f2").collect()}
    for k in (1, 2):
        assert abs(a[k]["explained_variance_ratio"] - b[k]["explained_variance_ratio"]) < 1e-6
        assert abs(a[k]["singular_value"] - b[k]["singular_value"]) < 1e-4


def _plain_fit(x, y, components=2, c=1.0):
    """Centred PCA by SVD, then the penalised logistic regression by Newton's steps: a function from features to labels 0/1."""
    mean = x.mean(axis=0)
    vt = np.linalg.svd(x - mean, full_matrices=False)[2][:components]
    z = np.column_stack([(x - mean) @ vt.T, np.ones(len(x))])
    penalty = np.diag([1.0] * components + [0.0])
    w = np.zeros(components + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        gradient = c * z.T @ (p - y) + penalty @ w
        w = w - np.linalg.solve(c * (z * (p * (1 - p))[:, None]).T @ z + penalty, gradient)
    assert np.abs(gradient).max() < 1e-8
    return lambda rows: (np.column_stack([(rows - mean) @ vt.T, np.ones(len(rows))]) @ w > 0).astype(int)


def test_cross_validated_accuracies_equal_an_independent_fit(spark, table):
    """Every fold's accuracy, and a held-out part's, against numpy: no accuracy comes from the library alone."""
    from murmur.operators.prepare import stratified_folds

    cols = ["f1", "f2", "f3", "f4"]
    folded = stratified_folds(table, "viewsBucket", "videoID", 8).toPandas()
    x, y, fold = folded[cols].to_numpy(), (folded["viewsBucket"] == "2").to_numpy().astype(int), folded["fold"].to_numpy()
    want = {f: float((_plain_fit(x[fold != f], y[fold != f])(x[fold == f]) == y[fold == f]).mean()) for f in range(1, 9)}
    got = {r["fold"]: r["accuracy"] for r in model.cross_validate(table, 8, cols).collect()}
    assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-12 for f in want) and min(want.values()) > 0.5
    m = model.fit_views_model(table.filter("cast(videoID as int) % 4 > 0"), cols)
    rest = table.filter("cast(videoID as int) % 4 = 0")
    pdf = table.toPandas()
    held = pdf["videoID"].astype(int) % 4 == 0
    plain = _plain_fit(pdf[cols][~held].to_numpy(), (pdf["viewsBucket"] == "2")[~held].to_numpy().astype(int))(pdf[cols][held].to_numpy())
    mine = {r.videoID: r.prediction for r in model.predictions(m, rest).collect()}
    assert [mine[v] for v in pdf["videoID"][held]] == ["2" if p else "1" for p in plain]
