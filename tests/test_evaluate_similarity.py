import numpy as np
import pytest

from murmur.operators import evaluate, similarity


def test_published_matrix_report(spark):
    rows = ([("1", "1")] * 184 + [("1", "2")] * 65 + [("2", "1")] * 90 + [("2", "2")] * 193)
    df = spark.createDataFrame(rows, "label string, prediction string")
    rep = {r["class"]: r for r in evaluate.classification_report(df, ["1", "2"]).collect()}
    assert round(rep["1"]["precision"], 2) == 0.67 and round(rep["2"]["precision"], 2) == 0.75
    assert round(rep["1"]["recall"], 2) == 0.74 and round(rep["2"]["recall"], 2) == 0.68
    assert round(rep["1"]["f1"], 2) == 0.70 and round(rep["2"]["f1"], 2) == 0.71
    assert round(rep["accuracy"]["f1"], 2) == 0.71 and rep["accuracy"]["support"] == 532
    assert (rep["1"]["support"], rep["2"]["support"]) == (249, 283)
    cm = {r["label"]: (r["1"], r["2"]) for r in evaluate.confusion_matrix(df, ["1", "2"]).collect()}
    assert cm == {"1": (184, 65), "2": (90, 193)}
    assert evaluate.accuracy(df).first()["accuracy"] == round(377 / 532, 6)


def test_similarity_pairs(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(12, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)],
                               "vec_id long, embedding array<float>")
    out = similarity.similarity_pairs(df, 10, seed=0).collect()
    assert len(out) == 45 and all(r["i"] > r["j"] for r in out)
    v32 = v.astype(np.float32).astype(np.float64)
    for r in out:
        assert abs(r["inner_product"] - float(v32[r["key_i"]] @ v32[r["key_j"]])) < 1e-6
        assert 0.0 <= r["shown"] <= 1.0
    with pytest.raises(ValueError):
        similarity.similarity_pairs(df.limit(5), 10)


def test_embed_hook_unit_vectors(spark):
    df = spark.createDataFrame([(1, "good film"), (2, None)], "comment_id long, commentText string")
    rows = similarity.embed(df, dim=16).collect()
    assert len(rows[0]["embedding"]) == 16
    assert abs(np.linalg.norm(rows[0]["embedding"]) - 1) < 1e-5


def test_missing_predictions_are_wrong_and_every_label_has_a_row(spark):
    df = spark.createDataFrame([("1", "1"), ("1", None)], "label string, prediction string")
    assert tuple(evaluate.accuracy(df).first()) == (2, 0.5)
    rows = sorted(tuple(r) for r in evaluate.confusion_matrix(df, ["1", "2"]).collect())
    assert rows == [("1", 1, 0), ("2", 0, 0)]


def test_default_embedding_is_a_unit_vector(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "commentText string")
    got = [r["embedding"] for r in similarity.embed(df, dim=16).collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-6 and len(got[0]) == 16
    assert got[1] == got[2] == [0.0] * 16
