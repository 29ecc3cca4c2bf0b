import pytest
from pyspark.sql import functions as F

from murmur.plans import reports
from murmur.sources import fixtures as fx

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return reports.tables_from_fixtures(spark, SF)


def test_channel_cluster_report(spark, tables):
    r = reports.channel_cluster_report(tables, "ch1", 1, 3, 0, starts=3)
    assert {"scored", "centres", "profile", "selected", "trigram_count", "trigram_slice", "chunks",
            "top_words", "similarity"} <= set(r)
    prof = r["profile"].collect()
    assert len(prof) <= 3 and sum(p["n_comments"] for p in prof) == r["scored"].count()
    assert r["selected"].filter(F.col("clusters") != 0).count() == 0
    assert r["similarity"] is None or r["similarity"].count() == 45
    with pytest.raises(ValueError):
        reports.channel_cluster_report(tables, "ch1", 1, 3, 7, starts=1)


def test_registered_cluster_report_has_all_parts(spark, tables):
    from murmur.operators import text
    from murmur.plans import catalog

    seen = {}
    made = reports.channel_cluster_report

    def keep(*a, **b):
        seen.update(made(*a, **b, starts=2))
        return seen

    with pytest.MonkeyPatch.context() as m:
        m.setattr(reports, "channel_cluster_report", keep)
        rows = catalog.QUERIES["channel_cluster_report"](spark, SF).collect()
    part = {p: [r for r in rows if r.part == p] for p in ("profile", "centres", "trigram_count", "trigram_slice", "chunks", "top_words", "similarity")}
    assert sum(map(len, part.values())) == len(rows) and all(part.values())
    selected = seen["selected"]
    grams = sorted(r.gram for r in text.doc_term_counts(selected, 3).select("gram").distinct().collect())
    assert part["trigram_count"][0].n == len(grams)
    assert sorted(r.name for r in part["trigram_slice"]) == grams[400:450]
    assert sum(r.n for r in part["chunks"]) == text.np_chunks(selected, tables["tag_lexicon"]).count()
    words = {(r.token, r.n) for r in text.token_table(selected).groupBy("token").agg(F.count("*").alias("n")).collect()}
    assert len(part["top_words"]) == 200 and {(r.name, r.n) for r in part["top_words"]} <= words
    assert len(part["similarity"]) == 45


def test_channel_elbow_report(spark, tables):
    e = reports.channel_elbow_report(tables, "ch2", 1, ks=range(1, 5), starts=2)["elbow"].orderBy("k").collect()
    w = [r["wcss"] for r in e]
    assert [r["k"] for r in e] == [1, 2, 3, 4] and all(w[i + 1] <= w[i] + 1e-9 for i in range(3))


def test_views_model_report_operations(spark):
    from murmur.operators import features

    t = features.training_table(fx.fx_videos(spark, SF), features.video_features(fx.fx_measures(spark, SF)))
    test = reports.views_model_report(t, "test set")
    rep = {r["class"]: r for r in test["report"].collect()}
    assert {"accuracy", "macro avg", "weighted avg"} <= set(rep)
    assert test["pca"].count() == 2
    cv = reports.views_model_report(t, "cross validation")["cv"].collect()
    assert len(cv) == 8
    with pytest.raises(ValueError):
        reports.views_model_report(t, "bogus")


def test_distribution_report(spark):
    r = reports.distribution_report(fx.fx_scored(spark, SF), "polarity")
    assert r["describe"].count() == 1 and r["kurtosis"].count() == 1
    p = r["pearson"].first()
    assert p["x"] == "polarity" and 0.0 <= p["p_value"] <= 1.0
    assert sum(x["count"] for x in r["histogram"].collect()) == 1000


def test_video_feature_job(spark, tables, tmp_path):
    out = reports.video_feature_job(tables, k=5, starts=2, out_path=str(tmp_path / "feat"))
    assert out.count() == 20 and len(out.columns) == 61


def test_untitled_videos_leave_the_feature_job(spark, tables):
    some = dict(tables, titles=tables["titles"].filter("videoID <> 'src1'"))
    out = reports.video_feature_job(some, k=2, starts=1)
    assert out.filter("videoID = 'src1'").count() == 0 and out.count() == 19
