import numpy as np

from murmur.operators import cluster


def _points(spark, n=400, seed=7):
    rng = np.random.default_rng(seed)
    p = np.round(np.concatenate([rng.normal(-0.4, 0.1, n // 2), rng.normal(0.3, 0.1, n - n // 2)]), 2)
    s = np.round(rng.uniform(0, 1, n), 2)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, s))],
                                 "comment_id long, polarity double, subjectivity double")


def test_fewer_points_than_k(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2), (2, 0.1, 0.2), (3, 0.5, 0.5)],
                               "comment_id long, polarity double, subjectivity double")
    # each distinct point is its own centre
    assert cluster.fit_kmeans(df, k=3, starts=1) == ([(0.1, 0.2), (0.5, 0.5)], 0.0)


def test_kmeans_invariants(spark):
    df = _points(spark)
    centres, cost = cluster.fit_kmeans(df, k=3, starts=5, seed=0)
    lab = cluster.assign(df, centres).toPandas()
    x = lab[["polarity", "subjectivity"]].to_numpy()
    c = np.array(centres)
    d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    # every label is the nearest centre, every centre the mean of its points
    assert (d.argmin(axis=1) == lab["clusters"].to_numpy()).all()
    for j in range(3):
        assert np.allclose(x[lab["clusters"] == j].mean(axis=0), c[j], atol=1e-9)
    # weighted cost on grouped points equals cost over raw rows
    assert abs(d.min(axis=1).sum() - cost) < 1e-9
    # best of starts is no worse than any single start
    for s in range(5):
        _, single = cluster.fit_kmeans(df, k=3, starts=1, seed=s)
        assert cost <= single + 1e-12
    # centres are sorted, so labels are repeatable
    assert centres == sorted(centres)


def test_kmeans_partition_independent(spark):
    df = _points(spark, 300, 3)
    a = cluster.fit_kmeans(df.repartition(1), k=4, starts=3, seed=1)
    b = cluster.fit_kmeans(df.repartition(8), k=4, starts=3, seed=1)
    assert np.allclose(a[0], b[0]) and abs(a[1] - b[1]) < 1e-9


def test_elbow_and_fit_stop_at_the_same_tolerance():
    import inspect

    assert {inspect.signature(f).parameters["tol"].default for f in (cluster.elbow, cluster.fit_kmeans, cluster.fit_kmeans_many)} == {cluster.TOL}


def test_elbow_k1_closed_form_and_monotone(spark):
    df = _points(spark)
    e = cluster.elbow(df, ks=range(1, 6), starts=3).orderBy("k").collect()
    k1 = cluster.wcss_k1(df).first()["wcss"]
    assert abs(e[0]["wcss"] - k1) < 1e-6
    w = [r["wcss"] for r in e]
    assert all(w[i + 1] <= w[i] + 1e-9 for i in range(len(w) - 1))


def test_assign_ties_lowest_index(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "polarity double, subjectivity double")
    assert cluster.assign(df, [(1.0, 0.0), (-1.0, 0.0)]).first()["clusters"] == 0


def test_no_more_points_than_k_costs_nothing(spark):
    df = spark.createDataFrame([(0.1, 0.2), (0.1, 0.2), (0.5, 0.6)], "polarity double, subjectivity double")
    assert cluster.fit_kmeans(df, k=5, starts=2) == ([(0.1, 0.2), (0.5, 0.6)], 0.0)
    e = {r["k"]: r["wcss"] for r in cluster.elbow(df, ks=range(1, 4), starts=2).collect()}
    assert e[2] == e[3] == 0.0 and e[1] > 0


def test_one_distinct_point(spark):
    df = spark.createDataFrame([(0.1, 0.2)] * 3, "polarity double, subjectivity double")
    assert [r["wcss"] for r in cluster.elbow(df, ks=range(1, 4), starts=1).collect()] == [0.0, 0.0, 0.0]


def _brute_lloyd(points, centres):
    """Plain rounds over (x, y, n) until the centres stand still: (centres, cost)."""
    while True:
        groups = {}
        cost = 0.0
        for x, y, n in points:
            d = [(x - a) * (x - a) + (y - b) * (y - b) for a, b in centres]
            j = d.index(min(d))
            cost += n * d[j]
            groups.setdefault(j, []).append((x, y, n))
        new = list(centres)
        for j, rows in groups.items():
            w = sum(n for *_, n in rows)
            new[j] = (sum(n * x for x, _, n in rows) / w, sum(n * y for _, y, n in rows) / w)
        if new == centres:
            return centres, cost
        centres = new


def test_shared_rounds_equal_single_runs(spark):
    pts = cluster.prepared_points(_points(spark, 250, 11))
    rows = [tuple(r) for r in pts.collect()]
    seeds = cluster.seed_centres(pts, 6, 4, seed=3)
    fits = cluster.lloyd(pts, {(k, i): c[:k] for k in (1, 2, 4, 6) for i, (c, _) in enumerate(seeds)})
    for (k, i), (centres, cost) in fits.items():
        want, brute = _brute_lloyd(rows, [tuple(map(float, c)) for c in seeds[i][0][:k]])
        assert centres == want and abs(cost - brute) < 1e-6 * max(1, brute)


def test_seeds_equal_the_drawing_rule(spark):
    import hashlib
    import math

    pts = cluster.prepared_points(_points(spark, 120, 5))
    rows = [tuple(r) for r in pts.collect()]
    for i, (centres, costs) in enumerate(cluster.seed_centres(pts, 5, 3, seed=7)):
        chosen = []
        for place in range(5):
            keys = []
            for x, y, n in rows:
                far = min((x - a) ** 2 + (y - b) ** 2 for a, b in chosen) if chosen else 1
                u = (int(hashlib.md5(f"{x}|{y}|{i + 7}|{place}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                if far > 0:
                    keys.append((-math.log(u) / (n * far), x, y))
            chosen.append(min(keys)[1:])
            assert costs[place] == sum(n * min((x - a) ** 2 + (y - b) ** 2 for a, b in chosen) for x, y, n in rows)
        assert centres == chosen


def test_first_draw_follows_the_weights(spark):
    df = spark.createDataFrame([(0.0, 0.0)] * 60 + [(0.5, 0.5)] * 30 + [(1.0, 1.0)] * 10, "polarity double, subjectivity double")
    firsts = [c[0][0] for c, _ in cluster.seed_centres(cluster.prepared_points(df), 1, 400)]
    shares = [firsts.count(x) / 400 for x in (0, 50, 100)]
    assert abs(shares[0] - 0.6) < 0.08 and abs(shares[1] - 0.3) < 0.08 and abs(shares[2] - 0.1) < 0.06


def test_missing_coordinates_empty_table_and_raw_points(spark):
    df = spark.createDataFrame([(0.1, None), (0.1, 0.2), (None, 0.2), (0.3, 0.2)], "polarity double, subjectivity double")
    assert cluster.fit_kmeans(df, k=2, starts=1) == ([(0.1, 0.2), (0.3, 0.2)], 0.0)
    assert cluster.fit_kmeans(df.limit(0), k=2, starts=1) == ([], 0.0)
    raw = spark.createDataFrame([(0.12345, 0.5), (0.12351, 0.5), (0.9, 0.1)], "polarity double, subjectivity double")
    centres, cost = cluster.fit_kmeans(raw, k=2, starts=3, decimals=None)
    assert np.allclose(centres, [(0.12348, 0.5), (0.9, 0.1)]) and abs(cost - 2 * 0.00003 ** 2) < 1e-12


def test_starts_do_not_depend_on_row_order(spark):
    df = _points(spark, 200, 9)
    a, b = (cluster.fit_kmeans_many(x, ks=(2, 5), starts=4) for x in (df.repartition(7), df.orderBy(df.comment_id.desc()).coalesce(1)))
    assert a == b
