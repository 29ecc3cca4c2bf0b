"""K-means on (polarity, subjectivity) (#46-#49).

Scores carry 2 decimals, so the points take at most 201 x 101 distinct
values. Fitting groups the comments to (point, weight) once, with map-side
partial aggregation. After that one aggregation the cost does not depend on
the number of comments, and the weighted cost equals the cost over the raw
rows.

Starts are drawn by k-means++: the next centre is a point with probability in
proportion to weight x squared distance from the centres so far. Each point
draws an exponential key from a hash of its coordinates, the start and the
place, divided by that product, and the least key wins: one aggregation gives
the next centre of all starts at once. A start's first k draws seed its run
for every k. Lloyd rounds are shared likewise: the centres of all (k, start)
runs that still move are one constant, every point finds its nearest centre in
each run, and one aggregation gives all new centres. The driver holds the
centres, never points.

With ``decimals`` the coordinates are whole numbers and all sums exact, so
neither draws nor centres depend on the order in which Spark adds rows.

Labels are assigned to every comment with a closed-form nearest-centre
expression over k literal centres: a narrow projection, no join, no
shuffle. Labels are renumbered by centre (first coordinate, then second),
which makes them repeatable across seeds and runs.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.schemas import CLUSTERS, POLARITY, SUBJECTIVITY
from murmur.session import cut_lineage

DEFAULT_COLS = (POLARITY, SUBJECTIVITY)
#: Centres that move by at most this (in every coordinate) count as standing still, in every fit.
TOL = 0.0


def _sq_dist(cols, centre):
    terms = [(F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x))) for c, x in zip(cols, centre)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def nearest_centre(centres: Sequence[Sequence[float]], cols: Sequence[str] = DEFAULT_COLS):
    """Index of the nearest centre (squared Euclidean); ties go to the lowest index."""
    dists = F.array(*[_sq_dist(cols, c) for c in centres])
    return (F.array_position(dists, F.array_min(dists)) - 1).cast("int")


def assign(df: DataFrame, centres: Sequence[Sequence[float]], cols: Sequence[str] = DEFAULT_COLS,
           col: str = CLUSTERS) -> DataFrame:
    """Add the nearest-centre label (#46, the predict half of fit_predict)."""
    return df.withColumn(col, nearest_centre(centres, cols))


def weighted_points(df: DataFrame, cols: Sequence[str] = DEFAULT_COLS, decimals: int | None = 2) -> DataFrame:
    """Distinct points x0, x1, ... with their multiplicity ``n``; rows with a missing coordinate are no points.

    With ``decimals`` the coordinates are whole multiples of 10^-decimals."""
    def coordinate(c):
        return F.col(c).cast("double") if decimals is None else F.round(F.col(c) * F.lit(float(10 ** decimals))).cast("long")

    return (df.select(*[coordinate(c).alias(f"x{i}") for i, c in enumerate(cols)]).na.drop()
            .groupBy(*[f"x{i}" for i in range(len(cols))]).agg(F.count(F.lit(1)).alias("n")))


def prepared_points(df: DataFrame, cols: Sequence[str] = DEFAULT_COLS, decimals: int | None = 2, rows_per_partition: int = 200_000) -> DataFrame:
    """The weighted distinct points, grouped once and written to the shared
    checkpoint folder in coordinate order.

    Every round reads this small table (for 2-decimal scores at most
    201 x 101 rows). Its order and its partitions depend on the points alone."""
    pts = weighted_points(df, cols, decimals)
    n = pts.count()
    parts = max(1, -(-n // rows_per_partition))
    return cut_lineage(pts.orderBy(*pts.columns).coalesce(parts)).coalesce(parts)  # one partition needs no exchange


def _constant(centres) -> str:
    """Centres of several runs (run, centre, coordinate) as one SQL literal."""
    return f"from_json('{json.dumps(centres)}', 'array<array<array<double>>>')"


def _distances(xs, k: int) -> str:
    """SQL for the squared distances of the point from the first k of ``centres`` (NULL beyond a run's last), coordinates added in their order."""
    def one(j):
        return " + ".join(f"({x} - get(get(centres, {j}), {i})) * ({x} - get(get(centres, {j}), {i}))" for i, x in enumerate(xs))
    return f"array({', '.join(map(one, range(k)))})"


def seed_centres(points: DataFrame, k: int, starts: int, seed: int = 0) -> list[tuple[list[tuple], list[float]]]:
    """Per start the first ``k`` k-means++ centres (fewer where the points run out),
    and the weighted cost of the first 1, 2, ... of them.

    ``points`` has coordinates and a weight ``n`` (see ``weighted_points``)."""
    xs = [c for c in points.columns if c != "n"]
    found: list[list[tuple]] = [[] for _ in range(starts)]
    costs: list[list[float]] = [[] for _ in range(starts)]
    for place in range(k + 1):
        far = f"array_min({_distances(xs, place)})" if place else "1D"
        name = "concat_ws('|', " + ", ".join(f"string({x})" for x in xs) + f", string(start + {seed}), '{place}')"
        u = f"(bigint(conv(substring(md5({name}), 1, 13), 16, 10)) + 0.5D) / {1 << 52}D"
        rows = (points.selectExpr("*", f"posexplode({_constant(found)}) AS (start, centres)")
                .selectExpr(*xs, "n", "start", f"{far} AS far", f"-ln({u}) AS draw"))
        key = F.expr(f"CASE WHEN far > 0 THEN named_struct('key', draw / (n * far), {', '.join(f"'{x}', {x}" for x in xs)}) END")
        for r in rows.groupBy("start").agg(F.min(key).alias("next"), F.expr("sum(n * far)").alias("cost")).collect():  # a row per start
            if place:
                costs[r["start"]].append(float(r["cost"]))
            if r["next"] is not None and place < k:
                found[r["start"]].append(tuple(r["next"][c] for c in xs))
    # Once the points run out no further centre is drawn, and the cost stays 0.
    return [(c, w[:len(c)]) for c, w in zip(found, costs)]


def lloyd(points: DataFrame, runs: dict, max_iter: int = 300, tol: float = TOL) -> dict:
    """{run: (centres, weighted cost)} of Lloyd's rounds from the given centres, all runs at once.

    A round is one aggregation over the points for all runs that still move.
    A point nearest to several centres goes to the first of them; a centre
    without a point stays where it is."""
    xs = [c for c in points.columns if c != "n"]
    live = {key: [tuple(float(v) for v in c) for c in centres] for key, centres in runs.items()}
    done, most = {}, max(map(len, live.values()), default=0)
    for step in range(max(1, max_iter)):
        if not live:
            break
        keys = list(live)

        rows = (points.selectExpr("*", f"posexplode({_constant([live[key] for key in keys])}) AS (run, centres)")
                .selectExpr(*xs, "n", "run", f"{_distances(xs, most)} AS d")
                .selectExpr(*xs, "n", "run", "array_position(d, array_min(d)) - 1 AS label", "array_min(d) AS far"))
        sums = rows.groupBy("run", "label").agg(F.expr("sum(n)").alias("n"), F.expr("sum(n * far)").alias("cost"),
                                                *[F.expr(f"sum(n * {x})").alias(x) for x in xs])
        new = {key: list(live[key]) for key in keys}
        cost = dict.fromkeys(keys, 0.0)
        for r in sorted(sums.collect(), key=lambda r: (r["run"], r["label"])):  # a row per run and centre
            key = keys[r["run"]]
            new[key][r["label"]] = tuple(r[c] / r["n"] for c in xs)
            cost[key] += r["cost"]
        for key in keys:
            moved = max(abs(a - b) for old, now in zip(live[key], new[key]) for a, b in zip(old, now))
            if moved <= tol or step == max_iter - 1:
                done[key] = (live.pop(key), cost[key])
            else:
                live[key] = new[key]
    return done


def fit_kmeans(df: DataFrame, cols: Sequence[str] = DEFAULT_COLS, k: int = 3, starts: int = 10,
               max_iter: int = 300, seed: int = 0, tol: float = TOL, decimals: int | None = 2):
    """Best of ``starts`` seeded k-means++ runs on the weighted distinct points.

    Returns (centres sorted by coordinates, within-cluster sum of squares).
    With no more distinct points than k, each point is a centre and the cost 0.
    """
    return fit_kmeans_many(df, cols, [k], starts, max_iter, seed, tol, decimals)[k]


def fit_kmeans_many(df: DataFrame, cols: Sequence[str] = DEFAULT_COLS, ks=(3,), starts: int = 10, max_iter: int = 300,
                    seed: int = 0, tol: float = TOL, decimals: int | None = 2, points: DataFrame | None = None) -> dict:
    """{k: (sorted centres, cost)} for several k from one grouping pass.

    Rounds go on until no centre moves by more than ``tol`` of a coordinate
    (or ``max_iter``). The best start has the least cost, costs taken as equal
    where their first nine decimals are; ties go to the lesser centres."""
    ks = list(ks)
    pts = prepared_points(df, cols, decimals) if points is None else points
    scale = 1.0 if decimals is None else float(10 ** decimals)
    xs = [c for c in pts.columns if c != "n"]
    distinct = pts.limit(max([*ks, 1]) + 1).collect()
    out = {k: (sorted(tuple(float(r[c]) / scale for c in xs) for r in distinct), 0.0) for k in ks if k >= len(distinct)}
    open_ = [k for k in ks if k not in out]
    if open_:
        seeds = seed_centres(pts, max(open_), starts, seed)
        fits = lloyd(pts, {(k, s): c[:k] for k in open_ for s, (c, _) in enumerate(seeds)}, max_iter, tol * scale)
        for k in open_:
            best = min((round(cost / scale ** 2, 9), sorted(tuple(v / scale for v in c) for c in centres), cost / scale ** 2)
                       for (of, _), (centres, cost) in fits.items() if of == k)
            out[k] = (best[1], best[2])
    return out


def wcss_k1(df: DataFrame, cols: Sequence[str] = DEFAULT_COLS, decimals: int | None = 2) -> DataFrame:
    """Within-cluster sum of squares for k = 1 (n * sum of population variances).

    With ``decimals`` (scores carry 2), values are taken as exact integers
    X = x * 10^d and WCSS = sum over columns of (n * sum(X^2) - sum(X)^2) / (n * 10^2d):
    the numerator is exact (widened to decimal(38,0), so no overflow), and
    the result does not depend on the order Spark adds rows in."""
    n = F.count(F.lit(1))
    if decimals is None:
        total = None
        for c in cols:
            term = F.var_pop(c)
            total = term if total is None else total + term
        return df.agg((n * total).alias("wcss"))
    scale = 10 ** decimals
    aggs = [n.alias("_n")]
    for i, c in enumerate(cols):
        x = F.round(F.col(c) * F.lit(float(scale))).cast("long")
        aggs += [F.sum(x).alias(f"_s{i}"), F.sum(x * x).alias(f"_q{i}")]
    dec = "decimal(38,0)"
    terms = []
    for i in range(len(cols)):
        num = (F.col("_n").cast(dec) * F.col(f"_q{i}").cast(dec)
               - F.col(f"_s{i}").cast(dec) * F.col(f"_s{i}").cast(dec))
        terms.append(num)
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    wcss = F.try_divide(total.cast("double"), F.col("_n").cast("double") * F.lit(float(scale * scale)))
    return df.agg(*aggs).select(F.coalesce(wcss, F.lit(0.0)).alias("wcss"))


def elbow(df: DataFrame, cols: Sequence[str] = DEFAULT_COLS, ks=range(1, 11), starts: int = 10,
          seed: int = 0, max_iter: int = 300, tol: float = TOL, decimals: int | None = 2) -> DataFrame:
    """(k, wcss) for each k, from one grouping pass, as ``fit_kmeans`` gives it."""
    fits = fit_kmeans_many(df, cols, list(ks), starts, max_iter, seed, tol, decimals)
    return df.sparkSession.createDataFrame([(int(k), float(fits[k][1])) for k in ks], "k int, wcss double")


def cluster_profile(df: DataFrame, cols: Sequence[str] = DEFAULT_COLS, col: str = CLUSTERS,
                    decimals: int | None = 2) -> DataFrame:
    """Per label: size and mean of each coordinate (the data behind the scatter).
    With ``decimals`` (scores carry 2) the means are exact integer sums over
    one division, rounded half away from zero to 6 places."""
    from murmur.functions.scalar import round_half_away
    from murmur.operators.sentiment import exact_mean

    if decimals is None:
        means = [F.round(F.avg(c), 6).alias(f"avg_{c}") for c in cols]
    else:
        means = [round_half_away(exact_mean(c, decimals), 6).alias(f"avg_{c}") for c in cols]
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n_comments"), *means)
