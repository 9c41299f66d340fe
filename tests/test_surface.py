import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import binning, blocks, corrections, joins, surface
from gridloom.functions import grid, stats


def test_lowess_gives_planes_back_and_shrugs_off_outliers():
    g = np.random.default_rng(1)
    x, y = g.random(150) * 10, g.random(150) * 10
    z = 1 + 0.3 * x - 0.2 * y
    assert np.allclose(surface.lowess(x, y, z, 0.3), z, atol=1e-5)
    bad = z.copy()
    bad[::15] += 50
    assert np.abs(surface.lowess(x, y, bad, 0.5) - z).max() < 0.5
    assert (surface.smooth(x[:4], y[:4], z[:4], 3.0) == z[:4]).all() and (surface.smooth(x, y, z, np.inf) == z).all()


def points(spark, n=12_000, two=True):
    g = np.random.default_rng(2)
    x, y = g.random(n) * 10, g.random(n) * 10
    level = np.where(g.random(n) < (0.25 if two else 0), 2 + g.normal(0, 0.06, n), 1 + g.normal(0, 0.04, n))
    return spark.createDataFrame([(i, float(a), float(b), float(v), 200.0) for i, (a, b, v) in enumerate(zip(x, y, level * (1 + x / 30 + y / 50)))], "id long, x double, y double, v double, area double")


def test_reference_correction_puts_bands_at_one_and_two(spark):
    nodes = np.linspace(0, 10, 11)
    grids, out = corrections.reference_corrections(points(spark), (10, 10), (nodes, nodes), area="area")
    a = out.filter("corrected > 0.7 and corrected < 1.4").agg(F.median("corrected")).first()[0]
    b = out.filter("corrected > 1.6 and corrected < 2.5").agg(F.median("corrected")).first()[0]
    assert abs(a - 1) < 0.03 and abs(b - 2) < 0.06
    assert grids.factor.shape == (11, 11) and np.allclose(grids.area, 200, rtol=0.01) and grids.stripe is None


def test_channel_correction_follows_the_slope(spark):
    nodes = np.linspace(1, 9, 5)
    z, stripe = corrections.channel_corrections(points(spark, two=False), (10, 10), (nodes, nodes))
    want = 1 + nodes[None, :] / 30 + nodes[:, None] / 50
    assert np.abs(z / z.mean() - want / want.mean()).max() < 0.06 and stripe is None


def test_stripe_is_found_and_removed(spark):
    g = np.random.default_rng(3)
    x = g.random(60_000) * 40
    z = (1 + 0.1 * np.sin(2 * np.pi * x / 0.5)) * (1 + g.normal(0, 0.01, len(x)))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, z)], "x double, z double")
    s = surface.fit_stripe(df, "x", "z", 0.02)
    assert s.sampling is not None
    left = df.withColumn("r", F.col("z") / s.evaluator()("x")).agg(F.stddev("r"), F.stddev("z")).first()
    assert left[0] < 0.75 * left[1]
    flat = spark.createDataFrame([(float(a), 1.0) for a in x[:500]], "x double, z double")
    assert surface.fit_stripe(flat, "x", "z", 0.5).sampling is None


def test_hexagons_hold_their_centres(spark):
    h = spark.range(-8, 9).select(F.col("id").alias("i")).crossJoin(spark.range(-8, 9).select(F.col("id").alias("j")))
    x, y = grid.from_hex(F.col("i"), F.col("j"), 3.0)
    back = grid.to_hex(x + 0.01, y + 0.01, 3.0)
    assert h.filter((back[0] != F.col("i")) | (back[1] != F.col("j"))).count() == 0


def test_hazen_against_numpy(spark):
    v = np.random.default_rng(4).integers(0, 40, 501) / 7
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 1.0), ("b", 2.0), ("b", 4.0), ("b", 8.0), ("b", None), ("b", float("nan"))], "k string, v double")
    got = {r.k: (r.lo, r.hi) for r in stats.hazen(df, ["k"], "v", {"lo": 0.02, "hi": 0.93}).collect()}
    for k, x in (("a", v), ("b", np.array([1.0, 2, 4, 8]))):
        assert np.allclose(got[k], np.percentile(x, [2, 93], method="hazen"))
    whole = stats.hazen(df.filter("k = 'a'"), [], "v", {"lo": 0.02, "hi": 0.93}).first()
    assert np.allclose([whole.lo, whole.hi], np.percentile(v, [2, 93], method="hazen"))


def test_small_groups_have_defined_moments(spark):
    df = spark.createDataFrame([(n, float(i * i)) for n in range(1, 6) for i in range(n)] + [(9, 2.0)] * 5, "n int, v double")
    rows = {r.n: r for r in df.groupBy("n").agg(stats.skewness(F.col("v")).alias("s"), stats.kurtosis(F.col("v")).alias("k"), stats.std_or_zero(F.col("v")).alias("d")).collect()}
    assert rows[2].s is None and rows[3].s is not None and rows[3].k is None and rows[4].k is not None
    assert rows[1].d == 0 and rows[9].s is None and rows[9].k is None


def test_nearest_against_all_pairs(spark):
    g = np.random.default_rng(5)
    p, t = g.random((80, 2)) * 100, np.r_[g.random((12, 2)) * 10, g.random((3, 2)) * 1000]
    a = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "p long, x double, y double")
    b = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(t)], "t long, x double, y double")
    got = {r.p: r.t for r in joins.nearest(a, b, "p", "t", ["x", "y"], 2.0).collect()}
    assert got == {i: int(np.hypot(*(t - v).T).argmin()) for i, v in enumerate(p)}


def test_nearest_of_far_and_missing_points(spark):
    """Every point has a row: far ones find their target, those with a missing coordinate have nulls."""
    p = [(1, 0.0), (2, 1e7), (3, None), (4, float("nan")), (5, -3e5), (1, 0.0)]
    a, schema = spark.createDataFrame(p, "p long, x double"), "t long, x double"
    run = lambda t: sorted(((r.p, r.t, r.distance) for r in joins.nearest(a, spark.createDataFrame(t, schema), "p", "t", ["x"], 1.0).collect()), key=str)
    one = [(1, 7, 5.0), (2, 7, 9999995.0), (3, None, None), (4, None, None), (5, 8, 299997.0)]
    assert run([(7, 5.0), (9, 5.0), (8, -3.0 - 0.0), (6, None)]) == sorted([(1, 8, 3.0), *one[1:]], key=str)
    assert run([]) == sorted([(k, None, None) for k in (1, 1, 2, 3, 4, 5)], key=str)


def test_surface_lookup_clamps(spark):
    s = spark.createDataFrame([(i, j, float(i + 10 * j)) for i in range(3) for j in range(2)], "gx int, gy int, z double")
    p = spark.createDataFrame([(0.5, 0.5), (-3.0, 0.0), (9.0, 9.0), (2.0, 1.0)], "x double, y double")
    got = {(r.x, r.y): r.z for r in joins.from_surface(p, s, "x", "y", "z", (0, 0), (1, 1), (3, 2)).collect()}
    assert got == {(0.5, 0.5): 5.5, (-3.0, 0.0): 0.0, (9.0, 9.0): 12.0, (2.0, 1.0): 12.0}


def test_reducers_by_pandas_udf(spark):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    df = spark.createDataFrame([(0.1, 0.1, 1.0), (0.2, 0.2, 4.0), (0.9, 0.9, 2.0)], "x double, y double, z double")
    assert sorted(r.z for r in binning.decimate(df, "x", "y", "z", 0.5, reducer=spread).collect()) == [0.0, 3.0]
    assert [r.z for r in blocks.background(df.withColumn("k", F.lit(1)), ["k"], "z", F.lit(0.0)).collect()] == [0.0]


def test_stripe_fit_reads_all_objects(spark, monkeypatch):
    from gridloom.plans import rasters

    orders = spark.range(1000).selectExpr("id AS o_orderkey", "id * 7 AS o_custkey", "id + 0.5 AS o_totalprice")
    monkeypatch.setattr(rasters, "table", lambda *a: orders)
    read, fit = [], rasters.surface.fit_stripe
    monkeypatch.setattr(rasters.surface, "fit_stripe", lambda points, *a: read.append(points.count()) or fit(points, *a))
    assert rasters.stripe_fit(spark, "").count() > 0
    assert read == [1000]


def test_lowess_meets_few_points_and_gives_the_fit_of_all(spark):
    """Of many points each place meets those near it, which changes no weight; equal distances and outliers included."""
    g = np.random.default_rng(6)
    x, y = (v.ravel().astype(float) for v in np.meshgrid(np.arange(40), np.arange(40)))
    x, y = np.r_[x, g.normal(7, 0.01, 200)], np.r_[y, g.normal(9, 0.01, 200)]
    z = 1 + 0.02 * x + g.normal(0, 0.05, len(x))
    z[::17] += 3
    z[(x < 6) & (y < 4)] += 40 * g.random(int(((x < 6) & (y < 4)).sum()))
    k, trust = 20, np.ones(len(x))

    def one(px, py):
        dx, dy = x - px, y - py
        d = np.hypot(dx, dy)
        reach = np.sort(d)[k - 1]
        w = np.clip(1 - (d / (reach * 1.0000001)) ** 3, 0, None) ** 3 * trust
        w = w if w.sum() > 0 else np.exp(-((d / reach) ** 2))
        design = np.stack([np.ones_like(dx), dx, dy], axis=-1)
        normal = design.T @ (w[:, None] * design)
        return np.linalg.solve(normal + 1e-10 * np.trace(normal) * np.eye(3), design.T @ (w * z))[0]

    for rounds in range(3):
        want = np.array([one(*p) for p in zip(x, y)])
        assert np.allclose(surface.lowess(x, y, z, k / len(x), rounds=rounds), want, atol=1e-6)
        error = np.abs(z - want)
        trust = np.clip(1 - (error / (6 * np.median(error))) ** 2, 0, None) ** 2
    x, y = g.random(20_000), g.random(20_000)
    met = surface.neighbourhoods(x, y, x, y, k)
    assert sorted(np.concatenate([rows for rows, _ in met])) == list(range(len(x)))
    assert sum(len(rows) * near.shape[-1] for rows, near in met) < 3 * k * len(x)


def test_nearest_of_crowds_compares_neighbours_only(spark):
    """A crowd in one cell costs no pairs: 20,000 points by 20,000 targets, many of equal places, and empty ranges between."""
    g = np.random.default_rng(7)
    t = np.r_[np.round(g.random(15_000) * 3, 3), np.full(5_000, 1.5)]
    p = np.r_[np.round(g.random(18_000) * 3, 4), -g.random(1000) * 100, 50 + g.random(1000)]
    a = spark.createDataFrame(list(enumerate(map(float, p))), "p long, x double")
    b = spark.createDataFrame([(i, float(v)) for i, v in enumerate(t)], "t long, x double")
    df = joins.nearest(a, b, "p", "t", ["x"], 0.0)  # no cells on a line
    got = {r.p: (r.t, r.distance) for r in df.collect()}
    places, first = np.unique(t, return_index=True)
    for i, v in enumerate(p):
        k = np.searchsorted(places, v)
        near = [(abs(v - places[j]), int(first[j])) for j in (k - 1, k) if 0 <= j < len(places)]
        assert got[i] == min(near)[::-1]
    assert len(got) == len(p)


def test_rows_of_few_blocks_are_not_dealt_by_block(spark):
    """Aggregates of few keys go to the rows, also of tables too large to be sent; else all rows of a key met in one task."""
    df = spark.range(100_000).selectExpr("id % 3 AS k", "CAST(id AS double) AS v")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        with_mean = joins.with_group_stats(df, ["k"], {"m": F.avg("v")})
        plans = [p._jdf.queryExecution().executedPlan().toString() for p in (with_mean, stats.hazen(df, ["k"], "v", {"z": 0.5}), blocks.otsu(df, ["k"], "v"))]
        means = {(r.k, r.m) for r in with_mean.select("k", "m").distinct().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for plan in plans:
        by_key = [line for line in plan.splitlines() if "SortMergeJoin [k#" in line and "_p#" not in line and "LeftOuter" not in line]
        assert not by_key, by_key
    assert {k for k, _ in means} == {0, 1, 2} and all(abs(m - 49_999.5) < 2 for _, m in means)


def test_corrections_compute_values_once(spark):
    """What gives an object's value is not repeated by the reducers, rounds and steps of a correction."""
    read, nodes = spark.sparkContext.accumulator(0), np.linspace(1, 9, 5)

    @F.udf("double")
    def counted(v):
        read.add(1)
        return v

    n, low = 6000, lambda t: binning.low_band_mean(binning._binned(t, "_x", "_y", "_z", 2.0, "hexagonal"), ["gx", "gy"], "z")
    objects = points(spark, n).withColumn("v", counted("v"))
    steps = [lambda r=r: surface.decimate_and_smooth(objects, "x", "y", "v", 2.0, 5.0, r) for r in ("median", "mode", "mad")]
    steps += [
        lambda: surface.decimate_and_smooth(objects, "x", "y", "v", 2.0, 5.0, low, of_table=True),
        lambda: surface.fit_stripe(objects, "x", "v", 0.05),
        lambda: corrections.channel_corrections(objects, (10, 10), (nodes, nodes)),
    ]
    for i, step in enumerate(steps):
        before = read.value
        step()
        assert read.value - before == n, i


def test_low_bands_send_limits_to_the_rows(spark):
    """Limits of not too many keys go to the rows, which are not dealt by key a second time; the means are numpy's."""
    df = spark.range(30_000).selectExpr("id % 3 AS k", "CAST(id * 7919 % 30011 - 900 AS double) AS v")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        out = binning.low_band_mean(df, ["k"], "v")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.k: r.z for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    for k in range(3):
        v = np.array([i * 7919 % 30011 - 900 for i in range(k, 30_000, 3)], float)
        low, high = np.percentile(v[v > 0], [2, 4], method="hazen")
        assert np.isclose(got[k], v[(v > 0) & (v >= low) & (v <= high)].mean())
