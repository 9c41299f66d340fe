"""Queries of the relational operators over the star-schema tables.

Bindings: an object is a supplier of lineitem, x its quantity, y its line number, v its price; a block is a
return flag or an event type; scattered points are quantity and price; an embedding is a raster of 8 by 8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import grid, stats
from gridloom.operators import binning, blocks, features, joins, texture
from gridloom.plans.expression import Correction
from gridloom.plans.registry import query
from gridloom.sources import table


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("label"), F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y"), F.col("l_extendedprice").alias("v"), F.col("l_returnflag").alias("block"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_discount").alias("z"))


#: Means of whole places end after few digits; at this many no engine has to round a half.
PLACES = 10


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_PIXELS = "SELECT l_suppkey AS label, l_quantity AS x, CAST(l_linenumber AS DOUBLE) AS y, l_extendedprice AS v, l_returnflag AS block FROM lineitem"
_POINTS = "SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_discount AS z FROM lineitem"


# ---- features of objects


@query(f"SELECT label, round(avg(x), 10) AS BasicProps_Centroid_X, round(avg(y), 10) AS BasicProps_Centroid_Y, count(*) AS BasicProps_Area, round(sum(v), 4) AS BasicProps_Intensity_v_Integrated FROM ({_PIXELS}) GROUP BY label")
def basic_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.extract(pixels(spark, sf_dir), ["label"], [features.BasicProps("v")])
    return rounded(out.withColumn("BasicProps_Intensity_v_Integrated", F.round("BasicProps_Intensity_v_Integrated", 4)), PLACES)


@query(f"SELECT label, round(avg(x), 10) AS Location_Centroid_X, round(avg(y), 10) AS Location_Centroid_Y, min(x) AS Location_BBox_L, min(y) AS Location_BBox_T, max(x) - min(x) + 1 AS Location_BBox_W, max(y) - min(y) + 1 AS Location_BBox_H FROM ({_PIXELS}) GROUP BY label")
def location_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.extract(pixels(spark, sf_dir), ["label"], [features.Location()]), PLACES)


_MOMENTS = """round(sum(v), 4) AS Intensity_v_Integrated, round(avg(v), 6) AS Intensity_v_Mean, round(stddev_samp(v), 6) AS Intensity_v_Std,
round(CASE WHEN count(v) >= 3 THEN skewness(v) END, 6) AS Intensity_v_Skewness,
round(CASE WHEN count(v) >= 4 THEN kurtosis(v) END, 6) AS Intensity_v_Kurtosis"""


@query(f"SELECT label, {_MOMENTS} FROM ({_PIXELS}) GROUP BY label")
def intensity_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.extract(pixels(spark, sf_dir), ["label"], [features.Intensity("v")])
    return rounded(out.withColumn("Intensity_v_Integrated", F.round("Intensity_v_Integrated", 4)))


_ELLIPSE = """, m AS (SELECT label, count(*) AS n, var_pop(x) + 1.0/12 AS a, var_pop(y) + 1.0/12 AS b, covar_pop(x, y) AS c FROM p GROUP BY label),
e AS (SELECT label, n, sqrt(8 * (a + b + sqrt((a - b) * (a - b) + 4 * c * c))) AS maj, sqrt(greatest(8 * (a + b - sqrt((a - b) * (a - b) + 4 * c * c)), 0)) AS mnr FROM m)"""


@query(f"WITH p AS ({_PIXELS}){_ELLIPSE} SELECT label, n AS Shape_Area, round(maj, 6) AS Shape_MajorAxisLength, round(mnr, 6) AS Shape_MinorAxisLength, round(sqrt(maj * maj - mnr * mnr) / maj, 6) AS Shape_Eccentricity FROM e")
def shape_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.extract(pixels(spark, sf_dir), ["label"], [features.Ellipse()]))


def _ring(k: int, name: str) -> str:
    ring = "least(ceil(x / 10), 4)"
    own = f"CASE WHEN {ring} = {k} THEN v END"
    return f"round(coalesce(avg({own}), 0), 4) AS RadialIntensity_v_Mean_W10_{name}, round(coalesce(stddev_samp({own}), 0), 4) AS RadialIntensity_v_Std_W10_{name}"


@query(f"SELECT label, {', '.join(_ring(k, 'Center' if k == 4 else f'R{k}') for k in (4, 3, 2, 1))} FROM ({_PIXELS}) GROUP BY label")
def radial_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.extract(pixels(spark, sf_dir), ["label"], [features.RadialIntensity("v", distance="x", rings=3, width=10)]), 4)


@query(f"WITH p AS ({_PIXELS}) SELECT label, block, count(*) AS BasicProps_Area, round(avg(x) + 100, 10) AS BasicProps_Centroid_X, round(avg(y) + 200, 10) AS BasicProps_Centroid_Y, round(min(x) + 100, 6) AS Location_BBox_L, round(min(y) + 200, 6) AS Location_BBox_T, round(avg(v), 6) AS Intensity_v_Mean FROM p GROUP BY label, block")
def feature_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = [features.EmptyFeature(), features.BasicProps(), features.Location(), features.Intensity("v"), features.Intensity("no_such_channel")]
    out = features.FeatureExtractor(groups).compute(pixels(spark, sf_dir), ["label", "block"], offset=(F.lit(100), F.lit(200)))
    out = out.withColumn("Intensity_v_Mean", F.round("Intensity_v_Mean", 6))
    return rounded(out.select("label", "block", "BasicProps_Area", "BasicProps_Centroid_X", "BasicProps_Centroid_Y", "Location_BBox_L", "Location_BBox_T", "Intensity_v_Mean"), PLACES)


@query(f"WITH p AS ({_PIXELS}), f AS (SELECT label, count(*) AS a, avg(x) AS cx, sum(v) AS s, avg(v) AS m FROM p GROUP BY label) SELECT label, a AS BasicProps_Area, round(s + cx * 10, 4) AS Intensity_v_Integrated, round(m + cx * 10 / a, 6) AS Intensity_v_Mean FROM f")
def post_process_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.extract(pixels(spark, sf_dir), ["label"], [features.BasicProps(), features.Intensity("v")])
    f = features.offset_intensities(f, F.col("BasicProps_Centroid_X") * 10, "BasicProps_Area")
    return f.select("label", "BasicProps_Area", F.round("Intensity_v_Integrated", 4).alias("Intensity_v_Integrated"), F.round("Intensity_v_Mean", 6).alias("Intensity_v_Mean"))


@query(f"SELECT label, count(*) AS BasicProps_Area FROM ({_PIXELS}) GROUP BY label HAVING count(*) >= 600")
def min_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.extract(pixels(spark, sf_dir), ["label"], [features.BasicProps()])
    return features.larger_than(f, "BasicProps_Area", 600).select("label", "BasicProps_Area")


@query("WITH e AS (SELECT l_returnflag AS block, l_orderkey AS label, count(*) AS area, min(l_quantity) AS l, max(l_quantity) AS r FROM lineitem GROUP BY ALL) SELECT block, label, area FROM e WHERE l > 1 AND r < 50")
def border_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    p = li.select(F.col("l_returnflag").alias("block"), F.col("l_orderkey").alias("label"), F.col("l_quantity").alias("x"), (F.col("l_linenumber") + 1).alias("y"))
    inner = features.without_border(p, ["label"], ["block"], "x", "y", (F.lit(50), F.lit(9)))
    return inner.groupBy("block", "label").agg(F.count("*").alias("area"))


@query(f"SELECT label, round(avg(v), 6) AS Intensity_v_Mean, round(stddev_samp(v), 6) AS Intensity_v_Std FROM ({_PIXELS}) GROUP BY label")
def column_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.extract(pixels(spark, sf_dir), ["label"], [features.BasicProps("v"), features.Intensity("v")])
    names = [*features.columns_named(f, part="_Mean"), *features.columns_named(f, prefix="Intensity_", part="Std")]
    return rounded(f.select("label", *names))


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(min({c}), 6) AS minX, round(avg({c}), 6) AS meanX, round(max({c}), 6) AS maxX, round(stddev_samp({c}), 6) AS stdX,"
        f" round(avg(abs({c} - (SELECT avg({c}) FROM lineitem))), 6) AS madX, round(median({c}), 6) AS medianX, count(*) FILTER ({c} = 0) AS is0, count(*) FILTER ({c} IS NULL) AS isNan FROM lineitem"
        for c in _NUMERIC
    )
)
def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.summary(table(spark, sf_dir, "lineitem"), list(_NUMERIC)))


@query("WITH m AS (SELECT median(n) AS m FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)) SELECT l_suppkey AS label, round(count(*) / (SELECT m FROM m), 6) AS area FROM lineitem GROUP BY 1")
def normalised_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.extract(pixels(spark, sf_dir), ["label"], [features.Ellipse()]).select("label", "Shape_Area")
    return f.select("label", F.round(F.col("Shape_Area") / stats.median_of(f, "Shape_Area"), 6).alias("area"))


def _hazen_sql(rows: str, keys: str, shares: dict[str, float]) -> str:
    at = lambda p: f"least(greatest(n * {p} + 0.5, 1), n)"
    cols = ", ".join(f"round(sum(v * greatest(0, 1 - abs(i - {at(p)}))), 6) AS {name}" for name, p in shares.items())
    part, lead, group = (f"PARTITION BY {keys}", f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "", "")
    return f"SELECT {lead}{cols} FROM (SELECT {lead}v, row_number() OVER ({part} ORDER BY v) AS i, count(*) OVER ({part}) AS n FROM ({rows})) {group}"


@query(_hazen_sql("SELECT l_extendedprice AS v FROM lineitem", "", {"low": 0.001, "high": 0.99}))
def display_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.hazen(table(spark, sf_dir, "lineitem"), [], "l_extendedprice", {"low": 0.001, "high": 0.99}))


# ---- thresholds, levels, stripes


def _otsu_sql(rows: str, weight: str) -> str:
    return f"""
WITH r AS ({rows}), s AS (SELECT block, min(v) AS mn, max(v) AS mx FROM r GROUP BY block),
c AS (SELECT block, CAST(round(255 * (v - mn) / (mx - mn)) + 1 AS INTEGER) AS k, count(*) AS c FROM r JOIN s USING (block) GROUP BY ALL),
g AS (SELECT block, mn, mx, k, coalesce(c, 0) AS c FROM (SELECT block, mn, mx, unnest(generate_series(1, 256)) AS k FROM s) LEFT JOIN c USING (block, k)),
p AS (SELECT *, c / sum(c) OVER (PARTITION BY block) AS p FROM g),
w AS (SELECT *, sum(p) OVER o AS w, sum(p * {weight}) OVER o AS m, sum(p * {weight}) OVER (PARTITION BY block) AS t FROM p WINDOW o AS (PARTITION BY block ORDER BY k)),
b AS (SELECT *, round(CASE WHEN w * (1 - w) > 1e-12 THEN (t * w - m) * (t * w - m) / (w * (1 - w)) END, 9) AS s FROM w),
x AS (SELECT *, max(s) OVER (PARTITION BY block) AS best FROM b)
SELECT block, round((avg(k) - 1) / 255 * (any_value(mx) - any_value(mn)) + any_value(mn), 6) AS threshold FROM x WHERE s = best GROUP BY block"""


_PRICES = "SELECT l_returnflag AS block, l_extendedprice AS v FROM lineitem"
_EVENTS = "SELECT event_type AS block, value AS v FROM events"


@query(_otsu_sql(_PRICES, "k"))
def otsu_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(blocks.otsu(pixels(spark, sf_dir), ["block"], "v"))


@query(_otsu_sql(_EVENTS, "log2(k)"))
def otsu_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("block"), F.col("value").alias("v"))
    return rounded(blocks.otsu(events, ["block"], "v", "log"))


def _thresholded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with a threshold of their block: its mean."""
    return joins.with_group_stats(pixels(spark, sf_dir), ["block"], {"threshold": F.avg("v")})


@query(f"WITH p AS ({_PIXELS}), t AS (SELECT *, avg(v) OVER (PARTITION BY block) AS threshold FROM p) SELECT block, round(coalesce(median(v) FILTER (v < threshold), 0), 6) AS z FROM t GROUP BY block")
def block_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(blocks.background(_thresholded(spark, sf_dir), ["block"], "v", F.col("threshold")))


@query(f"WITH p AS ({_PIXELS}), t AS (SELECT *, avg(v) OVER (PARTITION BY block) AS threshold FROM p) SELECT block, round(coalesce(avg(v) FILTER (v > threshold), 0), 6) AS z FROM t GROUP BY block")
def block_foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(blocks.foreground(_thresholded(spark, sf_dir), ["block"], "v", F.col("threshold")))


@query(f"WITH p AS ({_PIXELS}), t AS (SELECT *, avg(v) OVER (PARTITION BY block) AS threshold FROM p) SELECT label, count(*) AS n FROM t WHERE v > threshold GROUP BY label")
def threshold_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thresholded(spark, sf_dir).filter(F.col("v") > F.col("threshold")).groupBy("label").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1) SELECT CAST(date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS BIGINT) AS x, round(median(value / m), 6) AS s FROM events JOIN m USING (event_type) GROUP BY 1")
def stripe_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = joins.with_group_stats(table(spark, sf_dir, "events"), ["event_type"], {"m": F.median("value")})
    hour = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600).cast("long")
    return rounded(blocks.stripe(ev, hour, F.col("value") / F.col("m")))


@query(
    """WITH g AS (SELECT CAST(l_linenumber - 1 AS BIGINT) AS gx, CAST(floor((l_quantity - 1) / 10) AS BIGINT) AS gy, avg(l_extendedprice) AS z FROM lineitem GROUP BY 1, 2),
e AS (SELECT max(gx) AS r, max(gy) AS b FROM g), d AS (SELECT unnest([-1, 0, 1]) AS d),
a AS (SELECT g.gx AS x, g.gy AS y, CASE WHEN g.gx + dx.d < 0 THEN 0 WHEN g.gx + dx.d > r THEN r ELSE g.gx + dx.d END AS gx, CASE WHEN g.gy + dy.d < 0 THEN 0 WHEN g.gy + dy.d > b THEN b ELSE g.gy + dy.d END AS gy FROM g, e, d dx, d dy)
SELECT a.x AS gx, a.y AS gy, round(median(z), 6) AS z FROM a JOIN g USING (gx, gy) GROUP BY 1, 2"""
)
def surface_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    surface = li.groupBy((F.col("l_linenumber") - 1).cast("long").alias("gx"), F.floor((F.col("l_quantity") - 1) / 10).alias("gy")).agg(F.avg("l_extendedprice").alias("z"))
    return rounded(blocks.median_3x3(surface))


# ---- bins

_RECT = f"SELECT CAST(floor(x / 5) AS BIGINT) AS gx, CAST(floor(y / 5) AS BIGINT) AS gy, z FROM ({_POINTS})"
_R, _S = 2.5, 10 / 3**0.5
_HEX = f"""SELECT CAST(floor((floor(x / {2 * _R!r} - y / {_S!r}) + floor(x / {_R!r}) + 2) / 3) AS BIGINT) AS gx,
CAST(floor((floor(x / {2 * _R!r} + y / {_S!r}) + floor(y / {_S!r} - x / {2 * _R!r}) + 2) / 3) AS BIGINT) AS gy, z FROM ({_POINTS})"""


def _bins(spark: SparkSession, sf_dir: str, kind: str, reducer, **kw) -> DataFrame:
    return rounded(binning.decimate(points(spark, sf_dir), "x", "y", "z", 5.0, kind, reducer, **kw))


@query(f"SELECT gx, gy, count(*) AS z FROM ({_RECT}) GROUP BY ALL")
def rect_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir, "rectangular", "density")


@query(f"SELECT gx, gy, round(min(z), 6) AS lo, round(max(z), 6) AS hi, round(avg(z), 6) AS mean, round(median(z), 6) AS mid, round(coalesce(stddev_samp(z), 0), 6) AS std FROM ({_RECT}) GROUP BY ALL")
def rect_reducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts, out = points(spark, sf_dir), None
    for name, reducer in (("lo", "min"), ("hi", "max"), ("mean", "mean"), ("mid", "median"), ("std", "std")):
        one = binning.decimate(pts, "x", "y", "z", 5.0, "rectangular", reducer).withColumnRenamed("z", name)
        out = one if out is None else out.join(one, ["gx", "gy"])
    return rounded(out)


@query(f"SELECT gx, gy, count(*) AS z FROM ({_HEX}) GROUP BY ALL")
def hex_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir, "hexagonal", "density")


@query(f"SELECT gx, gy, round(median(z), 6) AS z FROM ({_HEX}) GROUP BY ALL")
def hex_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir, "hexagonal", "median")


@query(f"WITH c AS (SELECT gx, gy, round(z / 0.03) * 0.03 AS v, count(*) AS n FROM ({_HEX}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY n DESC, v) AS i FROM c) SELECT gx, gy, round(v, 6) AS z FROM r WHERE i = 1")
def hex_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir, "hexagonal", "mode", step=0.03)


@query(_hazen_sql(f"SELECT gx, gy, z AS v FROM ({_HEX})", "gx, gy", {"z": 0.2}))
def hex_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir, "hexagonal", "percentile", share=0.2)


@query(f"WITH h AS ({_HEX}), m AS (SELECT gx, gy, median(z) AS m FROM h GROUP BY ALL) SELECT gx, gy, round(median(abs(z - m)), 6) AS z FROM h JOIN m USING (gx, gy) GROUP BY ALL")
def hex_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir, "hexagonal", "mad")


@query(f"WITH h AS (SELECT gx, gy, count(*) AS z FROM ({_HEX}) GROUP BY ALL), b AS (SELECT min(x) AS l, max(x) AS r, min(y) AS t, max(y) AS d FROM ({_POINTS})), c AS (SELECT *, gx * {2 * _R!r} + gy * {_R!r} AS x, gy * {1.5 * _S!r} AS y FROM h) SELECT gx, gy, z, CAST(round(x, 6) AS DOUBLE) AS x, CAST(round(y, 6) AS DOUBLE) AS y FROM c, b WHERE x BETWEEN l - 7.5 AND r + 7.5 AND y BETWEEN t - 7.5 AND d + 7.5")
def hex_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = points(spark, sf_dir)
    bins = binning.centres(binning.decimate(pts, "x", "y", "z", 5.0, "hexagonal", "density"), 5.0, "hexagonal")
    return rounded(binning.trimmed(bins, pts, "x", "y", 5.0))


@query(f"""WITH b AS (SELECT gx, gy, median(z) AS z FROM ({_RECT}) GROUP BY ALL), e AS (SELECT min(gx) AS l, max(gx) AS r, min(gy) AS t, max(gy) AS d FROM b),
g AS (SELECT gx, unnest(generate_series(t - 1, d + 1)) AS gy, l, r, t, d FROM (SELECT *, unnest(generate_series(l - 1, r + 1)) AS gx FROM e))
SELECT g.gx, g.gy, round(coalesce(b.z, -1), 6) AS z FROM g LEFT JOIN b ON b.gx = least(greatest(g.gx, l), r) AND b.gy = least(greatest(g.gy, t), d)""")
def rect_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(binning.filled(binning.decimate(points(spark, sf_dir), "x", "y", "z", 5.0), -1.0))


@query(f"SELECT gx, gy, round(median(z), 6) AS z FROM ({_HEX}) GROUP BY ALL HAVING median(z) <> 0 AND median(z) <> 0.05")
def hex_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(binning.cleaned(binning.decimate(points(spark, sf_dir), "x", "y", "z", 5.0, "hexagonal"), 0.05))


@query(f"SELECT gx, gy, round(sum(z * z) / count(z), 6) AS z FROM ({_RECT}) GROUP BY ALL")
def custom_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir, "rectangular", lambda z: F.sum(z * z) / F.count(z))


_TOTALS = "SELECT o_orderpriority AS cell, o_totalprice / (SELECT median(o_totalprice) FROM orders) AS v FROM orders"


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    middle = stats.median_of(orders, "o_totalprice")
    return orders.select(F.col("o_orderpriority").alias("cell"), (F.col("o_totalprice") / middle).alias("v"))


@query(f"WITH t AS ({_TOTALS}), c AS (SELECT floor(v / 0.05) AS k, count(*) AS n FROM t GROUP BY 1) SELECT round((k + 0.5) * 0.05, 6) AS peak FROM c ORDER BY n DESC, k DESC LIMIT 1")
def histogram_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(binning.histogram_peak(totals(spark, sf_dir), "v"))


_SIGMA2 = 2 * (1 / 2.355) ** 2


@query(f"""WITH c AS (SELECT cell, floor(v / 0.05) AS k, count(*) AS n FROM ({_TOTALS}) GROUP BY ALL),
w AS (SELECT *, round(n * exp(-((k + 0.5) * 0.05 - 1.5) * ((k + 0.5) * 0.05 - 1.5) / {_SIGMA2!r}), 9) AS w, min(k) OVER (PARTITION BY cell) AS lo, max(k) OVER (PARTITION BY cell) - min(k) OVER (PARTITION BY cell) + 1 AS b FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY w DESC, k) AS i FROM w),
t AS (SELECT cell, any_value(b) - max(CASE WHEN i = 1 AND k = lo THEN 1 ELSE 0 END) AS b FROM r GROUP BY cell),
u AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY w DESC, k) AS j FROM w WHERE k > lo)
SELECT cell, round(CASE WHEN w >= 360 / t.b THEN (k + 0.5) * 0.05 END, 6) AS z FROM t LEFT JOIN (SELECT cell, k, w FROM u WHERE j = 1) USING (cell)""")
def band_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(binning.band_mode(totals(spark, sf_dir), ["cell"], "v", peak=1.5))


@query(f"""WITH t AS ({_TOTALS}), r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY v) AS i, count(*) OVER (PARTITION BY cell) AS n FROM t WHERE v > 0),
h AS (SELECT cell, sum(v * greatest(0, 1 - abs(i - least(greatest(n * 0.02 + 0.5, 1), n)))) AS lo, sum(v * greatest(0, 1 - abs(i - least(greatest(n * 0.04 + 0.5, 1), n)))) AS hi FROM r GROUP BY cell)
SELECT cell, round(CASE WHEN count(*) >= 150 THEN avg(v) FILTER (v BETWEEN lo AND hi) END, 6) AS z FROM r JOIN h USING (cell) GROUP BY cell""")
def low_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(binning.low_band_mean(totals(spark, sf_dir), ["cell"], "v", least=150))


# ---- expressions and predicates


@query("""WITH b AS (SELECT l_returnflag AS f, min(l_extendedprice) AS bo, avg(l_discount) + 1 AS bs, avg(l_extendedprice) AS ff FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, round((l_extendedprice - bo * bs) / ff + 2 ^ 2, 6) AS corrected FROM lineitem JOIN b ON f = l_returnflag""")
def correction_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    known = joins.with_group_stats(li, ["l_returnflag"], {"bo": F.min("l_extendedprice"), "bs": F.avg("l_discount") + 1, "ff": F.avg("l_extendedprice")})
    c = Correction("(S - BG_o * BG_s) / (FG_f * FG_s) + FG_o + 2^2", {"BG_o": F.col("bo"), "BG_s": F.col("bs"), "FG_f": F.col("ff")})
    return known.select("l_orderkey", "l_linenumber", F.round(c.column(F.col("l_extendedprice")), 6).alias("corrected"))


@query(f"WITH t AS ({_TOTALS}) SELECT cell, count(*) FILTER (v > 0.5 AND v < 1.5) AS near, count(*) FILTER (v > 0.7 AND v < 1.3) AS g1, count(*) FILTER (v > 1.8 AND v < 2.8) AS g2 FROM t GROUP BY cell")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    inside = lambda lo, hi: F.count_if((v > lo) & (v < hi))
    return totals(spark, sf_dir).groupBy("cell").agg(inside(0.5, 1.5).alias("near"), inside(0.7, 1.3).alias("g1"), inside(1.8, 2.8).alias("g2"))


@query(f"WITH t AS ({_TOTALS}), g AS (SELECT median(v) FILTER (v > 0.5 AND v < 1.5) AS g1, median(v) FILTER (v > 1.8 AND v < 2.8) AS g2 FROM t) SELECT cell, round(avg(v / (g2 - g1) + 1 - g1 / (g2 - g1)), 6) AS corrected FROM t, g GROUP BY cell")
def band_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values moved so that the first band lies at 1 and the second at 2."""
    t, v = totals(spark, sf_dir), F.col("v")
    known = t.withColumn("g1", stats.median_of(t, "v", (v > 0.5) & (v < 1.5))).withColumn("g2", stats.median_of(t, "v", (v > 1.8) & (v < 2.8)))
    g1, factor = F.col("g1"), F.col("g2") - F.col("g1")
    c = Correction("S / FG_f + FG_o", {"FG_f": factor, "FG_o": 1 - g1 / factor})
    return rounded(known.groupBy("cell").agg(F.avg(c.column(v)).alias("corrected")))


_CONTOUR = [(1.0, 0.5), (4.0, 0.25), (8.0, 1.5), (9.5, 3.25), (8.0, 5.75), (5.0, 6.5), (2.0, 5.25), (0.5, 2.75)]


def _contour_sql() -> str:
    edges = zip(_CONTOUR, _CONTOUR[1:] + _CONTOUR[:1])
    return " + ".join(f"CASE WHEN ({y0} > y) <> ({y1} > y) AND x < {x1 - x0!r} * (y - {y0}) / {y1 - y0!r} + {x0} THEN 1 ELSE 0 END" for (x0, y0), (x1, y1) in edges)


@query(f"WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity / 5 AS x, l_extendedprice / 15000 AS y FROM lineitem) SELECT l_orderkey, l_linenumber FROM p WHERE ({_contour_sql()}) % 2 = 1")
def acceptance_contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = grid.in_polygon(F.col("l_quantity") / 5, F.col("l_extendedprice") / 15000, _CONTOUR)
    return table(spark, sf_dir, "lineitem").filter(inside).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice / 20000 < 2.3 AND l_extendedprice / 20000 > 2 AND l_quantity / 25 < 1.15 AND l_quantity / 25 > 0.9")
def phase_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, a = F.col("l_extendedprice") / 20000, F.col("l_quantity") / 25
    return table(spark, sf_dir, "lineitem").filter((d < 2.3) & (d > 2) & (a < 1.15) & (a > 0.9)).select("l_orderkey", "l_linenumber")


# ---- joins


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k")
    mask = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k")
    return joins.blocks_with_mask(li, mask, ["k"]).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_SURFACE = "SELECT CAST(l_linenumber - 1 AS INTEGER) AS gx, CAST(floor((l_quantity - 1) / 10) AS INTEGER) AS gy, avg(l_extendedprice) AS z FROM lineitem GROUP BY 1, 2"


@query(f"""WITH g AS ({_SURFACE}), p AS (SELECT o_orderkey, o_orderkey % 80 / 10.0 - 1 AS px, o_custkey % 60 / 10.0 - 0.5 AS py FROM orders),
c AS (SELECT *, least(greatest(px, 0), 6) AS ix, least(greatest(py, 0), 4) AS iy FROM p), d AS (SELECT *, CAST(least(floor(ix), 5) AS INTEGER) AS cx, CAST(least(floor(iy), 3) AS INTEGER) AS cy FROM c)
SELECT o_orderkey, round(a.z + (ix - cx) * (b.z - a.z) + (iy - cy) * (e.z + (ix - cx) * (f.z - e.z) - a.z - (ix - cx) * (b.z - a.z)), 6) AS z FROM d
JOIN g a ON a.gx = cx AND a.gy = cy JOIN g b ON b.gx = cx + 1 AND b.gy = cy JOIN g e ON e.gx = cx AND e.gy = cy + 1 JOIN g f ON f.gx = cx + 1 AND f.gy = cy + 1""")
def interp_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    surface = li.groupBy((F.col("l_linenumber") - 1).cast("int").alias("gx"), F.floor((F.col("l_quantity") - 1) / 10).cast("int").alias("gy")).agg(F.avg("l_extendedprice").alias("z"))
    p = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 80 / 10 - 1).alias("px"), (F.col("o_custkey") % 60 / 10 - 0.5).alias("py"))
    out = joins.from_surface(p, surface, "px", "py", "z", (0, 0), (1, 1), (7, 5))
    return out.select("o_orderkey", F.round("z", 6).alias("z"))


@query("""WITH s AS (SELECT CAST(l_quantity AS INTEGER) AS x, avg(l_extendedprice) AS s FROM lineitem GROUP BY 1), q AS (SELECT x AS x0, s AS s0, lead(x) OVER (ORDER BY x) AS x1, lead(s) OVER (ORDER BY x) AS s1 FROM s),
p AS (SELECT o_orderkey, o_custkey % 520 / 10.0 AS px FROM orders), c AS (SELECT *, least(greatest(px, (SELECT min(x) FROM s)), (SELECT max(x) FROM s) - 1) AS ix FROM p)
SELECT o_orderkey, round(s0 + (px - x0) * (s1 - s0) / (x1 - x0), 6) AS s FROM c JOIN q ON x0 <= ix AND ix < x1""")
def interp_stripe(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripe = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("x")).agg(F.avg("l_extendedprice").alias("s"))
    p = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 520 / 10).alias("px"))
    return joins.from_stripe(p, stripe, "px", "s").select("o_orderkey", F.round("s", 6).alias("s"))


_RASTER = "SELECT vec_id AS label, CAST((i - 1) % 8 AS INTEGER) AS x, CAST((i - 1) // 8 AS INTEGER) AS y, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings)"


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("label"), F.posexplode("embedding").alias("i", "v"))
    return e.select("label", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.col("v").cast("double").alias("v"))


@query(f"WITH p AS ({_RASTER}) SELECT a.label, count(*) AS pairs, round(sum(a.v * b.v), 6) AS product FROM p a JOIN p b ON a.label = b.label AND b.x = a.x + 1 AND b.y = a.y GROUP BY 1")
def neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raster(spark, sf_dir)
    right = p.select("label", (F.col("x") - 1).alias("x"), "y", F.col("v").alias("w"))
    return rounded(p.join(right, ["label", "x", "y"]).groupBy("label").agg(F.count("*").alias("pairs"), F.sum(F.col("v") * F.col("w")).alias("product")))


@query("""WITH b AS (SELECT l_suppkey AS label, min(l_quantity) AS l, min(l_linenumber) AS t, max(l_quantity) - min(l_quantity) + 1 AS w, max(l_linenumber) - min(l_linenumber) + 1 AS h FROM lineitem GROUP BY 1),
x AS (SELECT label, t, h, unnest(generate_series(CAST(ceil(l / 16) - 1 AS BIGINT), CAST(ceil((l + w) / 16) - 1 AS BIGINT))) AS tx FROM b)
SELECT label, tx, ty, ty * 8 + tx AS tile_id FROM (SELECT label, tx, unnest(generate_series(CAST(ceil(t / 4) - 1 AS BIGINT), CAST(ceil((t + h) / 4) - 1 AS BIGINT))) AS ty FROM x)""")
def roi_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.extract(pixels(spark, sf_dir), ["label"], [features.Location()])
    boxes = f.select("label", *(F.col(f"Location_BBox_{c.upper()}").alias(c) for c in "ltwh"))
    return joins.boxes_to_tiles(boxes, (16, 4), 8).select("label", "tx", "ty", "tile_id")


@query(f"WITH p AS ({_PIXELS}), q AS (SELECT *, avg(v) OVER (PARTITION BY label) AS mu FROM p) SELECT label, round(sqrt(sum((v - mu) * (v - mu)) / (count(*) - 1)), 6) AS std FROM q GROUP BY label")
def broadcast_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("v") - F.col("mu")
    p = joins.with_group_stats(pixels(spark, sf_dir), ["label"], {"mu": F.avg("v")})
    return rounded(p.groupBy("label").agg(F.sqrt(F.sum(d * d) / (F.count("*") - 1)).alias("std")))


@query(f"WITH p AS ({_PIXELS}) SELECT label, count(*) AS area, round(avg(v), 6) AS mean FROM p GROUP BY label")
def feature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    one = features.extract(p, ["label"], [features.Ellipse()]).select("label", F.col("Shape_Area").alias("area"))
    two = features.extract(p, ["label"], [features.Intensity("v")]).select("label", F.round("Intensity_v_Mean", 6).alias("mean"))
    return one.join(two, "label")


@query("""SELECT c_custkey, s_suppkey, round(d, 6) AS distance FROM (SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS d, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS i FROM customer, supplier) WHERE i = 1""")
def nearest_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_acctbal", "b")
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_acctbal", "b")
    return joins.nearest(c, s, "c_custkey", "s_suppkey", ["b"], 50.0).withColumn("distance", F.round("distance", 6))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.member_of(table(spark, sf_dir, "customer"), urgent, ["c_custkey"]).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.not_member_of(table(spark, sf_dir, "customer"), orders, ["c_custkey"]).select("c_custkey")


@query("SELECT CAST(floor((value - 0.0) / 25) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1")
def bin_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(grid.rect_bin(F.col("value"), 25).alias("bin")).agg(F.count("*").alias("n"))


# ---- windows

_HOURLY = "SELECT event_type, date_trunc('hour', ts) AS h, sum(value) AS v FROM events GROUP BY ALL"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.sum("value").alias("v"))


def _by(half: int | None = None):
    w = Window.partitionBy("event_type").orderBy("h")
    return w if half is None else w.rowsBetween(-half, half)


@query(f"SELECT event_type, h, round(sum(v) OVER (PARTITION BY event_type ORDER BY h ROWS UNBOUNDED PRECEDING), 4) AS running, round(sum(v) OVER (PARTITION BY event_type), 4) AS total FROM ({_HOURLY})")
def running_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    up_to = _by().rowsBetween(Window.unboundedPreceding, 0)
    return hourly(spark, sf_dir).select("event_type", "h", F.round(F.sum("v").over(up_to), 4).alias("running"), F.round(F.sum("v").over(Window.partitionBy("event_type")), 4).alias("total"))


@query(f"SELECT event_type, h, round(v - lag(v) OVER (PARTITION BY event_type ORDER BY h), 4) AS difference FROM ({_HOURLY})")
def adjacent_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).select("event_type", "h", F.round(F.col("v") - F.lag("v").over(_by()), 4).alias("difference"))


@query(f"SELECT event_type, h, round(median(v) OVER (PARTITION BY event_type ORDER BY h ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING), 4) AS m FROM ({_HOURLY})")
def running_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = hourly(spark, sf_dir)
    return df.select("event_type", "h", F.round(binning.running_median(df, ["event_type"], "h", "v"), 4).alias("m"))


@query(f"SELECT event_type, h, round(v, 4) AS v FROM (SELECT *, max(v) OVER (PARTITION BY event_type ORDER BY h ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS m FROM ({_HOURLY})) WHERE v = m")
def local_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = hourly(spark, sf_dir).withColumn("m", F.max("v").over(_by(15)))
    return df.filter("v = m").select("event_type", "h", F.round("v", 4).alias("v"))


@query(f"SELECT event_type, max(h) AS last FROM ({_HOURLY}) WHERE v > 300 GROUP BY 1")
def last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).filter("v > 300").groupBy("event_type").agg(F.max("h").alias("last"))


@query(f"SELECT event_type, h, coalesce(lead(h) OVER o, first(h) OVER o) AS following FROM ({_HOURLY}) WINDOW o AS (PARTITION BY event_type ORDER BY h)")
def next_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.first("h").over(_by())
    return hourly(spark, sf_dir).select("event_type", "h", F.coalesce(F.lead("h").over(_by()), first).alias("following"))


# ---- texture


def _haralick_sql(distance: int) -> str:
    steps = ", ".join(f"({k}, {dx * distance}, {dy * distance})" for k, (dy, dx) in enumerate(texture.DIRECTIONS))
    ln = lambda p: f"sum(CASE WHEN {p} > 0 THEN {p} * ln({p}) ELSE 0 END)"
    cols = {
        "Contrast": "con", "Correlation": "CASE WHEN abs(va) > 1e-12 THEN (ij - mu * mu) / va END", "DifferenceEntropy": "de", "DifferenceVariance": "dv", "Energy": "en", "Entropy": "h",
        "InformationCorrelation1": "CASE WHEN hx > 1e-12 THEN (h - h1) / hx END", "InformationCorrelation2": "sqrt(greatest(1 - exp(-2 * (h2 - h)), 0))", "InverseDifferenceMoment": "idm",
        "SumAverage": "sa", "SumEntropy": "se", "SumOfSquaresVariance": "va", "SumVariance": "sv",
    }
    out = ", ".join(f"round(sum(coalesce({c}, 0)) / 4, 10) AS HaralickTexture_v_{n}_{distance}" for n, c in cols.items())
    return f"""
WITH p AS ({_RASTER}), r AS (SELECT label, min(v) AS mn, max(v) AS mx FROM p GROUP BY 1),
l AS (SELECT label, x, y, CAST(least(floor(8 * (v - mn) / (mx + 1e-6 - mn) + 1), 8) AS INTEGER) AS q FROM p JOIN r USING (label)),
s(k, dx, dy) AS (VALUES {steps}), a AS (SELECT a.label, k, a.q AS i, b.q AS j FROM l a JOIN s ON true JOIN l b ON b.label = a.label AND b.x = a.x + dx AND b.y = a.y + dy),
u AS (SELECT label, k, i, j FROM a UNION ALL SELECT label, k, j, i FROM a), c AS (SELECT label, k, i, j, count(*) AS c FROM u GROUP BY ALL),
m AS (SELECT label, k, i, j, c / sum(c) OVER (PARTITION BY label, k) AS p FROM c),
px AS (SELECT label, k, i, sum(p) AS px FROM m GROUP BY ALL), mo AS (SELECT label, k, sum(i * px) AS mu, sum(i * i * px) - sum(i * px) * sum(i * px) AS va, -{ln("px")} AS hx FROM px GROUP BY ALL),
su AS (SELECT label, k, t, sum(p) AS q FROM (SELECT label, k, i + j AS t, p FROM m) GROUP BY ALL), sm AS (SELECT label, k, sum(t * q) AS sa, sum(t * t * q) - sum(t * q) * sum(t * q) AS sv, -{ln("q")} AS se FROM su GROUP BY ALL),
di AS (SELECT label, k, t, sum(p) AS q FROM (SELECT label, k, abs(i - j) AS t, p FROM m) GROUP BY ALL), dm AS (SELECT label, k, sum(t * t * q) - sum(t * q) * sum(t * q) AS dv, -{ln("q")} AS de FROM di GROUP BY ALL),
i1 AS (SELECT m.label, m.k, -sum(m.p * ln(a.px * b.px)) AS h1 FROM m JOIN px a ON a.label = m.label AND a.k = m.k AND a.i = m.i JOIN px b ON b.label = m.label AND b.k = m.k AND b.i = m.j GROUP BY ALL),
i2 AS (SELECT a.label, a.k, -sum(a.px * b.px * ln(a.px * b.px)) AS h2 FROM px a JOIN px b ON a.label = b.label AND a.k = b.k GROUP BY ALL),
ce AS (SELECT label, k, sum((i - j) * (i - j) * p) AS con, sum(i * j * p) AS ij, sum(p * p) AS en, -{ln("p")} AS h, sum(p / (1 + (i - j) * (i - j))) AS idm FROM m GROUP BY ALL)
SELECT label, {out} FROM ce JOIN mo USING (label, k) JOIN sm USING (label, k) JOIN dm USING (label, k) JOIN i1 USING (label, k) JOIN i2 USING (label, k) GROUP BY label"""


@query(_haralick_sql(1))
def glcm_haralick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(texture.haralick(raster(spark, sf_dir), ["label"], "v", (1,)), 10)


@query(_haralick_sql(3))
def glcm_haralick_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(texture.haralick(raster(spark, sf_dir), ["label"], "v", (3,)), 10)


# ---- order, sets, scalars


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def top_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10).select("s_suppkey", "s_acctbal")


@query("SELECT l_returnflag, arg_max(l_orderkey, struct_pack(p := l_extendedprice, k := -l_orderkey)) AS l_orderkey FROM lineitem GROUP BY 1")
def argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.max_by("l_orderkey", F.struct("l_extendedprice", -F.col("l_orderkey"))).alias("l_orderkey"))


@query("SELECT s_suppkey FROM (SELECT s_suppkey FROM supplier ORDER BY md5(CAST(s_suppkey AS VARCHAR) || '/7'), s_suppkey LIMIT 10) ORDER BY s_suppkey")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten objects without replacement by a seeded order, ids sorted."""
    return table(spark, sf_dir, "supplier").orderBy(F.md5(F.concat(F.col("s_suppkey").cast("string"), F.lit("/7")).cast("binary")), "s_suppkey").limit(10).select("s_suppkey").orderBy("s_suppkey")


@query(f"WITH p AS ({_PIXELS}) SELECT block, label, count(*) AS area FROM p GROUP BY ALL ORDER BY block, label")
def block_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy("block", "label").agg(F.count("*").alias("area")).orderBy("block", "label")


@query("SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def union_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1")
def unique_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("nation"))
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).distinct().subtract(s)


@query("""SELECT event_id, CAST(floor(value) AS BIGINT) AS lo, CAST(ceil(value) AS BIGINT) AS hi, round(value) AS whole, CAST(event_id % 7 AS BIGINT) AS rest, round(sqrt(value), 6) AS root, round(power(value, 1.5), 4) AS power_,
round(exp(-value / 100), 6) AS e, round(ln(value), 6) AS ln_, round(log2(value), 6) AS log2_, round(least(value, 100), 6) AS least_, round(greatest(value, 100), 6) AS greatest_, round(cos(radians(value)), 6) AS cos_, round(sin(radians(value)), 6) AS sin_,
lower(event_type) AS low, replace(event_type, 'c', 'k') AS replaced, starts_with(event_type, 'c') AS starts, ends_with(event_type, 'k') AS ends, contains(event_type, 'r') AS has_r, concat_ws('_', event_type, CAST(event_id AS VARCHAR)) AS name,
CAST(round(255 * least(greatest(value / 400, 0), 1)) AS INTEGER) AS byte, TRY_CAST(substr(event_type, 1, 1) AS DOUBLE) AS number, CASE WHEN value > 250 THEN NULL ELSE round(value, 2) END AS missing FROM events""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, t = F.col("value"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", F.floor(v).alias("lo"), F.ceil(v).alias("hi"), F.round(v).alias("whole"), (F.col("event_id") % 7).cast("long").alias("rest"), F.round(F.sqrt(v), 6).alias("root"), F.round(F.pow(v, F.lit(1.5)), 4).alias("power_"),
        F.round(F.exp(-v / 100), 6).alias("e"), F.round(stats.logarithm(v), 6).alias("ln_"), F.round(stats.logarithm(v, F.log2), 6).alias("log2_"), F.round(F.least(v, F.lit(100.0)), 6).alias("least_"), F.round(F.greatest(v, F.lit(100.0)), 6).alias("greatest_"),
        F.round(F.cos(F.radians(v)), 6).alias("cos_"), F.round(F.sin(F.radians(v)), 6).alias("sin_"), F.lower(t).alias("low"), F.replace(t, F.lit("c"), F.lit("k")).alias("replaced"), t.startswith("c").alias("starts"), t.endswith("k").alias("ends"),
        t.contains("r").alias("has_r"), F.concat_ws("_", t, F.col("event_id").cast("string")).alias("name"), F.round(255 * F.least(F.greatest(v / 400, F.lit(0.0)), F.lit(1.0))).cast("int").alias("byte"),
        F.substring(t, 1, 1).try_cast("double").alias("number"), F.round(stats.missing_to_null(F.when(v > 250, F.lit(float("nan"))).otherwise(v)), 2).alias("missing"),
    )


@query("SELECT CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy, CAST(gx * 0.25 AS DOUBLE) AS x, CAST(gy * 0.5 AS DOUBLE) AS y FROM generate_series(0, 8) a(gx), generate_series(0, 4) b(gy)")
def mesh_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spark.range(9).withColumnRenamed("id", "gx")
    return g.select("gx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("gy")).select("gx", "gy", (F.col("gx") * 0.25).alias("x"), (F.col("gy") * 0.5).alias("y"))


def parse_metadata(text: Column) -> Column:
    """Map of ``key = value`` fields between vertical bars; spaces in keys become underscores, other fields go under Extra."""
    parts = F.transform(F.split(text, "\\|"), lambda s: F.trim(s))
    fields = F.filter(parts, lambda s: s.contains("="))
    extra = F.array_join(F.filter(parts, lambda s: ~s.contains("=") & (s != "")), "|")
    entry = F.transform(fields, lambda s: F.struct(F.replace(F.trim(F.substring_index(s, "=", 1)), F.lit(" "), F.lit("_")).alias("key"), F.trim(F.regexp_extract(s, "=(.*)$", 1)).alias("value")))
    return F.map_from_entries(F.concat(entry, F.when(extra != "", F.array(F.struct(F.lit("Extra").alias("key"), extra.alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))))


@query("""SELECT event_id, event_type AS kind, round(value, 2) AS mpp, TRY_CAST(event_type AS DOUBLE) AS bad_number, 'scan ' || event_id AS extra FROM events""")
def metadata_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("scan "), F.col("event_id"), F.lit("| Stripe Kind = "), F.col("event_type"), F.lit(" |MPP = "), F.round("value", 2))
    m = table(spark, sf_dir, "events").select("event_id", parse_metadata(text).alias("m"))
    return m.select("event_id", F.col("m")["Stripe_Kind"].alias("kind"), F.col("m")["MPP"].try_cast("double").alias("mpp"), F.col("m")["Stripe_Kind"].try_cast("double").alias("bad_number"), F.col("m")["Extra"].alias("extra"))


@query("""WITH c AS (SELECT doc_id, 'quality' AS grp, CASE quality WHEN 1 THEN 'good' ELSE 'poor' END AS class FROM labels UNION ALL SELECT doc_id, 'tone', CASE toxic WHEN 1 THEN 'toxic' ELSE 'clean' END FROM labels),
r(grp, class, other, effect) AS (VALUES ('tone', 'toxic', 'good', 1), ('tone', 'toxic', 'poor', 2)), o AS (SELECT c.doc_id, r.other, r.effect FROM c JOIN r USING (grp, class))
SELECT c.doc_id, c.grp AS "group", c.class, coalesce(o.effect <> 1, true) AS selected FROM c LEFT JOIN o ON o.doc_id = c.doc_id AND o.other = c.class""")
def classification_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices of classes under a table of rules: a chosen class leaves another as it is (0), turns it off (1) or on (2)."""
    labels = table(spark, sf_dir, "labels")
    quality = labels.select("doc_id", F.lit("quality").alias("group"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("class"))
    tone = labels.select("doc_id", F.lit("tone").alias("group"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("class"))
    rules = spark.createDataFrame([("tone", "toxic", "good", 1), ("tone", "toxic", "poor", 2)], "`group` string, `class` string, other string, effect int")
    chosen = quality.unionByName(tone)
    effects = chosen.join(F.broadcast(rules), ["group", "class"]).select("doc_id", F.col("other").alias("class"), "effect")  # a fixed table
    return chosen.join(effects, ["doc_id", "class"], "left").select("doc_id", "group", "class", F.coalesce(F.col("effect") != 1, F.lit(True)).alias("selected"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity / 10 < 6 AND l_extendedprice / 10000 < 8 AND l_extendedprice / 10000 > 0")
def in_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_extendedprice") / 10000
    return table(spark, sf_dir, "lineitem").filter((F.col("l_quantity") / 10 < 6) & (d < 8) & (d > 0)).select("l_orderkey", "l_linenumber")


@query(f"WITH h AS (SELECT gx, gy, count(*) AS z FROM ({_HEX}) GROUP BY ALL), m AS (SELECT max(greatest(ln(z), 0)) AS m FROM h) SELECT gx, gy, CAST(k AS INTEGER) AS k, round(gx * {2 * _R!r} + gy * {_R!r} + {5 / 3**0.5!r} * greatest(ln(z), 0) / m * cos(radians(60 * k + 30)), 6) AS x, round(gy * {1.5 * _S!r} + {5 / 3**0.5!r} * greatest(ln(z), 0) / m * sin(radians(60 * k + 30)), 6) AS y FROM h, m, generate_series(0, 5) g(k)")
def hex_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of density hexagons whose size goes with the logarithm of their count."""
    bins = binning.centres(binning.decimate(points(spark, sf_dir), "x", "y", "z", 5.0, "hexagonal", "density"), 5.0, "hexagonal")
    size = F.greatest(F.log("z"), F.lit(0.0))
    sized = bins.withColumn("m", bins.agg(F.max(size)).scalar())
    out = sized.select("gx", "gy", F.explode(grid.hex_corners(F.col("x"), F.col("y"), 5.0, size / F.col("m"))).alias("c"))
    return out.select("gx", "gy", "c.k", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))
