import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import kernels as K
from gridloom.operators import features, raster
from gridloom.operators import texture
from gridloom.plans.experiment import Experiment, load_features, save_features
from gridloom.sources import tiff

TILE = 32


def scene(h=128, w=192, seed=1):
    g = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    image = 0.1 + 0.01 * g.random((h, w))
    for cy, cx, r in ((20, 25, 9), (45, 44, 12), (45, 60, 12), (90, 100, 14), (70, 150, 10), (100, 30, 11)):
        image[(y - cy) ** 2 + (x - cx) ** 2 <= r * r] = 0.6 + 0.2 * g.random()
    return image.astype(np.float32)


def tiles_of(a):
    for ty in range(0, a.shape[0], TILE):
        for tx in range(0, a.shape[1], TILE):
            yield a[ty : ty + TILE, tx : tx + TILE]


def write(path, a, **kw):
    with open(path, "wb") as f:
        tiff.write_tiff(f, tiles_of(a), a.shape[1], a.shape[0], (TILE, TILE), **kw)


@pytest.fixture(scope="module")
def image(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tiff") / "a.tif")
    write(path, scene(), description="scan one|MPP = 0.5|Stripe Width = 64")
    return path


def test_tiff_round_trip(image):
    with open(image, "rb") as f:
        t = tiff.TiffImage(f, image)
        assert (t.width, t.height, t.across, t.down) == (192, 128, 6, 4)
        assert t.metadata == {"Extra": "scan one", "MPP": "0.5", "Stripe_Width": "64"}
        assert np.array_equal(t.trimmed_tile(7)[0], scene()[32:64, 32:64])


@pytest.mark.parametrize("a", [np.arange(70 * 45, dtype=np.uint16).reshape(70, 45), (np.arange(70 * 45) % 3 == 0).reshape(70, 45), np.arange(70 * 45, dtype=np.uint8).reshape(70, 45)])
@pytest.mark.parametrize("deflate", [True, False])
def test_ragged_edges_and_sample_kinds(a, deflate):
    f = io.BytesIO()
    tiff.write_tiff(f, tiles_of(a), a.shape[1], a.shape[0], (TILE, TILE), deflate=deflate)
    f.seek(0)
    t = tiff.TiffImage(f)
    scale = 1 if a.dtype == bool else np.iinfo(a.dtype).max
    for k in range(t.across * t.down):
        got, tx, ty = t.trimmed_tile(k)
        assert np.allclose(got, a[ty * TILE : ty * TILE + TILE, tx * TILE : tx * TILE + TILE] / scale)


def test_not_a_tiff():
    with pytest.raises(tiff.TiffError):
        tiff.TiffImage(io.BytesIO(b"GIF89a" + b"\0" * 20))


@pytest.fixture(scope="module")
def blocks(spark, image):
    spark.dataSource.register(tiff.TiffTiles)
    tiles = spark.read.format("tiff_tiles").option("tilesPerPartition", "5").load(image)
    return raster.to_blocks(tiles, 2, (TILE, TILE), "DAPI")


def test_tiles_and_blocks(spark, image, blocks):
    own = tiff.read_tiles(spark, image)
    assert own.count() == 24
    for r in blocks.collect():
        assert np.array_equal(raster.image_of(r).astype(np.float32), scene()[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w])
    assert {(r.tx, r.h, r.w) for r in raster.strips(own, "tx").collect()} == {(k, 128, 32) for k in range(6)}
    assert {(r.ty, r.h, r.w) for r in raster.strips(own, "ty").collect()} == {(k, 32, 192) for k in range(4)}


def test_thresholds_and_levels(blocks):
    t = raster.block_thresholds(blocks)
    for r in t.collect():
        a = scene()[r.by * 64 : r.by * 64 + 64, r.bx * 64 : r.bx * 64 + 64]
        assert np.isclose(r.threshold, 1.2 * raster.otsu_level(K.gaussian(a), "log"), rtol=1e-4)
    assert raster.otsu_level(np.full((4, 4), 2.0)) == 0
    two = np.r_[np.full(500, 0.2), np.full(300, 0.8)]
    assert 0.2 < raster.otsu_level(two) < 0.8
    for r in raster.levels(blocks, t).collect():
        assert 0.1 <= r.background < 0.12


def test_otsu_of_arrays_equals_the_grouped_one(spark):
    from gridloom.operators.blocks import otsu

    g = np.random.default_rng(4)
    v = np.r_[g.normal(0.3, 0.05, 800), g.normal(0.7, 0.05, 300)].clip(0.01)
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 1.0)] * 3, "k string, v double")
    for scale in ("linear", "log"):
        got = {r.k: r.threshold for r in otsu(df, ["k"], "v", scale).collect()}
        assert np.isclose(got["a"], raster.otsu_level(v, scale)) and got["b"] == 0


def test_partitioners(blocks):
    with pytest.raises(NotImplementedError):
        raster.GeometricPartition().partition(scene() > 0.3, scene())
    m = scene() > 0.3
    w = raster.DistanceWatershed(50, 10)
    assert K.label(w.partition(m, scene())).max() == K.label(m).max() + 1  # the touching pair is divided
    assert (raster.NoPartition().partition(m, scene()) == m).all()
    none = raster.DistanceWatershed(50, 10, contour=[(1e6, 1e6), (2e6, 1e6), (2e6, 2e6)])
    assert K.label(none.partition(m, scene())).max() == K.label(m).max()


def test_experiment(spark, blocks, tmp_path):
    groups = features.FeatureExtractor([features.BasicProps("DAPI"), features.Location(), features.Intensity("DAPI"), features.Ellipse(), features.RadialIntensity("DAPI", rings=3, width=4)])
    e = Experiment(blocks, ["DAPI"], "DAPI", raster.DistanceWatershed(50, 10), groups)
    with pytest.raises(ValueError):
        e.compute_features((64, 64))
    with pytest.raises(ValueError):
        Experiment(blocks, ["GFP"], "DAPI")
    e = e.create_object_mask()
    f = e.compute_features((64, 64), {"shape": {"descriptors": 6}, "granularity": {"spectrum": 3}})
    rows = f.collect()
    assert len(rows) >= 3
    masks = {(r.bx, r.by): raster.image_of(r) > 0 for r in e.masks.collect()}
    for r in rows:
        own = K.label(masks[r.bx, r.by]) == r.label
        y, x = np.nonzero(own)
        v = scene()[r.by * 64 : r.by * 64 + 64, r.bx * 64 : r.bx * 64 + 64][own].astype(float)
        assert r.BasicProps_Area == own.sum() and np.isclose(r.Location_Centroid_X, x.mean() + 1 + 64 * r.bx)
        assert np.isclose(r.Intensity_DAPI_Mean, v.mean()) and np.isclose(r.Intensity_DAPI_Std, v.std(ddof=1))
        n, d = len(v), v - v.mean()
        assert np.isclose(r.Intensity_DAPI_Skewness, np.sqrt(n * (n - 1)) / (n - 2) * (d**3).mean() / (d**2).mean() ** 1.5, atol=1e-5)
        ring = np.minimum(np.ceil(K.distance(np.pad(own, 1))[1:-1, 1:-1][own] / 4), 4)
        assert np.isclose(r.RadialIntensity_DAPI_Mean_W4_R1, v[ring == 1].mean())
        assert 0 < r.Shape_Solidity < 1.3
    assert e.correct_backgrounds().compute_features((64, 64)).count() == len(rows)
    save_features(f, str(tmp_path / "f"))
    again, absent = load_features(spark, str(tmp_path / "f"), ["Shape_Area", "Nothing"])
    assert again.count() == len(rows) and absent == ["Nothing"]
    with pytest.raises(Exception):
        save_features(f, str(tmp_path / "f"))


def test_pixels_are_the_objects(blocks):
    m = raster.object_masks(blocks, raster.block_thresholds(blocks), raster.DistanceWatershed(50, 10))
    total = sum(int((raster.image_of(r) > 0).sum()) for r in m.collect())
    assert raster.object_pixels(blocks, m).count() == total
    assert raster.object_pixels(blocks, m, cleared=True).count() <= total


def test_measures_and_surfaces(spark, blocks, tmp_path):
    e = Experiment(blocks, ["DAPI"], "DAPI", raster.DistanceWatershed(50, 10)).create_object_mask()
    props = {(r.bx, r.by, r.label): r for r in raster.measure_basic_props(blocks, e.masks, (64, 64)).collect()}
    total = {(r.bx, r.by, r.label): r.total for r in raster.measure_intensity(blocks, e.masks).collect()}
    assert set(props) == set(total) and all(np.isclose(total[k], r.BasicProps_Intensity_v_Integrated) for k, r in props.items())
    assert e.surface("thr").count() == 6 and e.surface("Sharp").columns == ["image_id", "bx", "by", "z"]
    with pytest.raises(ValueError):
        e.surface("x")
    raster.save_masks(e.masks, str(tmp_path / "m"))
    assert dict(spark.read.parquet(str(tmp_path / "m")).dtypes)["pixels"] == "array<boolean>"


def test_native_border_clearing(spark, blocks):
    from gridloom.operators import features as f

    m = raster.object_masks(blocks, raster.block_thresholds(blocks), raster.NoPartition())
    kept = f.without_border(raster.object_pixels(blocks, m), ["label"], ["bx", "by"], "x", "y", (F.lit(64), F.lit(64)))
    assert kept.count() == raster.object_pixels(blocks, m, cleared=True).count()


def test_option_names():
    from gridloom.functions.names import match_option

    assert match_option("back", ["BACKGROUND", "foreground"]) == "BACKGROUND" and match_option("a", ["a", "ab"]) == "a"
    for bad in ("", "z"):
        with pytest.raises(ValueError):
            match_option(bad, ["ab", "ac"])


def test_extract_images(spark, image):
    t = tiff.read_tiles(spark, image).withColumn("channel", F.lit("DAPI"))
    objects = spark.createDataFrame([(1, 46.0, 46.0), (2, 1.0, 1.0), (3, 192.0, 128.0)], "object_id long, x double, y double")
    got = {r.object_id: raster.image_of(r) for r in raster.extract_images(objects, t, (TILE, TILE), 6, (21, 31)).collect()}
    padded = np.pad(scene(), 40)
    for k, (x, y) in {1: (46, 46), 2: (1, 1), 3: (192, 128)}.items():
        assert np.allclose(got[k], padded[40 + y - 11 : 40 + y + 10, 40 + x - 16 : 40 + x + 15])
    small = raster.extract_images(objects, t, (TILE, TILE), 6, (21, 31), resize=(7, 7)).first()
    assert (small.h, small.w, len(small.pixels)) == (7, 7, 49)


def test_feature_groups_are_saved_and_checked(spark):
    g = features.RadialIntensity("GFP", distance="d", rings=2, width=3)
    assert features.FeatureGroup.from_json(g.to_json()) == g
    with pytest.raises(ValueError):
        features.FeatureExtractor([features.EmptyFeature(), features.Intensity("no")]).compute(spark.range(3), ["id"])


def test_corrections_from_the_image(spark):
    """A planted background, a slope of the factor and two bands: after correction the bands lie at 1 and 2."""
    g = np.random.default_rng(11)
    side, n = 128, 4
    yy, xx = np.mgrid[-6:7, -6:7]
    spot = np.clip(1 - (xx * xx + yy * yy) / 40, 0, None)
    image = np.zeros((side * n, side * n))
    true = {}
    for y in range(12, side * n - 8, 20):
        for x in range(12, side * n - 8, 20):
            if min(y % side, x % side) < 10 or max(y % side, x % side) > side - 11:
                continue
            band = 2.0 if g.random() < 0.25 else 1.0
            true[x + 1, y + 1] = band
            image[y - 6 : y + 7, x - 6 : x + 7] += spot * band * (1 + x / (side * n)) * g.normal(1, 0.02)
    image = (image + 0.4 + 0.002 * g.random(image.shape)) / 6
    rows = [("i", "DAPI", bx, by, bx * side, by * side, side, side, image[by * side : (by + 1) * side, bx * side : (bx + 1) * side].astype(np.float32).ravel().tolist()) for by in range(n) for bx in range(n)]
    rows += [("i", "GFP", *r[2:8], [0.5 * v + 0.1 for v in r[8]]) for r in rows]
    blocks = spark.createDataFrame(rows, raster.BLOCK)
    groups = features.FeatureExtractor([features.BasicProps("DAPI"), features.Intensity("DAPI"), features.Intensity("GFP"), features.Location()])
    e = Experiment(blocks, ["DAPI", "GFP"], "DAPI", raster.DistanceWatershed(30, 5), groups).create_object_mask(corrected=True)
    raw = {(round(r.Location_Centroid_X), round(r.Location_Centroid_Y)): r for r in e.compute_features((side, side)).collect()}
    done = e.correct((side, side), (float(side * n), float(side * n)), per_bin=20)
    out = {(round(r.Location_Centroid_X), round(r.Location_Centroid_Y)): r for r in done.compute_features((side, side)).collect()}
    assert set(out) == set(raw) and len(set(out) & set(true)) > 0.95 * len(true)
    for band in (1.0, 2.0):
        at = [k for k in out if true.get(k) == band]
        v, before = (np.array([t[k].Intensity_DAPI_Integrated for k in at]) for t in (out, raw))
        x = np.array([k[0] for k in at], float)
        thirds = lambda v: [float(np.median(v[(x >= side * n * k / 3) & (x < side * n * (k + 1) / 3)])) for k in range(3)]
        assert abs(np.median(v) - band) < 0.1 * band and np.ptp(thirds(before)) / np.mean(thirds(before)) > 0.3
        assert np.ptp(thirds(v)) < 0.15 * band and np.median(np.abs(v - np.median(v))) < 0.1


def test_columns_of_the_example(spark):
    """The options of the example give 122 feature columns of two channels; texture equals the relational operator's."""
    g = np.random.default_rng(12)
    a = K.gaussian(g.random((60, 70)), 3, 19)
    rows = [("i", c, 0, 0, 0, 0, 60, 70, (a * k).astype(np.float32).ravel().tolist()) for k, c in ((1.0, "DAPI"), (0.7, "GFP"))]
    mask = [("i", "DAPI", 0, 0, 0, 0, 60, 70, (a > np.quantile(a, 0.7)).astype(np.float32).ravel().tolist())]
    blocks, masks = spark.createDataFrame(rows, raster.BLOCK), spark.createDataFrame(mask, raster.BLOCK)
    channels = ["DAPI", "GFP"]
    groups = [features.Location(), features.Ellipse()]
    for c in channels:
        groups += [features.Intensity(c), features.RadialIntensity(c, rings=3, width=4)]
    e = Experiment(blocks, channels, "DAPI", raster.NoPartition(), features.FeatureExtractor(groups), masks)
    f = e.compute_features((70, 60), {"shape": {"vertices": 100, "descriptors": 20}, "granularity": {"spectrum": 7, "element": 10}, "haralick": {"distances": (3, 7)}})
    names = [c for c in f.columns if c not in ("image_id", "bx", "by", "label")]
    want = [f"Location_{n}" for n in ("Centroid_X", "Centroid_Y", "BBox_L", "BBox_T", "BBox_W", "BBox_H")]
    want += [f"Shape_{n}" for n in ("Area", "MajorAxisLength", "MinorAxisLength", "Eccentricity", "Solidity", "FormFactor")] + [f"Shape_FourierDescriptor_{k}" for k in range(2, 20)]
    for c in channels:
        want += [f"Intensity_{c}_{n}" for n in ("Integrated", "Mean", "Std", "Skewness", "Kurtosis")]
        want += [f"RadialIntensity_{c}_{n}_W4_{k}" for n in ("Mean", "Std") for k in ("Center", "R3", "R2", "R1")]
        want += [f"HaralickTexture_{c}_{n}_{d}" for n in texture.NAMES for d in (3, 7)] + [f"Granularity_{c}_E10_{k}" for k in range(1, 8)]
    assert len(names) == 122 and sorted(names) == sorted(want)
    rows = {r.label: r for r in f.collect()}
    flat = texture.haralick(e.pixels(), ["label"], "GFP", (3, 7)).collect()
    assert len(flat) == len(rows) > 2
    for r in flat:
        for n in texture.NAMES:
            for d in (3, 7):
                name = f"HaralickTexture_GFP_{n}_{d}"
                assert np.isclose(rows[r.label][name], r[name] or 0.0, atol=1e-6), (r.label, name)
