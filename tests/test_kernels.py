import numpy as np
import pytest

from gridloom.functions import kernels as K


def blobs(seed=1, shape=(30, 40), share=0.55):
    return np.random.default_rng(seed).random(shape) < share


def disk_image(size, *centres, r=10):
    y, x = np.mgrid[:size, :size]
    return np.any([(y - a) ** 2 + (x - b) ** 2 <= r * r for a, b in centres], axis=0)


def flood(mask, connectivity):
    out, n = np.zeros(mask.shape, int), 0
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    for x in range(mask.shape[1]):
        for y in range(mask.shape[0]):
            if mask[y, x] and not out[y, x]:
                n += 1
                stack = [(y, x)]
                out[y, x] = n
                while stack:
                    a, b = stack.pop()
                    for dy, dx in steps:
                        p, q = a + dy, b + dx
                        if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not out[p, q]:
                            out[p, q] = n
                            stack.append((p, q))
    return out


@pytest.mark.parametrize("connectivity", [4, 8])
def test_label(connectivity):
    for seed in range(5):
        m = blobs(seed)
        assert (K.label(m, connectivity) == flood(m, connectivity)).all()
    assert not K.label(np.zeros((3, 3), bool)).any()


def test_morphology_against_loops():
    a = np.random.default_rng(2).integers(0, 256, (12, 15)).astype(np.uint8)
    for element in (K.CROSS, K.SQUARE, K.disk(2), K.diamond(2)):
        at = K.offsets(element)
        low, high = np.zeros_like(a), np.zeros_like(a)
        for y in range(12):
            for x in range(15):
                near = [a[y + dy, x + dx] for dy, dx in at if 0 <= y + dy < 12 and 0 <= x + dx < 15]
                low[y, x], high[y, x] = min(near), max(near)
        assert (K.erode(a, element) == low).all() and (K.dilate(a, element) == high).all()
    assert (K.opening(a, K.CROSS) <= a).all()


def test_masked_opening_leaves_the_outside():
    a = np.random.default_rng(3).integers(0, 256, (10, 10)).astype(np.uint8)
    m = blobs(3, (10, 10))
    out = K.masked_opening(a, K.disk(1), m)
    assert (out[~m] == a[~m]).all() and (out[m] <= a[m]).all()


def test_distance_against_all_pairs():
    m = blobs(4, (20, 25), 0.8)
    zeros = np.argwhere(~m)
    want = np.array([[np.sqrt(((zeros - (y, x)) ** 2).sum(1).min()) for x in range(25)] for y in range(20)])
    assert np.allclose(K.distance(m), want)
    assert np.isinf(K.distance(np.ones((4, 4), bool))).all()


def test_gaussian_and_median():
    assert np.allclose(K.gaussian(np.full((9, 9), 3.0)), 3)
    a = np.zeros((15, 15))
    a[7, 7] = 1
    assert np.isclose(K.gaussian(a).sum(), 1) and np.allclose(K.gaussian(a), K.gaussian(a).T)
    a = np.random.default_rng(5).random((6, 7))
    p = np.pad(a, 1, mode="symmetric")
    assert np.allclose(K.median_filter(a, K.SQUARE), [[np.median(p[y : y + 3, x : x + 3]) for x in range(7)] for y in range(6)])


def test_holes_areas_and_border():
    m = disk_image(64, (30, 30), r=15)
    m[30, 30:34] = False
    m[20:24, 25:30] = False
    full = K.fill_holes(m, 10)
    assert full[30, 30:34].all() and not full[20:24, 25:30].any()
    two = disk_image(64, (5, 30), (40, 40), r=8)
    assert K.label(K.clear_border(two)).max() == 1 and K.clear_border(two)[40, 40]
    assert K.area_open(disk_image(64, (20, 20)) | disk_image(64, (50, 50), r=2), 30).sum() == disk_image(64, (20, 20)).sum()


def test_reconstruct_keeps_marked_objects():
    m = disk_image(40, (10, 10), (30, 30), r=5)
    marker = np.zeros_like(m)
    marker[10, 10] = True
    assert (K.reconstruct(marker.astype(np.uint8), m.astype(np.uint8)) == disk_image(40, (10, 10), r=5)).all()


def test_watershed_divides_touching_disks():
    m = disk_image(64, (30, 20), (30, 40), r=12)
    basins = K.watershed(-K.opening(K.distance(m), K.disk(2)) * m)
    assert K.label(m & (basins > 0)).max() == 2


def test_boundary_perimeter_hull():
    m = np.zeros((12, 14), bool)
    m[2:7, 3:11] = True
    line = K.boundary(m)
    edge = m & ~K.erode(m, K.CROSS)
    assert set(map(tuple, line.tolist())) == set(map(tuple, np.argwhere(edge).tolist()))
    assert (line[0] == line[-1]).all() and len(line) == edge.sum() + 1
    assert np.isclose(K.perimeter(line), 0.98 * 22 - 0.091 * 4) and np.isclose(K.hull_area(line), 4 * 7)
    for seed in range(20):
        own = K.label(blobs(seed, (9, 9), 0.5)) == 1
        line = K.boundary(own)
        assert (np.abs(np.diff(line, axis=0)).max(1, initial=0) <= 1).all() and own[tuple(line.T)].all()
    one = np.zeros((3, 3), bool)
    one[1, 1] = True
    assert K.perimeter(K.boundary(one)) == 0 and K.hull_area(K.boundary(one)) == 0 and len(K.boundary(np.zeros((2, 2), bool))) == 0


def test_fourier_descriptors_ignore_place_and_size():
    line = K.boundary(disk_image(64, (30, 30), (38, 34), r=12)).astype(float)
    a, z = K.fourier_descriptors(line, 60, 12)
    b, _ = K.fourier_descriptors(3 * line + 17, 60, 12)
    assert len(a) == 10 and np.allclose(a, b, rtol=1e-6)
    back = K.inverse_fourier_descriptors(z, 60, 12)
    assert np.abs(back - (np.interp(np.linspace(0, len(line) - 1, 60), np.arange(len(line)), line[:, 0]) + 1j * np.interp(np.linspace(0, len(line) - 1, 60), np.arange(len(line)), line[:, 1]))).max() < 2


def test_granularity_sums_to_what_openings_remove():
    g = np.random.default_rng(6)
    labels = K.label(disk_image(50, (15, 15), (35, 33), r=9))
    image = g.random((50, 50)) * 0.5 + 0.5 * (labels > 0)
    x = K.granularity(image, labels, spectrum=12, element=12)
    assert x.shape == (2, 12) and (x >= -1e-9).all() and (x.sum(1) <= 100 + 1e-9).all()


def test_resize_and_interpolation():
    a = np.add.outer(np.arange(12.0), 2 * np.arange(10.0))
    assert np.allclose(K.resize(a, (12, 10)), a) and np.allclose(K.resize(np.ones((8, 8)), (3, 5)), 1)
    x, y = np.arange(10.0), np.arange(12.0)
    assert np.allclose(K.bilinear(a, x, y, np.array([2.5, -3, 20]), np.array([1.25, 4, 30])), [6.25, 4, 29])
    assert np.allclose(K.linear_beyond(x, 2 * x, np.array([-2.0, 3.3, 15])), [-4, 6.6, 30])
    assert np.allclose(K.highpass(np.sin(np.arange(100) * 2 * np.pi / 4) + 5, 20, 1), np.sin(np.arange(100) * 2 * np.pi / 4), atol=1e-9)


def test_sharpness_of_a_constant():
    assert K.sharpness(np.ones((8, 8))) == 1 / 8
