"""Array kernels of images, in numpy. Arrays are indexed [row, column]; masks are boolean.

Labels are numbered by the place of an object's first pixel in column order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

CROSS = np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]], bool)
SQUARE = np.ones((3, 3), bool)


def disk(radius: float) -> np.ndarray:
    r = int(np.ceil(radius))
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    return x * x + y * y <= radius * radius


def diamond(radius: int) -> np.ndarray:
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    return np.abs(x) + np.abs(y) <= radius


def offsets(element: np.ndarray) -> list[tuple[int, int]]:
    cy, cx = element.shape[0] // 2, element.shape[1] // 2
    return [(y - cy, x - cx) for y, x in np.argwhere(element).tolist()]


def shifted(a: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """``out[y, x] = a[y + dy, x + dx]``, with ``fill`` outside."""
    out = np.full(a.shape, fill, a.dtype)
    h, w = a.shape
    ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    if ys.start < ys.stop and xs.start < xs.stop:
        out[ys, xs] = a[ys.start + dy : ys.stop + dy, xs.start + dx : xs.stop + dx]
    return out


def _bounds(dtype: np.dtype) -> tuple:
    if dtype == bool:
        return False, True
    if np.issubdtype(dtype, np.floating):
        return -np.inf, np.inf
    return np.iinfo(dtype).min, np.iinfo(dtype).max


def _runs(element: np.ndarray) -> list[tuple[int, int, int]] | None:
    """(row, first column, length) of an element's rows, relative to its centre; None if a row has gaps."""
    cy, cx = element.shape[0] // 2, element.shape[1] // 2
    out = []
    for y in np.flatnonzero(element.any(1)).tolist():
        x = np.flatnonzero(element[y])
        if x[-1] - x[0] + 1 != len(x):
            return None
        out.append((y - cy, int(x[0]) - cx, len(x)))
    return out


def _extreme(a: np.ndarray, element: np.ndarray, pick, fill, mirrored: bool) -> np.ndarray:
    """Minimum or maximum over the (mirrored) element's places around each pixel, with ``fill`` outside.

    Rows of an element are runs; the extremes of all runs that begin at a pixel come from those of half their length.
    """
    runs = _runs(element) if element.sum() > 9 else None
    out = np.full(a.shape, fill, a.dtype)
    if runs is None:
        for dy, dx in offsets(element):
            pick(out, shifted(a, -dy, -dx, fill) if mirrored else shifted(a, dy, dx, fill), out)
        return out
    if mirrored:
        runs = [(-dy, 1 - x - n, n) for dy, x, n in runs]
    h, w = a.shape
    left, right = max(0, -min(x for _, x, _ in runs)), max(0, max(x + n for _, x, n in runs))
    powers = [np.pad(a, ((0, 0), (left, right)), constant_values=fill)]
    while 2 << len(powers) - 1 <= max(n for _, _, n in runs):
        half = 1 << len(powers) - 1
        powers.append(pick(powers[-1][:, :-half], powers[-1][:, half:]))
    held: dict[tuple[int, int], np.ndarray] = {}
    for dy, x, n in runs:
        if (x, n) not in held:
            k = n.bit_length() - 1
            at = left + x
            held[x, n] = pick(powers[k][:, at : at + w], powers[k][:, at + n - (1 << k) : at + n - (1 << k) + w])
        ys = slice(max(0, -dy), min(h, h - dy))
        if ys.start < ys.stop:
            pick(out[ys], held[x, n][ys.start + dy : ys.stop + dy], out[ys])
    return out


def erode(a: np.ndarray, element: np.ndarray) -> np.ndarray:
    return _extreme(a, element, np.minimum, _bounds(a.dtype)[1], False)


def dilate(a: np.ndarray, element: np.ndarray) -> np.ndarray:
    return _extreme(a, element, np.maximum, _bounds(a.dtype)[0], True)


def opening(a: np.ndarray, element: np.ndarray) -> np.ndarray:
    return dilate(erode(a, element), element)


def masked(operation, a: np.ndarray, element: np.ndarray, mask: np.ndarray, fill) -> np.ndarray:
    """An erosion or dilation inside a mask alone; outside, the values stay."""
    inside = a.copy()
    inside[~mask] = fill
    return np.where(mask, operation(inside, element), a)


def masked_opening(a: np.ndarray, element: np.ndarray, mask: np.ndarray) -> np.ndarray:
    low, high = _bounds(a.dtype)
    return masked(dilate, masked(erode, a, element, mask, high), element, mask, low)


def gaussian(a: np.ndarray, sigma: float = 1.0, size: int = 7) -> np.ndarray:
    """Separable Gaussian with mirrored edges."""
    half = size // 2
    k = np.exp(-np.arange(-half, half + 1) ** 2 / (2 * sigma * sigma))
    k /= k.sum()
    out = np.asarray(a, float)
    for axis in (0, 1):
        padded = np.pad(out, [(half, half) if x == axis else (0, 0) for x in (0, 1)], mode="symmetric")
        n = out.shape[axis]
        out = sum(w * np.take(padded, range(i, i + n), axis) for i, w in enumerate(k))
    return out


def median_filter(a: np.ndarray, element: np.ndarray) -> np.ndarray:
    """Rank filter with mirrored edges; missing values are left out."""
    hy, hx = element.shape[0] // 2, element.shape[1] // 2
    padded = np.pad(np.asarray(a, float), ((hy, hy), (hx, hx)), mode="symmetric")
    h, w = a.shape
    stack = [padded[hy + dy : hy + dy + h, hx + dx : hx + dx + w] for dy, dx in offsets(element)]
    with np.errstate(all="ignore"):
        return np.nanmedian(np.array(stack), axis=0)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each node's component."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def label(mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Connected components, numbered from 1."""
    return label_equal(np.asarray(mask).astype(np.int8), connectivity, mask)


def label_equal(values: np.ndarray, connectivity: int, mask: np.ndarray) -> np.ndarray:
    """Components of neighbours of equal value inside a mask."""
    h, w = values.shape
    mask = np.asarray(mask, bool)
    # pixels of the mask are numbered in column order, so that the least member is the first pixel
    inside = mask.T.ravel()
    index = (np.cumsum(inside) - 1).reshape(w, h).T
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    ends_i, ends_j = [], []
    for dy, dx in steps:
        y0, y1 = slice(0, h - dy), slice(dy, h)
        x0, x1 = (slice(0, w - dx), slice(dx, w)) if dx >= 0 else (slice(-dx, w), slice(0, w + dx))
        joined = mask[y0, x0] & mask[y1, x1] & (values[y0, x0] == values[y1, x1])
        ends_i.append(index[y0, x0][joined])
        ends_j.append(index[y1, x1][joined])
    root = _roots(int(inside.sum()), np.concatenate(ends_i), np.concatenate(ends_j))
    number = np.cumsum(root == np.arange(len(root)))[root]
    out = np.zeros((h, w), np.int32)
    out.T[inside.reshape(w, h)] = number
    return out


def areas(labels: np.ndarray) -> np.ndarray:
    """Pixels of each label; place 0 is the background."""
    return np.bincount(labels.ravel(), minlength=labels.max(initial=0) + 1)


def area_open(mask: np.ndarray, least: int) -> np.ndarray:
    found = label(mask)
    keep = areas(found) >= least
    keep[0] = False
    return keep[found]


def fill_holes(mask: np.ndarray, below: int = 10) -> np.ndarray:
    """Fills holes (4-connected, not touching the border) of fewer pixels than ``below``."""
    holes = label(~mask, 4)
    small = areas(holes) < below
    border = np.unique(np.concatenate([holes[0], holes[-1], holes[:, 0], holes[:, -1]]))
    small[border] = False
    small[0] = False
    return mask | small[holes]


def clear_border(mask: np.ndarray) -> np.ndarray:
    """Without the objects that touch the border."""
    found = label(mask)
    touch = np.zeros(found.max(initial=0) + 1, bool)
    touch[np.concatenate([found[0], found[-1], found[:, 0], found[:, -1]])] = True
    touch[0] = True
    return ~touch[found]


def reconstruct(marker: np.ndarray, limit: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Grey reconstruction of the marker by dilation under the limit.

    While much changes, whole images are dilated; after that only the neighbours of what has changed are looked at.
    """
    element, now = (SQUARE if connectivity == 8 else CROSS), np.minimum(marker, limit)
    while True:
        after = np.minimum(dilate(now, element), limit)
        changed = np.flatnonzero(after != now)
        now = after
        if len(changed) <= now.size // 20:
            break
    if not len(changed):
        return now
    h, w = now.shape
    low = _bounds(now.dtype)[0]
    padded, top = (np.pad(x, 1, constant_values=low).ravel() for x in (now, limit))
    changed = (changed // w + 1) * (w + 2) + changed % w + 1
    steps = [dy * (w + 2) + dx for dy, dx in offsets(element) if (dy, dx) != (0, 0)]
    last = np.zeros(len(padded), np.int64)
    while len(changed):
        risen, own = [], padded[changed]
        for step in steps:
            there = changed + step
            value = np.minimum(own, top[there])
            higher = value > padded[there]
            there = there[higher]
            np.maximum.at(padded, there, value[higher])
            risen.append(there)
        changed = np.concatenate(risen)
        last[changed] = np.arange(len(changed))
        changed = changed[last[changed] == np.arange(len(changed))]  # each place once
    return padded.reshape(h + 2, w + 2)[1:-1, 1:-1]


def distance(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pixel to the nearest one outside the mask; infinite where there is none."""
    h, w = mask.shape
    far = float(h + w)
    g = np.where(mask, far, 0.0)
    for y in range(1, h):
        np.minimum(g[y], g[y - 1] + 1, out=g[y])
    for y in range(h - 2, -1, -1):
        np.minimum(g[y], g[y + 1] + 1, out=g[y])
    square = np.where(g >= far, np.inf, g * g)
    best = square.copy()
    for d in range(1, w):
        if d * d >= best.max(initial=0):
            break
        best[:, d:] = np.minimum(best[:, d:], square[:, :-d] + d * d)
        best[:, :-d] = np.minimum(best[:, :-d], square[:, d:] + d * d)
    return np.sqrt(best)


def regional_minima(a: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Pixels of plateaus without a lower neighbour; with a mask, plateaus inside it."""
    values = np.round(a, 9)
    flat = label_equal(values, 8, np.ones(a.shape, bool) if mask is None else mask)
    lower = np.zeros(flat.max(initial=0) + 1, bool)
    for dy, dx in offsets(SQUARE):
        lower[flat[shifted(values, dy, dx, np.inf) < values]] = True
    return ~lower[flat] if mask is None else ~lower[flat] & mask


def watershed(a: np.ndarray) -> np.ndarray:
    """Basins of the regional minima, flooded in order of height; ridges between basins are 0."""
    found = label(regional_minima(a))
    if found.max(initial=0) == 1:  # nothing to divide
        return np.ones_like(found)
    h, w = a.shape
    across = w + 2
    # lists with a border of -1, as single places of arrays are slow to read
    basins = np.pad(found, 1, constant_values=-1).ravel().tolist()
    height = np.pad(np.asarray(a, float), 1).ravel().tolist()
    done = [b != 0 for b in basins]
    around = [dy * across + dx for dy, dx in offsets(SQUARE) if (dy, dx) != (0, 0)]
    queue: list[tuple[float, int, int]] = []
    order = 0

    def push(at: int) -> None:
        nonlocal order
        for step in around:
            p = at + step
            if not done[p]:
                done[p] = True
                heapq.heappush(queue, (height[p], order, p))
                order += 1

    for y, x in np.argwhere(found.T > 0)[:, ::-1].tolist():
        push((y + 1) * across + x + 1)
    while queue:
        _, _, at = heapq.heappop(queue)
        near = {basins[at + step] for step in around} - {0, -1}
        if len(near) == 1:
            basins[at] = near.pop()
            push(at)
    return np.array(basins, found.dtype).reshape(h + 2, across)[1:-1, 1:-1]


#: Steps around a pixel, clockwise from up.
_AROUND = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def boundary(mask: np.ndarray) -> np.ndarray:
    """Outer boundary of the first object as (row, column), clockwise and closed, by Moore tracing."""
    m = np.pad(mask, 1)
    first = np.argwhere(m.T)
    if not len(first):
        return np.zeros((0, 2), int)
    start = (int(first[0][1]), int(first[0][0]))
    out, now, back = [start], start, 6  # entered from the left
    first_step = None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            y, x = now[0] + _AROUND[d][0], now[1] + _AROUND[d][1]
            if m[y, x]:
                break
        else:
            break
        if now == start and first_step == d:
            break
        if first_step is None:
            first_step = d
        # the next search begins behind the place from which the pixel was entered
        now, back = (y, x), (d + 5) % 8 if d % 2 else (d + 6) % 8
        out.append(now)
    closed = out if len(out) == 1 or out[-1] == start else [*out, start]
    return np.array(closed) - 1


def perimeter(points: np.ndarray) -> float:
    """Length of a closed chain of pixels, weighted by straight steps, diagonal steps and corners."""
    if len(points) <= 2:
        return 0.0
    step = np.diff(points, axis=0)
    straight = (step == 0).any(1)
    corners = (step != np.roll(step, -1, axis=0)).any(1).sum()
    return float(0.980 * straight.sum() + 1.406 * (~straight).sum() - 0.091 * corners)


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull, by a monotone chain and the shoelace formula."""
    pts = sorted(set(map(tuple, np.asarray(points).tolist())))
    if len(pts) < 3:
        return 0.0

    def chain(order: list) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = np.array(chain(pts) + chain(pts[::-1]), float)
    x, y = hull[:, 0], hull[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def fourier_descriptors(points: np.ndarray, vertices: int = 100, kept: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Invariant descriptors of a boundary, and the coefficients that give its shape back."""
    at = np.linspace(0, len(points) - 1, vertices)
    node = np.arange(len(points))
    z = np.fft.fft(np.interp(at, node, points[:, 0]) + 1j * np.interp(at, node, points[:, 1]))
    half = int(kept / 2 + 0.5)
    z = np.concatenate([z[:half], z[vertices - half :]])
    size = np.abs(z)
    size[0] = 0
    return (size / size[-1] if size[-1] else np.full_like(size, np.nan))[1:-1], z


def inverse_fourier_descriptors(z: np.ndarray, vertices: int = 100, kept: int = 10) -> np.ndarray:
    """A boundary as complex numbers from coefficients, or from descriptors (their ends are put back)."""
    if len(z) == kept - 2:
        z = np.concatenate([[0], z, [1]])
    half = int(kept / 2 + 0.5)
    return np.fft.ifft(np.concatenate([z[:half], np.zeros(vertices - len(z)), z[half:]]))


def to_uint8(a: np.ndarray) -> np.ndarray:
    return np.floor(255 * np.clip(np.nan_to_num(a), 0, 1) + 0.5).astype(np.uint8)


def resize(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bicubic resize, with averaging where it shrinks."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = m / n
        wide = max(1.0, 1 / scale)
        centre = (np.arange(m) + 0.5) / scale - 0.5
        t = np.abs(centre[:, None] - np.arange(-int(4 * wide), n + int(4 * wide))[None, :]) / wide
        w = np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t <= 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0))
        w /= w.sum(1, keepdims=True)
        folded = np.zeros((m, n))
        columns = np.arange(-int(4 * wide), n + int(4 * wide))
        mirrored = np.mod(columns, 2 * n)
        mirrored = np.where(mirrored < n, mirrored, 2 * n - 1 - mirrored)
        np.add.at(folded.T, mirrored, w.T)
        return folded

    a = np.asarray(a, float)
    return weights(a.shape[0], shape[0]) @ a @ weights(a.shape[1], shape[1]).T


def granularity(image: np.ndarray, labels: np.ndarray, spectrum: int = 10, element: float = 10, sample: float = 1.0, background_sample: float = 1.0) -> np.ndarray:
    """Share of each object's intensity that each further opening removes, in percent: objects by steps."""
    low, high = float(np.min(image)), float(np.max(image))
    scaled = (np.asarray(image, float) - low) / ((high - low) or 1.0)
    mask = labels > 0
    if sample != 1:
        shape = tuple(max(1, int(round(sample * n))) for n in image.shape)
        scaled, mask = resize(scaled, shape), resize(mask, shape) > 0.5
        labels = label(mask)
    small, small_mask = scaled, mask
    if background_sample != 1:
        shape = tuple(max(1, int(round(background_sample * n))) for n in scaled.shape)
        small, small_mask = resize(scaled, shape), resize(mask, shape) > 0.5
    ground = masked_opening(to_uint8(small), disk(element), small_mask)
    if ground.shape != scaled.shape:
        ground = np.clip(np.round(resize(ground, scaled.shape)), 0, 255).astype(np.uint8)
    now = to_uint8(scaled)
    now = np.where(now > ground, now - ground, 0).astype(np.uint8)
    n = int(labels.max(initial=0))
    at = np.flatnonzero(labels)
    owner = labels.ravel()[at]
    total = lambda x: np.bincount(owner, x.ravel()[at], n + 1)[1:]
    first = before = total(now)
    eroded, out = now, np.zeros((n, spectrum))
    for k in range(spectrum):
        eroded = masked(erode, eroded, CROSS, mask, 255)
        after = total(reconstruct(eroded, now, 4))
        out[:, k] = before - after
        before = after
    with np.errstate(all="ignore"):
        return 100 * out / first[:, None]


def sharpness(image: np.ndarray) -> float:
    """Number of strong spatial frequencies by the root of the number of pixels."""
    power = np.abs(np.fft.fft2(image))
    return float((power > power.max() / 1000).sum() / np.sqrt(image.size))


def highpass(x: np.ndarray, longest: float, step: float) -> np.ndarray:
    """Without the periods beyond ``longest``, for samples ``step`` apart."""
    z = np.fft.fft(x)
    low = int(np.floor(step * len(x) / longest + 0.5))
    z[: low + 1] = 0
    if low:
        z[-low:] = 0
    return np.fft.ifft(z).real


def boxes(labels: np.ndarray) -> np.ndarray:
    """(top, left, bottom, right) of each label from 1, the last two exclusive, from one pass."""
    n = int(labels.max(initial=0))
    out = np.empty((n, 4), np.int64)
    out[:, :2], out[:, 2:] = np.iinfo(np.int64).max, 0
    y, x = np.nonzero(labels)
    own = labels[y, x] - 1
    for column, place, pick in ((0, y, np.minimum), (1, x, np.minimum), (2, y + 1, np.maximum), (3, x + 1, np.maximum)):
        pick.at(out[:, column], own, place)
    return out


def crops(labels: np.ndarray) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """Each label from 1, the smallest mask that holds it, and its origin (row, column)."""
    for k, (y0, x0, y1, x1) in enumerate(boxes(labels).tolist()):
        if y0 < y1:
            yield k + 1, labels[y0:y1, x0:x1] == k + 1, y0, x0


#: Grey levels, and steps (down, right) of the four directions of co-occurrence.
GREY_LEVELS = 8
DIRECTIONS = ((0, 1), (-1, 1), (-1, 0), (-1, -1))


def cooccurrences(image: np.ndarray, labels: np.ndarray, distance: int = 1) -> np.ndarray:
    """Shares of pairs of grey levels within each object: objects by directions by levels by levels, symmetric.

    Levels divide each object's own range of values. An object without a pair in a direction has zeros there.
    """
    a = np.asarray(image, float)
    labels = np.where(np.isnan(a), 0, labels)
    n = int(labels.max(initial=0))
    at = np.flatnonzero(labels)
    own, v = labels.ravel()[at], a.ravel()[at]
    low, high = np.full(n + 1, np.inf), np.full(n + 1, -np.inf)
    np.minimum.at(low, own, v)
    np.maximum.at(high, own, v)
    level = np.zeros(labels.shape, np.int64)
    level.ravel()[at] = np.minimum(np.floor(GREY_LEVELS * (v - low[own]) / (high[own] + 1e-6 - low[own])), GREY_LEVELS - 1)
    out = np.zeros((n, len(DIRECTIONS), GREY_LEVELS, GREY_LEVELS))
    h, w = labels.shape
    for k, (dy, dx) in enumerate(DIRECTIONS):
        dy, dx = dy * distance, dx * distance
        ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
        if ys.start >= ys.stop or xs.start >= xs.stop:
            continue
        there = slice(ys.start + dy, ys.stop + dy), slice(xs.start + dx, xs.stop + dx)
        both = (labels[ys, xs] == labels[there]) & (labels[ys, xs] > 0)
        cell = ((labels[ys, xs][both] - 1) * GREY_LEVELS + level[ys, xs][both]) * GREY_LEVELS + level[there][both]
        counts = np.bincount(cell, minlength=n * GREY_LEVELS**2).reshape(n, GREY_LEVELS, GREY_LEVELS)
        out[:, k] = counts + counts.transpose(0, 2, 1)
    total = out.sum((2, 3), keepdims=True)
    return np.divide(out, total, out=np.zeros_like(out), where=total > 0)


def texture(p: np.ndarray) -> dict[str, np.ndarray]:
    """The thirteen texture features of symmetric matrices (the last two axes); what is undefined is 0.

    With the marginal m, and the distributions s of i + j and d of |i - j|, all are moments and entropies of p, m, s and d.
    """
    i, j = np.mgrid[1 : GREY_LEVELS + 1, 1 : GREY_LEVELS + 1]
    over = lambda weight: (p * weight).sum((-2, -1))
    spread = lambda k: np.stack([(p * (k == v)).sum((-2, -1)) for v in range(2 * GREY_LEVELS + 1)], -1)

    def entropy(q: np.ndarray, axes=(-1,)) -> np.ndarray:
        return -(q * np.log(np.where(q > 0, q, 1))).sum(axes)

    def moments(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.arange(q.shape[-1])
        mean = q @ k
        return mean, q @ (k * k) - mean * mean

    margin, sums, apart = p.sum(-1), spread(i + j), spread(np.abs(i - j))
    mean = margin @ np.arange(1, GREY_LEVELS + 1)
    variance = margin @ np.arange(1, GREY_LEVELS + 1) ** 2 - mean * mean
    hx, hxy = entropy(margin), entropy(p, (-2, -1))
    ratio = lambda x, y: np.divide(x, y, out=np.zeros_like(x), where=np.abs(y) > 1e-12)
    return {
        "Contrast": over((i - j) ** 2), "Correlation": ratio(over(i * j) - mean * mean, variance), "DifferenceEntropy": entropy(apart),
        "DifferenceVariance": moments(apart)[1], "Energy": (p * p).sum((-2, -1)), "Entropy": hxy, "InformationCorrelation1": ratio(hxy - 2 * hx, hx),
        "InformationCorrelation2": np.sqrt(np.maximum(1 - np.exp(-2 * (2 * hx - hxy)), 0)), "InverseDifferenceMoment": over(1 / (1 + (i - j) ** 2)),
        "SumAverage": moments(sums)[0], "SumEntropy": entropy(sums), "SumOfSquaresVariance": variance, "SumVariance": moments(sums)[1],
    }


def tight_crop(labels: np.ndarray, number: int, values: np.ndarray | None = None) -> tuple[np.ndarray, int, int]:
    """The smallest image that holds an object (its mask, or values with 0 elsewhere) and its origin (row, column)."""
    at = np.argwhere(labels == number)
    (y0, x0), (y1, x1) = at.min(0), at.max(0) + 1
    own = labels[y0:y1, x0:x1] == number
    return (own if values is None else np.where(own, values[y0:y1, x0:x1], 0)), int(y0), int(x0)


def bilinear(z: np.ndarray, x: np.ndarray, y: np.ndarray, xi: np.ndarray, yi: np.ndarray) -> np.ndarray:
    """Values of a grid (rows y, columns x) at points; outside it the nearest node along an edge."""
    fx, fy = (np.interp(i, n, np.arange(len(n))) for i, n in ((xi, x), (yi, y)))
    cx, cy = np.minimum(fx.astype(int), max(0, len(x) - 2)), np.minimum(fy.astype(int), max(0, len(y) - 2))
    ux, uy = fx - cx, fy - cy
    rx, ry = np.minimum(cx + 1, len(x) - 1), np.minimum(cy + 1, len(y) - 1)
    top = z[cy, cx] + ux * (z[cy, rx] - z[cy, cx])
    return top + uy * (z[ry, cx] + ux * (z[ry, rx] - z[ry, cx]) - top)


def linear_beyond(x: np.ndarray, y: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Linear interpolation that goes on in a line beyond both ends."""
    k = np.clip(np.searchsorted(x, xi, side="right") - 1, 0, len(x) - 2)
    return y[k] + (xi - x[k]) * (y[k + 1] - y[k]) / (x[k + 1] - x[k])
