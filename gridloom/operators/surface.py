"""Smooth surfaces from binned points, and stripes along x.

Binning and medians run in Spark. A surface has a bin for some hundred points of an image, so the fit is a
small array problem of the driver; what it gives is applied to the rows by vectorised functions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gridloom.functions import kernels, stats
from gridloom.operators import binning
from gridloom.sources.scratch import written

#: A surface with more bins than this is refused: its image should be cut.
MOST_BINS = 200_000
KINDS = ("lowess", "lar", "bisquare", "median")
#: Up to as many points, each place meets all of them; above, leaves of a k-d tree hold so many.
DENSE, LEAF = 512, 24
#: Places have lists of their own if no more points than this are as near as the last of the nearest; so many leaves are fitted at once.
TIES, TOGETHER = 16, 32


def _leaves(x: np.ndarray, y: np.ndarray, most: int) -> list[np.ndarray]:
    """Points by the leaves of a k-d tree, which hold at most so many each."""
    done, left = [], [np.arange(len(x))]
    while left:
        rows = left.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        v = max((x[rows], y[rows]), key=np.ptp)
        rows, half = rows[np.argpartition(v, len(rows) // 2)], len(rows) // 2
        left += [rows[half:], rows[:half]]
    return done


def _boxes(x: np.ndarray, y: np.ndarray, leaves: list[np.ndarray]) -> np.ndarray:
    """Left, right, top and bottom of each leaf."""
    return np.array([(x[r].min(), x[r].max(), y[r].min(), y[r].max()) for r in leaves]).T


def neighbourhoods(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places in groups, with points that hold the ``k`` nearest of each place and what is as near as these: one list for
    the group, or one for each of its places."""
    if len(px) == 0:
        return []
    if len(x) <= DENSE or k > len(x) // 8:
        return [(np.arange(a, min(a + 256, len(px))), np.arange(len(x))) for a in range(0, len(px), 256)]
    leaves, groups, few, out = _leaves(x, y, LEAF), _leaves(px, py, LEAF), [], []
    size, (left, right, top, bottom) = np.array([len(r) for r in leaves]), _boxes(x, y, leaves)
    for rows, (l, r, t, b) in zip(groups, _boxes(px, py, groups).T):
        # near leaves of k points bound every place's reach, and no leaf beyond it has a nearer point
        most = np.hypot(np.maximum(right - l, r - left), np.maximum(bottom - t, b - top))
        enough = np.argpartition(most, min(k, len(most) - 1))[: k + 1]
        enough = enough[np.argsort(most[enough])]
        some = np.concatenate([leaves[i] for i in enough[: np.searchsorted(np.cumsum(size[enough]), k) + 1]])
        apart = np.hypot(x[None, some] - px[rows, None], y[None, some] - py[rows, None])
        reach = np.partition(apart, k - 1, axis=1)[:, k - 1].max() * 1.000001
        least = np.hypot(np.maximum(0, np.maximum(left - r, l - right)), np.maximum(0, np.maximum(top - b, t - bottom)))
        near = np.concatenate([leaves[i] for i in np.flatnonzero(least <= reach)])
        apart = np.hypot(x[None, near] - px[rows, None], y[None, near] - py[rows, None])
        if len(near) > k + TIES:
            order = np.argpartition(apart, (k - 1, k + TIES), axis=1)[:, : k + TIES + 1]
            apart = np.take_along_axis(apart, order, axis=1)
            if (apart[:, -1] > apart[:, k - 1] * 1.000001).all():
                few.append((rows, near[order[:, :-1]].astype(np.int32)))
                continue
        out.append((rows, near))
    for a in range(0, len(few), TOGETHER):
        out.append(tuple(map(np.concatenate, zip(*few[a : a + TOGETHER]))))
    return out


def lowess(x: np.ndarray, y: np.ndarray, z: np.ndarray, span: float, at: tuple[np.ndarray, np.ndarray] | None = None, robust: str = "bisquare", rounds: int = 5) -> np.ndarray:
    """Local linear regression with tricube weights on the share ``span`` of nearest points, evaluated at
    ``at`` (by default the points), with weights against outliers in the robust kinds."""
    n = len(x)
    k = int(min(n, max(3, np.ceil(span * n))))
    trust = np.ones(n)

    def local(px: np.ndarray, py: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at places, and where no point that is near has any weight."""
        dx, dy = x[near] - px[:, None], y[near] - py[:, None]
        d = np.sqrt(dx * dx + dy * dy)
        reach = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        w = np.clip(1 - (d / np.maximum(reach * 1.0000001, 1e-12)) ** 3, 0, None) ** 3 * trust[near]
        bare = w.sum(1) <= 0
        if bare.any():
            w = np.where(bare[:, None], np.exp(-((d / np.maximum(reach, 1e-12)) ** 2)), w)
        wx, wy, wz = w * dx, w * dy, w * z[near]
        sums = [w.sum(1), wx.sum(1), wy.sum(1), (wx * dx).sum(1), (wx * dy).sum(1), (wy * dy).sum(1)]
        normal = np.stack([sums[i] for i in (0, 1, 2, 1, 3, 4, 2, 4, 5)], axis=-1).reshape(-1, 3, 3)
        scale = np.trace(normal, axis1=1, axis2=2)[:, None, None]
        normal = normal + 1e-10 * scale * np.eye(3)
        right = np.stack([wz.sum(1), (wz * dx).sum(1), (wz * dy).sum(1)], axis=-1)
        return np.linalg.solve(normal, right[..., None])[:, 0, 0], bare

    def fit(px: np.ndarray, py: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out, every = np.empty(len(px)), np.arange(n)
        for rows, near in groups:
            out[rows], bare = local(px[rows], py[rows], near)
            if bare.any() and near.shape[-1] < n:  # the weights of these reach all points
                for one in np.array_split(rows[bare], -(-int(bare.sum()) // 8)):
                    out[one] = local(px[one], py[one], every)[0]
        return out

    if robust in ("bisquare", "lar"):
        own = neighbourhoods(x, y, x, y, k)
        for _ in range(rounds):
            error = np.abs(z - fit(x, y, own))
            middle = np.median(error)
            if middle <= 1e-12:
                break
            trust = np.clip(1 - (error / (6 * middle)) ** 2, 0, None) ** 2 if robust == "bisquare" else 1 / np.maximum(error / middle, 1.0)
        if at is None:
            return fit(x, y, own)
    px, py = at or (x, y)
    return fit(px, py, neighbourhoods(x, y, px, py, k))


def smooth(x: np.ndarray, y: np.ndarray, z: np.ndarray, radius: float, kind: str = "bisquare") -> np.ndarray:
    """Smoothed values at the points (of a grid of unit steps, as far as the radius is concerned).

    Fewer than five points, or a radius that is not finite, leave the values as they are.
    """
    if kind not in KINDS:
        raise ValueError(f"no such kind of surface: {kind}")
    if not np.isfinite(radius) or len(z) < 5:
        return z
    if kind == "median":
        xs, ys = np.unique(x), np.unique(y)
        grid = np.full((len(ys), len(xs)), np.nan)
        at = np.searchsorted(ys, y), np.searchsorted(xs, x)
        grid[at] = z
        return kernels.median_filter(grid, kernels.disk(radius))[at]
    return lowess(x, y, z, float(np.clip(np.pi * radius * radius / len(z), 0, 1)), robust=kind)


@dataclass
class Surface:
    """Scattered nodes and values; evaluated on a regular grid, and between its nodes bilinearly."""

    x: np.ndarray
    y: np.ndarray
    z: np.ndarray

    def on_grid(self, xg: np.ndarray, yg: np.ndarray) -> np.ndarray:
        if len(self.z) == 0:
            return np.ones((len(yg), len(xg)))
        if len(self.z) < 4:
            return np.full((len(yg), len(xg)), float(np.mean(self.z)))
        px, py = np.meshgrid(xg, yg)
        span = min(1.0, 7 / len(self.z))
        return lowess(self.x, self.y, self.z, span, (px.ravel(), py.ravel()), robust="none").reshape(len(yg), len(xg))

    def evaluator(self, nodes: int = 64):
        """A function of two columns: the surface's value, clamped at the edges of its nodes."""
        xg, yg = (np.linspace(v.min(), v.max(), nodes) if len(v) else np.array([0.0, 1.0]) for v in (self.x, self.y))
        grid = self.on_grid(xg, yg)

        @pandas_udf("double")
        def value(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series(kernels.bilinear(grid, xg, yg, x.to_numpy(float), y.to_numpy(float)))

        return value


def decimate_and_smooth(points: DataFrame, x: str, y: str, z: str, width: float, radius: float, reducer="median", kind: str = "hexagonal", default: float | None = None, smoothing: str = "bisquare", **options) -> Surface:
    """Bins points (hexagonal ones with an origin moved by 0.9 of half a bin), cleans and smooths the bins.

    ``radius`` is that of the smoothing, in the units of x and y. The points are written, as reducers read them several
    times and repeat what computes a value in their expressions; the bins are, so that all tasks give theirs at once.
    """
    shift = 0.9 * width / 2 if kind == "hexagonal" else 0.0
    moved = points.select((F.col(x) - shift).alias("_x"), (F.col(y) - shift).alias("_y"), F.col(z).cast("double").alias("_z"))
    moved = written(moved, "points")
    bins = reducer(moved) if callable(reducer) and options.pop("of_table", False) else binning.decimate(moved, "_x", "_y", "_z", width, kind, reducer, **options)
    bins = written(binning.centres(binning.cleaned(bins, default), width, kind).select("x", "y", "z"), "bins")
    if bins.count() > MOST_BINS:
        raise ValueError(f"more than {MOST_BINS} bins; cut the image or widen the bins")
    bins = bins.toPandas().sort_values(["y", "x"])
    px, py, pz = (bins[c].to_numpy(float) for c in "xyz")
    return Surface(px + shift, py + shift, smooth(px / width, py / width, pz, radius / width, smoothing))


# ---- stripes


@dataclass
class Stripe:
    """Factors at places along x, and how densely they were sampled (None: no stripe was found)."""

    x: np.ndarray
    s: np.ndarray
    sampling: float | None

    def evaluator(self):
        x, s = self.x, self.s

        @pandas_udf("double")
        def value(at: pd.Series) -> pd.Series:
            return pd.Series(kernels.linear_beyond(x, s, at.to_numpy(float)))

        return value


def _divided(x: Column, z: Column, centres: np.ndarray, factors: list[np.ndarray]) -> Column:
    """z over the interpolated factors of all rounds; outside the centres and at zeros nothing changes."""
    if not factors:
        return z

    @pandas_udf("double")
    def value(xs: pd.Series, zs: pd.Series) -> pd.Series:
        out = zs.to_numpy(float)
        for f in factors:
            c = np.interp(xs.to_numpy(float), centres, f, left=np.nan, right=np.nan)
            out = out / np.where(np.isfinite(c) & (c != 0), c, 1.0)
        return pd.Series(out)

    return value(x, z)


def _profile(points: DataFrame, low: float, high: float, step: float, bounds: tuple[float, float], threshold: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.arange(low - step, high + step * 1.000001, step)
    if len(edges) % 2 == 0:
        edges = np.append(edges, edges[-1] + step)
    centres, total, factors = (edges[:-1] + edges[1:]) / 2, np.ones(len(edges) - 1), []
    for _ in range(most):
        z = _divided(F.col("x"), F.col("z"), centres, factors)
        rows = points.select("x", z.alias("z")).filter((F.col("z") > bounds[0]) & (F.col("z") < bounds[1]))
        rows = rows.withColumn("k", F.floor((F.col("x") - F.lit(float(edges[0]))) / F.lit(float(step))).cast("int"))
        bins = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("q")).join(stats.hazen(rows, ["k"], "z", {"m": 0.5}), "k")
        found = bins.filter(F.col("k").between(0, len(total) - 1)).toPandas()
        one = np.ones(len(total))
        one[found.k.to_numpy(int)] = found.m.to_numpy(float)
        total, factors = total * one, [*factors, one]
        # how much this round changes, by the bins' own factors
        change = ((1 - 1 / one[found.k.to_numpy(int)]) ** 2 * found.q.to_numpy(float)).sum()
        if np.sqrt(change) / max(1, found.n.sum()) <= threshold:
            break
    total[~np.isfinite(total) | (total == 0)] = 1
    return centres, total


def stripe_frequency(profile: np.ndarray, step: float) -> float | None:
    """Sampling that a periodic stripe needs, from peaks of the autocorrelation of its power spectrum."""
    n = len(profile)
    power = np.abs(np.fft.fft(profile) / n)[: n // 2 + 1]
    power[1:-1] *= 2
    m = len(power)
    full = np.fft.irfft(np.abs(np.fft.rfft(power, 2 * m)) ** 2, 2 * m)[:m]
    c = (full / (m - np.arange(m)))[1:]
    c = c[: len(c) // 2]
    if len(c) < 6:
        return None
    smooth_c = np.array([np.median(c[max(0, k - 15) : k + 16]) for k in range(len(c))])
    signal = c - smooth_c
    spread = np.median(np.abs(signal - np.median(signal)))
    if not spread > 0:
        return None
    signal = signal / spread
    signal[:5] = 0
    highest = np.array([signal[max(0, k - 15) : k + 16].max() for k in range(len(signal))])
    peaks = np.flatnonzero((signal > 10) & (signal == highest))
    return float(4 * (peaks[-1] + 1) / (n * step)) if len(peaks) else None


def fit_stripe(points: DataFrame, x: str, z: str, step: float = 0.005, bounds: tuple[float, float] = (0.65, 1.5), threshold: float = 1e-4, most: int = 10) -> Stripe:
    """A periodic factor along x: medians in fine bins show its period, and bins of a quarter of it give the factor."""
    rows = written(points.select(F.col(x).cast("double").alias("x"), F.col(z).cast("double").alias("z")), "rows")
    span = rows.agg(F.min("x"), F.max("x")).first()
    if span[0] is None or span[0] == span[1]:
        return Stripe(np.array([0.0, 1.0]), np.ones(2), None)
    centres, profile = _profile(rows, span[0], span[1], step, bounds, threshold, most)
    sampling = stripe_frequency(profile, step)
    if sampling is None:
        return Stripe(centres, np.ones(len(centres)), None)
    return Stripe(*_profile(rows, span[0], span[1], 1 / sampling, bounds, threshold, most), sampling)
