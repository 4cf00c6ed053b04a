"""Over-segmentation of images and volumes into compact regions by local k-means (2D and 3D), one image at a time.

Seeds stand on a regular grid and move to the lowest gradient around them; every pixel goes to the nearest seed within
one step, by squared color distance plus squared distance in space times (compactness / step)^2; the lowest seed wins
ties. Then components of a region that are too small take the label of a neighbor and regions are numbered in raster
order. Images are independent and grouped by image; one task holds one image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def lab(rgb: np.ndarray) -> np.ndarray:
    """Lab of RGB in 0..255 without gamma, a and b shifted by 128."""
    x = rgb.astype(float) / 255
    xyz = x @ np.array([[0.412453, 0.212671, 0.019334], [0.357580, 0.715160, 0.119193], [0.180423, 0.072169, 0.950227]]) / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * np.cbrt(xyz[..., 1]) - 16, 903.3 * xyz[..., 1])
    return np.stack([light, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], -1)


def edge_strength(v: np.ndarray) -> np.ndarray:
    """Sum over axes and channels of squared central differences; 0 on the border. v: axes, then channels."""
    out = np.zeros(v.shape[:-1])
    inner = tuple(slice(1, -1) for _ in range(v.ndim - 1))
    for axis in range(v.ndim - 1):
        a, b = list(inner), list(inner)
        a[axis], b[axis] = slice(2, None), slice(None, -2)
        out[inner] += ((v[tuple(a)] - v[tuple(b)]) ** 2).sum(-1)
    return out


def seeds(shape: tuple[int, ...], step: int) -> np.ndarray:
    """Grid of seeds, the remainder of each axis spread over its strips, first axis outermost."""
    axes = []
    for n in shape:
        strips = max(int(0.5 + n / step), 1)
        spare = (n - step * strips) / strips
        if n - step * strips < 0 and strips > 1:
            strips -= 1
            spare = (n - step * strips) / strips
        axes.append([min(int(k * step + step // 2 + k * spare), n - 1) for k in range(strips)])
    return np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, len(shape))


def perturbed(at: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Each seed moved to the weakest edge among itself and its neighbors; it stays unless one is strictly weaker."""
    offsets = np.stack(np.meshgrid(*[[-1, 0, 1]] * at.shape[1], indexing="ij"), -1).reshape(-1, at.shape[1])
    best, least = at.copy(), strength[tuple(at.T)].copy()
    for o in offsets:
        to = at + o
        ok = ((to >= 0) & (to < strength.shape)).all(1)
        s = np.where(ok, strength[tuple(np.where(ok[:, None], to, at).T)], np.inf)
        better = s < least
        best[better], least[better] = to[better], s[better]
    return best


def clustered(v: np.ndarray, step: int, compact: float, rounds: int) -> np.ndarray:
    """Seed number of every pixel."""
    shape, dims = v.shape[:-1], v.ndim - 1
    at = perturbed(seeds(shape, step), edge_strength(v)).astype(float)
    color = v[tuple(at.astype(int).T)].astype(float)
    grid = np.stack(np.meshgrid(*[np.arange(n) for n in shape], indexing="ij"), -1).astype(float)
    weight = (compact / step) ** 2
    label = np.zeros(shape, np.int64)
    for _ in range(rounds):
        least = np.full(shape, np.inf)
        for k in range(len(at)):
            box = tuple(slice(max(0, int(at[k, d] - step)), min(shape[d], int(at[k, d] + step) + 1)) for d in range(dims))
            dist = ((v[box] - color[k]) ** 2).sum(-1) + ((grid[box] - at[k]) ** 2).sum(-1) * weight
            better = dist < least[box]
            least[box][better] = dist[better]
            label[box][better] = k
        flat = label.ravel()
        n = np.bincount(flat, minlength=len(at))
        some = n > 0
        for target, source in ((at, grid.reshape(-1, dims)), (color, v.reshape(-1, v.shape[-1]))):
            for c in range(target.shape[1]):
                target[some, c] = np.bincount(flat, source[:, c], len(at))[some] / n[some]
    return label


def connected(label: np.ndarray, least: int) -> np.ndarray:
    """Regions numbered in raster order, one a component (neighbors along an axis); a component of at most least pixels takes
    the label of the numbered neighbor that its first pixel has, the last axis looked at first."""
    out, number = np.full(label.shape, -1, np.int64), 0
    steps = [s * np.eye(label.ndim, dtype=int)[d] for d in range(label.ndim - 1, -1, -1) for s in (-1, 1)]
    for start in np.ndindex(*label.shape):
        if out[start] >= 0:
            continue
        near = -1
        stack, found = [start], [start]
        out[start] = number
        for o in steps:
            p = tuple(np.add(start, o).tolist())
            if all(0 <= x < n for x, n in zip(p, label.shape, strict=True)) and 0 <= out[p] < number:
                near = int(out[p])
        while stack:
            q = stack.pop()
            for o in steps:
                p = tuple(np.add(q, o).tolist())
                if all(0 <= x < n for x, n in zip(p, label.shape, strict=True)) and out[p] < 0 and label[p] == label[start]:
                    out[p] = number
                    stack.append(p), found.append(p)
        if len(found) <= least and near >= 0:
            for p in found:
                out[p] = near
        else:
            number += 1
    return out


def segmented(px: DataFrame, step: int = 5, compact: float = 10.0, rounds: int = 10, axes: tuple[str, ...] = ("x", "y"), values: tuple[str, ...] = ("v",)) -> DataFrame:
    """px (image, axes, values) with sid, the region of every pixel. Every image must be a full grid from 0 on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = tuple(pdf[a].to_numpy(np.int64) for a in reversed(axes))
        shape = tuple(int(a.max()) + 1 for a in at)
        v = np.zeros((*shape, len(values)))
        for c, name in enumerate(values):
            v[(*at, c)] = pdf[name]
        found = connected(clustered(v, step, compact, rounds), step ** len(axes) // 4)
        return pdf.assign(sid=found[at])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in px.drop("sid").schema) + ", sid long"
    return px.drop("sid").groupBy("image").applyInPandas(lambda pdf: run(pdf), schema)
