"""Exact all-pairs work on two blocks of vectors inside one task, in bounded memory.

A matrix product gives every pair's value to within a bound on its rounding error; pairs that this
bound can't rule out are computed again, sum by sum in the order of the components as SQL does, and
only that value decides. Rows with components that are not finite are always computed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Elements of a matrix, and pairs to compute again, that are held at a time.
CELLS, PAIRS = 1 << 21, 1 << 16


def classes(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of the vectors of each length; null ones and those with null components
    are in none, as they have no distance."""
    n = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).copy()
    whole = col.filter(pc.is_valid(col))
    values = whole.flatten()
    start = np.concatenate([[0], np.cumsum(n[n >= 0])])
    if values.null_count:
        holes = np.concatenate([[0], np.cumsum(pc.is_null(values).to_numpy(zero_copy_only=False))])
        bad = holes[start[1:]] > holes[start[:-1]]
        n[np.flatnonzero(n >= 0)[bad]] = -2
    flat, at = values.to_numpy(zero_copy_only=False).astype(float), np.full(len(n), -1)
    at[col.is_valid().to_numpy(zero_copy_only=False)] = start[:-1]
    for size in np.unique(n[n >= 0]):
        rows = np.flatnonzero(n == size)
        yield rows, flat[at[rows][:, None] + np.arange(size)]


def _sums(x: np.ndarray, y: np.ndarray, of) -> np.ndarray:
    s = np.zeros(len(x))
    for j in range(x.shape[1]):
        s += of(x[:, j], y[:, j])
    return s


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _sums(x, y, lambda a, b: a * b)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows in pairs, 0 if a norm is 0; one root of both norms' product, as SQL has it."""
    n = _dot(x, x) * _dot(y, y)
    return np.where(n == 0, 0.0, _dot(x, y) / np.sqrt(np.where(n == 0, 1.0, n)))


def distance(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Of rows in pairs, as ``functions.vectors.distance``."""
    if metric == "euclidean":
        return np.sqrt(_sums(x, y, lambda a, b: (a - b) * (a - b)))
    if metric == "manhattan":
        return _sums(x, y, lambda a, b: np.abs(a - b))
    if metric == "dot":
        return -_dot(x, y)
    n = np.sqrt(_dot(x, x)) * np.sqrt(_dot(y, y))
    return 1 - np.where(n == 0, 0.0, _dot(x, y) / np.where(n == 0, 1.0, n))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1))
    return x / np.where(n > 0, n, 1.0)[:, None]


def _again(f, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    parts = [f(x[i[a:a + PAIRS]], y[j[a:a + PAIRS]]) for a in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _odd(x: np.ndarray) -> np.ndarray:
    """Rows of which the product says nothing."""
    n = (x * x).sum(axis=1)
    return ~np.isfinite(n) | ((n < 1e-200) & (n > 0)) | (n > 1e200) | ((n == 0) & (x != 0).any(axis=1))


class _Near:
    """Values that rank as a metric's distances, each with a bound on its error."""

    def __init__(self, y: np.ndarray, metric: str):
        self.metric, self.y, self.odd = metric, y, _odd(y)
        clean = np.where(self.odd[:, None], 0.0, y)
        self.clean = _unit(clean) if metric == "cosine" else clean
        self.norms = (self.clean * self.clean).sum(axis=1)
        self.eps = 16 * (y.shape[1] + 4) * np.finfo(float).eps

    def values(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, error of each row)"""
        if self.metric == "manhattan":
            v = np.zeros((len(x), len(self.clean)))
            for j in range(x.shape[1]):
                v += np.abs(x[:, j, None] - self.clean[None, :, j])
            return v, self.eps * (np.abs(x).sum(axis=1) + np.abs(self.clean).sum(axis=1).max(initial=0))
        x = _unit(x) if self.metric == "cosine" else x
        n, most = (x * x).sum(axis=1), self.norms.max(initial=0)
        v = x @ self.clean.T
        if self.metric == "euclidean":
            v *= -2
            v += self.norms
            v += n[:, None]
        else:
            np.negative(v, out=v)
        return v, self.eps * (n + most + (self.metric == "cosine"))


def nearest(x: np.ndarray, x_ids: np.ndarray, y: np.ndarray, y_ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in x, position in y, distance) of the k rows of y next to each row of x, ties to
    the smaller id; rows of the same id are no pair."""
    with np.errstate(all="ignore"):
        # Of equal vectors only those of the k + 1 smallest ids can be among k, one being the row's own.
        _, same = np.unique(np.ascontiguousarray(y).view(np.dtype((np.void, max(1, y.itemsize * y.shape[1])))).ravel() if y.shape[1] else np.zeros(len(y)), return_inverse=True)
        order = np.lexsort((y_ids, same))
        a, b = same[order], y_ids[order]
        first = np.concatenate([[True], a[1:] != a[:-1]])
        step = np.cumsum(first | np.concatenate([[True], b[1:] != b[:-1]]))
        place = step - step[np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))]
        keep = order[place <= k]
        keep = keep[np.argsort(y_ids[keep], kind="stable")]
        y, ids, near = y[keep], y_ids[keep], _Near(y[keep], metric)
        x_odd, lo, hi = _odd(x), np.searchsorted(ids, x_ids), np.searchsorted(ids, x_ids, "right")
        group = max(1, len(y) // (32 * k))
        starts = np.arange(0, len(y), group)
        rows, out = max(1, CELLS // len(y)), []
        for at in range(0, len(x), rows):
            part = x[at:at + rows]
            v, error = near.values(np.where(x_odd[at:at + rows, None], 0.0, part))
            own = [(i, lo[at + i], hi[at + i]) for i in np.flatnonzero(lo[at:at + rows] < hi[at:at + rows])]
            v[:, near.odd] = np.inf
            for i, p, q in own:
                v[i, p:q] = np.inf
            least = np.minimum.reduceat(v, starts, axis=1)
            bound = np.partition(least, k - 1, axis=1)[:, k - 1] if least.shape[1] >= k else np.full(len(v), np.inf)
            bound[x_odd[at:at + rows]] = np.inf
            mask = v <= (bound + 2 * error)[:, None]
            mask[:, near.odd] = True
            for i, p, q in own:
                mask[i, p:q] = False
            i, j = np.nonzero(mask)
            d = _again(lambda s, t: distance(s, t, metric), part, y, i, j)
            o = np.lexsort((ids[j], d, i))
            i, j, d = i[o], j[o], d[o]
            top = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((i[top] + at, keep[j[top]], d[top]))
        return tuple(np.concatenate(c) for c in zip(*out))


def similar(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(position in x, position in y, cosine) of pairs of at least ``threshold`` (NaN is above all
    numbers), a part at a time; without y each pair of rows of x once."""
    with np.errstate(all="ignore"):
        near, x_odd = _Near(x if y is None else y, "cosine"), _odd(x)
        rows = max(1, CELLS // max(1, len(near.y)))
        for at in range(0, len(x), rows):
            odd = x_odd[at:at + rows]
            v, error = near.values(np.where(odd[:, None], 0.0, x[at:at + rows]))
            mask = -v >= (threshold - error)[:, None]
            mask[:, near.odd] = True
            mask[odd] = True
            if y is None:
                mask &= np.arange(len(x))[None, :] > np.arange(at, at + len(v))[:, None]
            i, j = np.nonzero(mask)
            for p in range(0, len(i), PAIRS):
                s, t = i[p:p + PAIRS] + at, j[p:p + PAIRS]
                c = cosine(x[s], near.y[t])
                ok = ~(c < threshold)
                yield s[ok], t[ok], c[ok]
