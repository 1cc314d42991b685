"""All pairs of two lists of windows, tile by tile: nearest others, best pairs, sums.

A tile's distances are one matrix product a dimension, exact to a known error, and its best dimensions come from a network of minima and maxima over whole
tiles. Only pairs that this error leaves open are measured again in double precision and in the order of the offsets, so results are those of
comparing every pair in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: A tile's rows and columns; pairs that are measured again at once.
ROWS, COLUMNS, AGAIN = 128, 512, 200_000
#: So many pairs of a tile with a close dimension are measured without ranking the tile; with more, that many tiles are ranked before it is tried again.
FEW, REST = 256, 4
#: Longer windows are compared in double precision, as the error of single precision grows with the square of their length.
SINGLE = 32


class Cell:
    """Windows a (starts, z: dimension, window, offset) against windows b; a pair counts if b - a > least."""

    def __init__(self, a: np.ndarray, za: np.ndarray, b: np.ndarray, zb: np.ndarray, least: int, double: bool = False) -> None:
        self.a, self.b, self.za, self.zb, self.least = a, b, za, zb, least
        w = za.shape[2]
        self.kind = np.float64 if double or w > SINGLE else np.float32
        na, nb = (np.einsum("mno,mno->mn", z, z)[..., None] for z in (za, zb))
        one = np.ones_like
        self.left = np.concatenate([-2 * za, na, one(na)], 2).astype(self.kind)
        self.right = np.ascontiguousarray(np.concatenate([zb, one(nb), nb], 2).transpose(0, 2, 1).astype(self.kind))
        largest = max(float(np.nanmax(n, initial=0)) for n in (na, nb))
        self.unknown = not double and bool(np.isnan(na).any() or np.isnan(nb).any())  # sums keep what is not a number
        #: Most that a distance on one dimension may be off: the square's error, near 0.
        self.error = float(np.sqrt(4 * largest * (w + 4) * np.finfo(self.kind).eps))
        #: Which pairs of a tile count, beside the zone; None: all. one: the same of single pairs, given their rows on both sides.
        self.only: Callable[[slice, slice], np.ndarray] | None = None
        self.one: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
        self.space = np.empty((len(za) + 1, ROWS * COLUMNS), self.kind)

    def tiles(self) -> Iterator[tuple[slice, slice]]:
        for m in range(0, len(self.a), ROWS):
            for n in range(0, len(self.b), COLUMNS):
                x, y = slice(m, min(m + ROWS, len(self.a))), slice(n, min(n + COLUMNS, len(self.b)))
                if self.b[y.stop - 1] - self.a[x.start] > self.least:
                    yield x, y

    def distances(self, x: slice | np.ndarray, y: slice | np.ndarray, limited: bool = True) -> list[np.ndarray]:
        """Of each dimension: rows x times columns y, inf where a pair does not count; at most a tile of them. Not limited: `only` is left to the caller."""
        a, b = self.a[x], self.b[y]
        out = [self.space[m, : len(a) * len(b)].reshape(len(a), len(b)) for m in range(len(self.left))]
        only = self.only(x, y) if self.only and limited else None
        if only is not None and not only.any():
            for d in out:
                d.fill(np.inf)
            return out
        for m, d in enumerate(out):
            np.matmul(self.left[m, x], self.right[m, :, y] if isinstance(y, slice) else self.right[m][:, y], out=d)
            np.abs(d, out=d)  # below 0 by the square's error at most
            np.sqrt(d, out=d)
            if self.unknown:
                d[np.isnan(d)] = np.inf
        if b[0] - a[-1] <= self.least:
            near = b[None, :] - a[:, None] <= self.least
            for d in out:
                d[near] = np.inf
        if only is not None:
            for d in out:
                d[~only] = np.inf
        return out

    def distance(self, m: int, x: slice, y: slice) -> np.ndarray:
        """Of one dimension, zone and all; the next call overwrites it."""
        d = self.space[0, : (x.stop - x.start) * (y.stop - y.start)].reshape(x.stop - x.start, -1)
        np.matmul(self.left[m, x], self.right[m, :, y], out=d)
        np.abs(d, out=d)
        return np.sqrt(d, out=d)

    def close(self, x: slice, y: slice, most: float) -> tuple[np.ndarray, np.ndarray] | None:
        """The pairs of a tile that have a dimension within most, as rows of both sides; None if they are more than FEW. No distance is taken for that."""
        n = x.stop - x.start, y.stop - y.start
        least, other = (s[: n[0] * n[1]].reshape(n) for s in self.space[:2])
        for m in range(len(self.left)):
            np.matmul(self.left[m, x], self.right[m, :, y], out=other if m else least)
            if m:
                (np.fmin if self.unknown else np.minimum)(least, other, out=least)
        at = np.flatnonzero(least <= most * most)
        if len(at) > FEW:
            return None
        i, j = at // n[1] + x.start, at % n[1] + y.start
        ok = self.b[j] - self.a[i] > self.least
        if self.one and len(at):
            ok &= self.one(i, j)
        return i[ok], j[ok]

    def counted(self, x: slice, y: slice) -> np.ndarray | bool:
        """Which pairs of a tile are outside the zone; True: all."""
        a, b = self.a[x], self.b[y]
        return True if b[0] - a[-1] > self.least else b[None, :] - a[:, None] > self.least

    def running(self, found: list[np.ndarray], high: int) -> list[np.ndarray]:
        """The sums of the 1, 2, ... high smallest of the dimensions; found is overwritten."""
        s, spare = list(found), self.space[-1, : found[0].size].reshape(found[0].shape)
        for k in range(min(high, len(s) - 1)):
            for j in range(len(s) - 1, k, -1):
                np.minimum(s[j - 1], s[j], out=spare)
                if k + 1 < high:  # what is larger is looked at again
                    np.maximum(s[j - 1], s[j], out=s[j])
                s[j - 1], spare = spare, s[j - 1]
        for k in range(1, high):
            s[k] += s[k - 1]
        return s[:high]

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """pairs x dimensions."""
        out = np.empty((len(i), len(self.za)))
        for m, (p, q) in enumerate(zip(self.za, self.zb)):
            diff = p[i] - q[j]
            diff *= diff
            if diff.shape[1] <= 16:
                total = np.zeros(len(i))
                for o in range(diff.shape[1]):
                    total += diff[:, o]
            else:
                total = diff.sum(1)
            out[:, m] = np.sqrt(total)
        return out


def ranked(dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs x dimensions: the dimensions by (distance, dimension), their distances, and these' running sums."""
    order = np.argsort(dist, axis=1, kind="stable")
    part = np.take_along_axis(dist, order, 1)
    return order, part, np.cumsum(part, axis=1)


class Nearest:
    """Of each window and d the least (distance, other)."""

    def __init__(self, n: int, ds: range) -> None:
        self.ds, self.distance, self.other = ds, np.full((len(ds), n), np.inf), np.full((len(ds), n), -1, np.int64)

    def add(self, at: np.ndarray, other: np.ndarray, running: np.ndarray) -> None:
        for k, d in enumerate(self.ds):
            far = running[:, d - 1]
            order = np.lexsort((other, far, at))
            first = order[np.unique(at[order], return_index=True)[1]]
            w, f, o = at[first], far[first], other[first]
            better = (f < self.distance[k, w]) | ((f == self.distance[k, w]) & (o < self.other[k, w]))
            self.distance[k, w[better]], self.other[k, w[better]] = f[better], o[better]


def nearest(cell: Cell, ds: range, sides: str = "ab") -> dict[str, Nearest]:
    """By side (a, b): each window's nearest on the other side, for every d of ds."""
    n_a, n_b, high = len(cell.a), len(cell.b), ds[-1]
    rows, columns = -(-n_a // ROWS), -(-n_b // COLUMNS)
    least = {"a": np.full((len(ds), columns, n_a), np.inf, cell.kind), "b": np.full((len(ds), rows, n_b), np.inf, cell.kind)}
    for x, y in cell.tiles():
        for k, far in enumerate(cell.running(cell.distances(x, y), high)[ds[0] - 1 :]):
            if "a" in sides:
                least["a"][k, y.start // COLUMNS, x] = far.min(1)
            if "b" in sides:
                least["b"][k, x.start // ROWS, y] = far.min(0)
    # A sum of d distances is off by d errors at most, both that of the least and that of the one looked at.
    slack = np.array([2 * d * cell.error for d in ds])[:, None]
    out = {}
    for side in sides:
        own = Nearest(n_a if side == "a" else n_b, ds)
        most = least[side].min(1) + slack
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def measure() -> None:
            nonlocal held, size
            if held:
                i, j = (np.concatenate(v) for v in zip(*held))
                for k in range(0, len(i), AGAIN):
                    p, q = i[k : k + AGAIN], j[k : k + AGAIN]
                    running = ranked(cell.exact(p, q))[2]
                    own.add(*((p, cell.b[q]) if side == "a" else (q, cell.a[p])), running)
            held, size = [], 0

        wide, step = (COLUMNS, ROWS) if side == "a" else (ROWS, COLUMNS)
        for tile in range(least[side].shape[1]):
            line = least[side][:, tile]
            wanted = np.flatnonzero(((line <= most) & np.isfinite(line)).any(0))
            across = slice(tile * wide, min(tile * wide + wide, n_b if side == "a" else n_a))
            for k in range(0, len(wanted), step):
                at = wanted[k : k + step]
                found = cell.distances(*((at, across) if side == "a" else (across, at)))
                limit = most[:, at, None] if side == "a" else most[:, None, at]
                hit = np.zeros(found[0].shape, bool)
                for n, far in enumerate(cell.running(found, high)[ds[0] - 1 :]):
                    hit |= (far <= limit[n]) & np.isfinite(far)
                i, j = np.nonzero(hit)
                held.append((at[i], j + across.start) if side == "a" else (i + across.start, at[j]))
                size += len(i)
                if size > AGAIN:
                    measure()
        measure()
        out[side] = own
    return out


def best(cell: Cell, ds: range, keep: int, so_far: dict[int, dict[str, np.ndarray]] | None = None) -> dict[int, dict[str, np.ndarray]]:
    """For each d the keep best pairs by (distance, a, b): a, b, distance, dims, dim_dists. so_far: those of other cells, which this one's are added to.

    Once there are keep pairs, a tile counts only if one of its pairs has a dimension within the last one's distance over d, as the smallest of d distances has
    to be; and after keep pairs of distance 0, only rows up to the last one's, as tiles go by rows.
    """
    kinds = {"a": np.int64, "b": np.int64, "distance": float}
    out = so_far or {d: {c: np.zeros(0, t) for c, t in kinds.items()} | {"dims": np.zeros((0, d), np.int64), "dim_dists": np.zeros((0, d))} for d in ds}
    out = dict(out)
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {d: [] for d in ds}
    last = lambda d: out[d]["distance"][-1] if len(out[d]["a"]) == keep else np.inf
    rest = 0

    def settle(d: int) -> None:
        i, j = (np.concatenate(v) for v in zip(*held[d])) if held[d] else (np.zeros(0, np.int64),) * 2
        held[d] = []
        for k in range(0, len(i), AGAIN):
            p, q = i[k : k + AGAIN], j[k : k + AGAIN]
            order, part, running = ranked(cell.exact(p, q))
            new = {"a": cell.a[p], "b": cell.b[q], "distance": running[:, d - 1], "dims": order[:, :d], "dim_dists": part[:, :d]}
            both = {c: np.concatenate([out[d][c], v]) for c, v in new.items()}
            at = np.lexsort((both["b"], both["a"], both["distance"]))[:keep]
            out[d] = {c: v[at] for c, v in both.items()}

    def hold(d: int, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            held[d].append((i, j))
            if last(d) == np.inf or sum(len(x) for x, _ in held[d]) >= max(keep, 64):
                settle(d)

    for x, y in cell.tiles():
        wanted = [d for d in ds if last(d) > 0 or cell.a[x.start] <= out[d]["a"][-1]]
        if not wanted:
            break
        full = all(last(d) < np.inf for d in wanted) and not (cell.only and not cell.one)
        if full and not rest:
            if (pairs := cell.close(x, y, max(last(d) / d for d in wanted) + cell.error)) is not None:
                for d in wanted:
                    hold(d, *pairs)
                continue
            rest = REST
        rest = max(0, rest - 1)
        running = cell.running(cell.distances(x, y, not full), wanted[-1])
        for d in wanted:
            far, slack = running[d - 1].ravel(), d * cell.error
            if last(d) < np.inf:
                limit = last(d) + slack
                if far.min() > limit:
                    continue
            else:
                limit = np.inf if far.size <= keep else np.partition(far, keep - 1)[keep - 1] + 2 * slack
            at = np.flatnonzero(far <= limit if limit < np.inf else np.isfinite(far))
            i, j = at // (y.stop - y.start) + x.start, at % (y.stop - y.start) + y.start
            if full and cell.one:
                ok = cell.one(i, j)
                i, j = i[ok], j[ok]
            hold(d, i, j)
    for d in ds:
        settle(d)
    return out


def distinct(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each window (dimension, window, offset) that differs from those before in some bit, and how often it is there."""
    flat = np.ascontiguousarray(z.transpose(1, 0, 2)).reshape(z.shape[1], -1)
    first, times = np.unique(flat.view(np.dtype((np.void, flat.shape[1] * flat.itemsize))).ravel(), return_index=True, return_counts=True)[1:]
    order = np.argsort(first)
    return first[order], times[order].astype(float)


def summary(cell: Cell, high: int | None = None) -> dict[str, np.ndarray]:
    """Of each dimension's distances or, given high, of the sums of the 1 to high smallest: pairs, least, most, total. The cell is in double precision.

    Where no pair is inside the zone, equal windows are compared once and count as often as they are there."""
    n, times = high or len(cell.za), None
    if cell.b[0] - cell.a[-1] > cell.least:
        (a, own), (b, other) = distinct(cell.za), distinct(cell.zb)
        if len(a) * len(b) < 0.9 * len(cell.a) * len(cell.b):
            cell, times = Cell(cell.a[a], cell.za[:, a], cell.b[b], cell.zb[:, b], cell.least, double=True), (own, other)
    out = {"pairs": np.zeros(n, np.int64), "least": np.full(n, np.inf), "most": np.full(n, -np.inf), "total": np.zeros(n)}
    for x, y in cell.tiles():
        ranks = cell.running(cell.distances(x, y), high) if high else (cell.distance(m, x, y) for m in range(n))  # of these one is in memory at a time
        counted = cell.counted(x, y)
        for k, far in enumerate(ranks):
            inside = far.ravel() if counted is True else far[counted]
            if not len(inside):
                continue
            out["pairs"][k] += int(times[0][x].sum() * times[1][y].sum()) if times else len(inside)
            out["total"][k] += times[0][x] @ far @ times[1][y] if times else inside.sum()
            out["most"][k] = max(out["most"][k], inside.max())
            low = inside.min()
            if out["least"][k] and low <= out["least"][k] + (k + 1) * cell.error:
                near = far <= low + 2 * (k + 1) * cell.error
                i, j = np.divmod(np.flatnonzero(near if counted is True else near & counted), far.shape[1])
                for at in range(0, len(i), AGAIN):
                    dist = cell.exact(i[at : at + AGAIN] + x.start, j[at : at + AGAIN] + y.start)
                    out["least"][k] = min(out["least"][k], (ranked(dist)[2] if high else dist)[:, k].min())
    return out
