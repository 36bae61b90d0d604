"""Exact nearest neighbours between blocks of rows, in Arrow batches.

Products of matrices, in single precision where that tells vectors apart, give every distance of a block up to a bounded
error. What lies within that error of the last neighbour is computed again as the left fold of doubles that `functions.l2`
is, and only those distances rank and are returned. Equal vectors are held once, with as many of their smallest ids as can
be asked for."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows whose neighbours are a task's, rows that they are held against there, and the distances that are in memory at once.
SOURCES, TARGETS, CELLS = 4096, 32768, 1 << 21
#: Rows and columns of a product, and vectors from which lists get their first bounds.
TILE, FIRST = (1024, 512), 2048


class Block(NamedTuple):
    """Vectors in rows, shorter ones filled up with zeros, whether a component is there, and whether a vector is plain:
    not null, of the whole width and of moderate finite components."""

    values: np.ndarray
    there: np.ndarray
    plain: np.ndarray

    def take(self, rows: np.ndarray) -> Block:
        return Block(self.values[rows], self.there[rows], self.plain[rows])


def block(vectors: pa.Array, width: int) -> Block:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()  # without the components of null vectors
    if not flat.null_count and (sizes == width).all():
        values, there = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), width), np.ones((len(sizes), width), bool)
    else:
        at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        values, there = np.zeros((len(sizes), width)), np.zeros((len(sizes), width), bool)
        values[at] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64)
        there[at] = pc.is_valid(flat).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore"):
        plain = there.all(1) & (np.abs(values) < 1e150).all(1) & (width > 0)
    return Block(values + 0.0, there, plain)  # -0.0 and 0.0 are the same


def columns(b: Block) -> tuple[np.ndarray, np.ndarray | None]:
    """Components by dimension, and whether they are there unless all are."""
    return np.ascontiguousarray(b.values.T), None if b.there.all() else np.ascontiguousarray(b.there.T)


def folded(a: tuple[np.ndarray, np.ndarray | None], b: tuple[np.ndarray, np.ndarray | None], s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of the pairs a[s], b[t] of columns, folded from the left without the components that one of them
    hasn't, and whether they have any in common. s and t may be arrays of any shapes that go together."""
    shape = np.broadcast_shapes(s.shape, t.shape)
    masks = [(there, at) for (_, there), at in ((a, s), (b, t)) if there is not None]
    dist, some = np.zeros(shape), np.full(shape, not masks)
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(len(a[0])):
            x = a[0][d][s] - b[0][d][t]
            x *= x
            if masks:
                both = np.logical_and.reduce([np.broadcast_to(there[d][at], shape) for there, at in masks])
                some |= both
                x[~both] = 0.0
            dist += x
    return dist, some


def distinct(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct vector, the number of each row's vector)."""
    raw = np.ascontiguousarray(np.concatenate([b.values.view(np.uint8).reshape(len(b.plain), -1), b.there.view(np.uint8)], axis=1))
    seen: dict[bytes, int] = {}
    number = np.array([seen.setdefault(v, len(seen)) for v in raw.view(np.dtype((np.void, raw.shape[1]))).ravel().tolist()], np.int64)
    return np.unique(number, return_index=True)[1], number


def ranks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows by the keys, place of each in that order among those with its first key)."""
    by = np.lexsort(keys[::-1])
    first = keys[0][by]
    starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(by) else by
    return by, np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))


class Products:
    """Squared distances of x and y without the squares of x, as products in one precision of vectors scaled by the same
    power of two, and how far they may be off, twice."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kind: type):
        largest = max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0))
        self.scale = 2.0 ** -max(-900.0, np.ceil(np.log2(largest))) if largest > 0 else 1.0
        x, y = x * self.scale, y * self.scale
        self.own, norms = (x * x).sum(1), (y * y).sum(1)
        self.x = np.concatenate([-2.0 * x, np.ones((len(x), 1))], axis=1).astype(kind)
        self.y = np.concatenate([y, norms[:, None]], axis=1).astype(kind)
        # of the products, the norms and the fold: each within width + 3 roundings of the sum of squares; and underflow of both
        roundings = 8.0 * (x.shape[1] + 3)
        self.error = roundings * (float(np.finfo(kind).eps) * (self.own + norms.max(initial=0.0)) + float(np.finfo(kind).tiny) + 5e-324 * self.scale * self.scale)

    def bounds(self, most: np.ndarray, keep: int) -> np.ndarray:
        """What a product is at most where the distance is at most `most`, or, where that is infinite, is among the `keep` least."""
        with np.errstate(over="ignore"):
            out = most * self.scale * self.scale - self.own + self.error  # an infinite one stays so
        free = np.flatnonzero(np.isinf(most))
        if len(self.y) > keep:
            y = self.y[: max(FIRST, 2 * keep)]
            step = max(1, CELLS // len(y))
            for low in range(0, len(free), step):
                rows = free[low : low + step]
                out[rows] = np.partition(self.x[rows] @ y.T, keep - 1, axis=1)[:, keep - 1] + self.error[rows]
        with np.errstate(over="ignore"):
            return np.nextafter(out.astype(self.x.dtype), np.inf, dtype=self.x.dtype)[:, None]

    def within(self, bounds: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row, column) of the rows low to high whose products are within the row's bound, a tile at a time."""
        x, most, wide = self.x[low:high], bounds[low:high], TILE[1]
        out, near = np.empty(len(x) * wide, x.dtype), np.zeros(len(x) * wide + 8, bool)
        for first in range(0, len(self.y), wide):
            y = self.y[first : first + wide]
            cells = len(x) * len(y)
            np.less_equal(np.matmul(x, y.T, out=out[:cells].reshape(len(x), len(y))), most, out=near[:cells].reshape(len(x), len(y)))
            near[cells : cells + 8] = False
            eights = near[: -(-cells // 8) * 8].reshape(-1, 8)
            some = np.flatnonzero(eights.view(np.uint64))  # few are near
            at, bit = np.nonzero(eights[some])
            at = some[at] * 8 + bit
            yield low + at // len(y), first + at % len(y)


def candidates(a: Block, b: Block, most: np.ndarray, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b), each once: all that may be among the `keep` nearest plain rows of b to a plain row of a
    and no further than its `most`, and all pairs with other rows."""
    plain, to = np.flatnonzero(a.plain), np.flatnonzero(b.plain)
    for rows, columns_ in ((np.flatnonzero(~a.plain), np.arange(len(b.plain))), (plain, np.flatnonzero(~b.plain))):
        step = max(1, CELLS // max(1, len(columns_)))
        for low in range(0, len(rows) if len(columns_) else 0, step):
            part = rows[low : low + step]
            yield np.repeat(part, len(columns_)), np.tile(columns_, len(part))
    if not len(plain) or not len(to):
        return
    x, y, most = a.values[plain], b.values[to], most[plain]
    products = Products(x, y, np.float32)
    bounds = products.bounds(most, keep)
    for low in range(0, len(plain), TILE[0]):
        high = min(low + TILE[0], len(plain))
        if products.x.dtype == np.float32:
            found, n = [], 0
            for pairs in products.within(bounds, low, high):
                found.append(pairs)
                n += len(pairs[0])
                if n > 16 * keep * (high - low):
                    break
            else:
                s, t = (np.concatenate(c) for c in zip(*found))
                yield plain[s], to[t]
                continue
            products = Products(x, y, np.float64)  # single precision doesn't tell these apart
            bounds = products.bounds(most, keep)
        for s, t in products.within(bounds, low, high):
            yield plain[s], to[t]


class Lists:
    """The `keep` nearest of all vectors met so far to each row of a, ties to the smaller order; NaN after all numbers (kind
    1) and vectors without a distance after those (kind 2). s: row, t: number of the vector, by row and place."""

    def __init__(self, a: Block, keep: int):
        self.a, self.keep, self.left, self.met = a, keep, columns(a), 0
        self.most = np.full(len(a.plain), np.inf)  # distance of the last of a full list
        none = np.zeros(0, np.int64)
        self.s, self.t, self.order, self.kind, self.value = none, none, none, none.astype(np.int8), np.zeros(0)

    def meet(self, b: Block, order: np.ndarray) -> None:
        """Vectors are numbered as they are met. Few come first, so that lists have bounds when many come."""
        low = 0
        while low < len(order):
            high = min(len(order), low + min(max(FIRST, self.met), TARGETS))
            self.meet_block(b.take(np.arange(low, high)), order[low:high])
            low = high

    def meet_block(self, b: Block, order: np.ndarray) -> None:
        right, found, n = columns(b), [], 0
        for s, t in candidates(self.a, b, self.most, self.keep):
            for low in range(0, len(s), max(1, CELLS)):
                i, j = s[low : low + CELLS], t[low : low + CELLS]
                dist, some = folded(self.left, right, i, j)
                kind = np.where(~some, 2, np.where(np.isnan(dist), 1, 0)).astype(np.int8)
                value = np.where(kind == 0, dist, 0.0)
                most = self.most[i]
                stays = (kind == 0) & (value <= most) | np.isinf(most)
                found.append((i[stays], j[stays] + self.met, order[j[stays]], kind[stays], value[stays]))
                n += len(found[-1][0])
                if n > 4 * CELLS:
                    self.merge(found)
                    found, n = [], 0
        self.merge(found)
        self.met += len(order)

    def merge(self, found: list[tuple[np.ndarray, ...]]) -> None:
        s, t, order, kind, value = (np.concatenate(c) for c in zip((self.s, self.t, self.order, self.kind, self.value), *found))
        by = np.argsort(value)
        by = by[np.argsort(s[by].astype(np.min_scalar_type(len(self.most))), kind="stable")]  # of small numbers in linear time
        if kind.any() or ((s[by[1:]] == s[by[:-1]]) & (value[by[1:]] == value[by[:-1]])).any():
            by = np.lexsort((order, value, kind, s))
        rows = np.bincount(s, minlength=len(self.most))
        place = np.arange(len(by)) - np.repeat(np.cumsum(rows) - rows, rows)
        last = by[place == self.keep - 1]
        self.most[s[last]] = np.where(kind[last] == 0, value[last], np.inf)
        by = by[place < self.keep]
        self.s, self.t, self.order, self.kind, self.value = s[by], t[by], order[by], kind[by], value[by]

    def ids(self, counts: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, distance, kind) of the `keep` nearest ids to each row, by row and place. held: ids of all vectors met, the
        smallest `keep` of each, `counts` of them, by vector."""
        n = counts[self.t]
        each = np.repeat(np.arange(len(n)), n)
        target = held[np.repeat((np.cumsum(counts) - counts)[self.t], n) + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)]
        s, value, kind = self.s[each], self.value[each], self.kind[each]
        if (n > 1).any():
            by, place = ranks(s, kind, value, target)
            by = by[place < self.keep]
            s, target, value, kind = s[by], target[by], value[by], kind[by]
        return s, target, np.where(kind == 1, np.nan, value), kind


def nearest(ids: np.ndarray, a: Block, targets: np.ndarray, b: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, target, distance, whether there is one): each row's k nearest targets that haven't its id, ties to the smaller
    target; NaN after all numbers and rows without a distance after those."""
    keep = k + 1  # its own id may be among them
    b_rows, b_number = distinct(b)
    by, place = ranks(b_number, targets)
    by = by[place < keep]  # the smallest ids of each vector, in the vectors' order
    counts, held = np.bincount(b_number[by], minlength=len(b_rows)), targets[by]
    a_rows, a_number = distinct(a)
    lists = Lists(a.take(a_rows), keep)
    lists.meet(b.take(b_rows), held[np.cumsum(counts) - counts])
    s, target, value, kind = lists.ids(counts, held)
    n = np.bincount(s, minlength=len(a_rows))  # lists of distinct rows, in their order
    n_of, start_of = n[a_number], (np.cumsum(n) - n)[a_number]
    each = np.repeat(np.arange(len(ids)), n_of)
    at = np.repeat(start_of, n_of) + np.arange(len(each)) - np.repeat(np.cumsum(n_of) - n_of, n_of)
    other = ids[each] != target[at]
    each, at = each[other], at[other]
    _, place = ranks(each, np.arange(len(each)))
    each, at = each[place < k], at[place < k]
    return ids[each], target[at], value[at], kind[at] < 2


def pruned(pool: np.ndarray, dist: np.ndarray, valid: np.ndarray, vectors: Block, degree: int, alpha: float) -> np.ndarray:
    """Which candidates stay. pool: rows of `vectors` by row and place, nearest first. One stays where fewer than `degree`
    did before it and none of those is nearer to it by the factor alpha. NaN is larger than all numbers."""
    side = columns(vectors)
    n, width = pool.shape
    kept, size, out = np.zeros((n, degree), np.int64), np.zeros(n, np.int64), np.zeros((n, width), bool)
    for p in range(width):
        between, some = folded(side, side, kept, pool[:, p : p + 1])
        between, own = between * (alpha * alpha), dist[:, p : p + 1]
        nearer = some & ((between < own) | (np.isnan(own) & ~np.isnan(between)))
        hidden = (nearer & (np.arange(degree) < size[:, None])).any(1)
        stays = valid[:, p] & ~hidden & (size < degree)
        out[:, p] = stays
        kept[stays, size[stays]] = pool[stays, p]
        size += stays
    return out


def pruned_lists(src: np.ndarray, dst: np.ndarray, dist: np.ndarray, there: np.ndarray, ids: np.ndarray, vectors: Block, degree: int, alpha: float) -> np.ndarray:
    """Of edges in any order the places of those that stay; the vectors of all dst are among those of `ids`."""
    by_id = np.argsort(ids)
    at = by_id[np.searchsorted(ids, dst, sorter=by_id)]
    by, place = ranks(src, ~there, dist, dst)
    row = np.cumsum(place == 0) - 1
    shape = (int(row.max(initial=-1)) + 1, int(place.max(initial=-1)) + 1)

    def grid(values: np.ndarray) -> np.ndarray:
        out = np.zeros(shape, values.dtype)
        out[row, place] = values[by]
        return out

    return by[pruned(grid(at), grid(dist), grid(there), vectors, degree, alpha)[row, place]]
