"""Nearest place of a gazetteer for each coordinate, computed once per distinct coordinate of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.nearby import EARTH_M, unit_vectors, usable
from waymark.runtime import bounded_rows

LEAF = 32


class Gazetteer:
    """Places in a balanced k-d tree of unit vectors, leaves of at most LEAF places."""

    def __init__(self, ids: np.ndarray, xyz: np.ndarray) -> None:
        n = len(ids)
        self.depth = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
        order, bounds = np.arange(n), np.array([0, n])
        for _ in range(self.depth):  # halves by rank along the widest axis, all nodes of a level at once
            size = np.diff(bounds)
            node = np.repeat(np.arange(len(size)), size)
            span = np.maximum.reduceat(xyz[order], bounds[:-1]) - np.minimum.reduceat(xyz[order], bounds[:-1])
            value = xyz[order][np.arange(n), np.argmax(span, axis=1)[node]]
            order = order[np.lexsort((value, node))]
            bounds = np.sort(np.concatenate([bounds, bounds[:-1] + size // 2]))
        self.ids, self.xyz, self.bounds = ids[order], xyz[order], bounds
        low, high = np.minimum.reduceat(self.xyz, bounds[:-1]), np.maximum.reduceat(self.xyz, bounds[:-1])
        self.low, self.high = [low], [high]
        for _ in range(self.depth):
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            self.low.insert(0, low)
            self.high.insert(0, high)

    def _gap(self, p: np.ndarray, level: int, node: np.ndarray) -> np.ndarray:
        d = np.maximum(0, np.maximum(self.low[level][node] - p, p - self.high[level][node]))
        return np.einsum("ij,ij->i", d, d)

    def _look(self, p: np.ndarray, of: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, place, squared chord) of all places in the leaves of the points."""
        size = self.bounds[leaf + 1] - self.bounds[leaf]
        at = np.repeat(of, size)
        place = np.repeat(self.bounds[leaf] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        d = p[at] - self.xyz[place]
        return at, place, np.einsum("ij,ij->i", d, d)

    def nearest(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, metres) by distance in millimetres; equal distances go to the smaller id."""
        every = np.arange(len(p))
        node = np.zeros(len(p), np.int64)
        for level in range(1, self.depth + 1):  # down to one leaf, for a first bound
            node = 2 * node + (self._gap(p, level, 2 * node + 1) < self._gap(p, level, 2 * node))
        at, _, d2 = self._look(p, every, node)
        bound = (np.sqrt(np.minimum.reduceat(d2, np.searchsorted(at, every))) + 1e-9) ** 2
        of, node = every, np.zeros(len(p), np.int64)
        for level in range(1, self.depth + 1):
            of, node = np.concatenate([of, of]), np.concatenate([2 * node, 2 * node + 1])
            keep = self._gap(p[of], level, node) <= bound[of]
            of, node = of[keep], node[keep]
        at, place, d2 = self._look(p, of, node)
        near = d2 <= bound[at]
        at, place, d2 = at[near], place[near], d2[near]
        metres = np.round(2 * EARTH_M * np.arcsin(np.minimum(1, np.sqrt(d2) / 2)), 3)
        order = np.lexsort((self.ids[place], metres, at))
        first = order[np.searchsorted(at[order], every)]
        return self.ids[place[first]], metres[first]


def nearest_place(rows: DataFrame, key: str, lat: str, lon: str, places: DataFrame, place_id: str, place_lat: str, place_lon: str, max_places: int = 200_000) -> DataFrame:
    """(key, place_id, metres): by great-circle distance, equal distances to the smaller id; null for unusable coordinates.

    The gazetteer is broadcast; more than max_places rows are an error. Each batch searches its distinct coordinates in the tree,
    so nothing is shuffled, however many rows a place has."""
    known = places.where(usable(F.col(place_lat), F.col(place_lon))).select(place_id, place_lat, place_lon).orderBy(place_id)
    table = bounded_rows(known, max_places, "the gazetteer")
    tree = Gazetteer(np.array([r[0] for r in table], np.int64), unit_vectors(np.array([r[1] for r in table], float), np.array([r[2] for r in table], float))) if table else None
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (1, 2))
            fine = np.flatnonzero(~np.isnan(x)) if shared.value else np.zeros(0, np.int64)
            best, far, none = np.zeros(len(x), np.int64), np.zeros(len(x)), np.ones(len(x), bool)
            if len(fine):
                place, of = np.unique(np.column_stack([x[fine], y[fine]]), axis=0, return_inverse=True)
                found, metres = shared.value.nearest(unit_vectors(place[:, 0], place[:, 1]))
                best[fine], far[fine], none[fine] = found[of.ravel()], metres[of.ravel()], False
            yield pa.record_batch([batch.column(0), pa.array(best, mask=none), pa.array(far, mask=none)], names=[key, "place_id", "metres"])

    ok = usable(F.col(lat), F.col(lon))
    placed = rows.select(F.col(key), F.when(ok, F.col(lat) + 0.0).alias("x"), F.when(ok, F.col(lon) + 0.0).alias("y"))
    kind = rows.schema[key].dataType.simpleString()
    return placed.mapInArrow(search, f"`{key}` {kind}, place_id bigint, metres double")
