"""Points near other points, and the region that holds a point.

Near pairs: coordinates become unit vectors; a sample, a few locations a cell, gives the planes of a k-d tree over all of them; each distinct
location goes to its cell and, where it lies within the radius of a plane, as a halo copy to the cells beyond; each cell then
joins itself with a local k-d tree by chord length. A pair is found exactly once: in the cell that owns its smaller location.
Counts of neighbours need no pairs at all: a cell holds whatever is near the locations it owns, with how many rows each stands for.
The sample only balances the cells; it never changes the result.

Regions: zones are cut into bands of latitude; in each band a sweep over longitude cuts the plane into slabs between neighbouring
corners; each slab knows the polygon edges that cross it; a point counts the edges of its slab below it, by region, and lies
inside where that count is odd.

Null, NaN and out-of-range coordinates are not usable: such rows are in no pair and no zone. Equal coordinates are near each
other at distance 0. The poles and the 180th meridian need no care in the vectors; rings that cross the meridian are unrolled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.runtime import bounded_rows, cut_lineage, join_counted

#: Mean radius of the Earth in metres (fixed value).
EARTH_M = 6_371_008.8
#: Sampled locations for each cell of the k-d tree, and most cells: their planes have a few MB.
SAMPLE_PER_CELL, MAX_CELLS = 6, 2**19
#: Most edges in the slabs of a zone table, which is broadcast.
MAX_EDGES = 20_000_000
LEAF_BLOCK = 32


def usable(lat: Column, lon: Column) -> Column:
    """False for null, NaN and out-of-range coordinates."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)])


def chord(metres: float) -> float:
    return 2 * np.sin(min(metres / EARTH_M, np.pi) / 2)


class Planes:
    """A balanced k-d tree over a sample: axis and place of each inner node, leaves numbered from the left."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        self.axis = np.zeros(2**self.depth, np.int8)
        self.place = np.zeros(2**self.depth)
        level = [sample]
        for d in range(self.depth):
            below = []
            for k, points in enumerate(level):
                node = 2**d + k
                if len(points):
                    self.axis[node] = axis = int(np.argmax(np.ptp(points, axis=0)))
                    self.place[node] = place = float(np.median(points[:, axis]))
                    low = points[:, axis] <= place
                    below += [points[low], points[~low]]
                else:
                    below += [points, points]
            level = below

    def cells(self, points: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ordinal, leaf, own) of every point in its own cell and in all cells within reach along each plane."""
        at, node, own = np.arange(len(points)), np.ones(len(points), np.int64), np.ones(len(points), bool)
        for _ in range(self.depth):
            off = points[at, self.axis[node]] - self.place[node]
            low, near = off <= 0, np.abs(off) <= reach
            home = 2 * node + ~low
            at, node, own = np.concatenate([at, at[near]]), np.concatenate([home, (home ^ 1)[near]]), np.concatenate([own, np.zeros(near.sum(), bool)])
        return at, node - 2**self.depth, own


def close_pairs(points: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, chord) of all pairs i != j within reach, once each, by a k-d tree walked against itself level by level."""
    n = len(points)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, np.zeros(0)
    depth = max(0, int(np.ceil(np.log2(n / LEAF_BLOCK))))
    order, bounds = np.arange(n), np.array([0, n])
    for _ in range(depth):  # halves by rank, so every level has 2^d nodes of nearly equal size
        size = np.diff(bounds)
        node = np.repeat(np.arange(len(size)), size)
        p = points[order]
        span = np.maximum.reduceat(p, bounds[:-1]) - np.minimum.reduceat(p, bounds[:-1])
        value = p[np.arange(n), np.argmax(span, axis=1)[node]]
        order = order[np.lexsort((value, node))]
        bounds = np.unique(np.concatenate([bounds, bounds[:-1] + size // 2]))
    p = points[order]
    leaf = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    lows, highs = [np.minimum.reduceat(p, bounds[:-1])], [np.maximum.reduceat(p, bounds[:-1])]
    while len(lows[0]) > 1:
        odd = len(lows[0]) % 2
        pad = lambda x, f: np.concatenate([x, np.full((1, 3), f)]) if odd else x  # noqa: E731, B023
        lows.insert(0, np.minimum.reduce([pad(lows[0], np.inf)[0::2], pad(lows[0], np.inf)[1::2]]))
        highs.insert(0, np.maximum.reduce([pad(highs[0], -np.inf)[0::2], pad(highs[0], -np.inf)[1::2]]))
    a = b = np.zeros(1, np.int64)
    for low, high in zip(lows[1:], highs[1:]):
        a, b = np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a + 1]), np.concatenate([2 * b, 2 * b + 1, 2 * b, 2 * b + 1])
        keep = (a <= b) & (b < len(low))
        a, b = a[keep], b[keep]
        gap = np.maximum(0, np.maximum(low[a] - high[b], low[b] - high[a]))
        keep = np.einsum("ij,ij->i", gap, gap) <= reach * reach
        a, b = a[keep], b[keep]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    begin, size = bounds[:-1], np.diff(bounds)
    for part in np.array_split(np.arange(len(a)), max(1, len(a) // 4096)):
        x, y = a[part], b[part]
        pairs = size[x] * size[y]
        which = np.repeat(np.arange(len(x)), pairs)
        k = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        i, j = begin[x][which] + k // size[y][which], begin[y][which] + k % size[y][which]
        ok = (leaf[i] != leaf[j]) | (i < j)
        i, j = i[ok], j[ok]
        d = p[i] - p[j]
        d = np.sqrt(np.einsum("ij,ij->i", d, d))
        ok = d <= reach
        found.append((order[i[ok]], order[j[ok]], d[ok]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _cells(places: DataFrame, rows: DataFrame, total: int, reach: float, per_cell: int, keep: str = "") -> DataFrame:
    """(cell, own, lat, lon and, where named, a bigint column) of each location in its own cell and as halo copies.

    The sample is taken of rows (`total` of them), which may repeat locations; what it drew twice counts once."""
    wanted = int(min(MAX_CELLS, max(16, total / per_cell)))
    share = min(1.0, SAMPLE_PER_CELL * wanted / max(1, total))
    sample = rows.select("lat", "lon").sample(share, 17).limit(2 * SAMPLE_PER_CELL * MAX_CELLS).distinct().toPandas()
    leaves = min(wanted, max(1, len(sample) // 2))
    planes = Planes(unit_vectors(sample["lat"].to_numpy(float), sample["lon"].to_numpy(float)), leaves)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            at, leaf, own = planes.cells(unit_vectors(x, y), reach)
            more = [batch.column(2).take(pa.array(at))] if keep else []
            yield pa.record_batch([pa.array(leaf), pa.array(own), pa.array(x[at]), pa.array(y[at]), *more], names=["cell", "own", "lat", "lon", *([keep] if keep else [])])

    return places.select("lat", "lon", *([keep] if keep else [])).mapInArrow(spread, "cell bigint, own boolean, lat double, lon double" + (f", {keep} bigint" if keep else ""))


def _reach(metres: float) -> float:
    return chord(metres) * (1 + 1e-9) + 1e-12


def _ground(d: np.ndarray) -> np.ndarray:
    return 2 * EARTH_M * np.arcsin(np.minimum(1, d / 2))


def near_locations(df: DataFrame, lat: str, lon: str, metres: float, per_cell: int = 8192) -> DataFrame:
    """(lat_1, lon_1, lat_2, lon_2, metres) of the pairs of different usable locations at most `metres` apart, once each."""
    rows = df.select(F.col(lat).alias("lat"), F.col(lon).alias("lon")).where(usable(F.col("lat"), F.col("lon")))
    rows = rows.select((F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon"))
    reach = _reach(metres)

    def join(cell: pd.DataFrame) -> pd.DataFrame:
        x, y, own = cell["lat"].to_numpy(), cell["lon"].to_numpy(), cell["own"].to_numpy()
        i, j, d = close_pairs(unit_vectors(x, y), reach)
        swap = (x[j] < x[i]) | ((x[j] == x[i]) & (y[j] < y[i]))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        ground = _ground(d)
        ok = own[i] & (ground <= metres)
        i, j = i[ok], j[ok]
        return pd.DataFrame({"lat_1": x[i], "lon_1": y[i], "lat_2": x[j], "lon_2": y[j], "metres": ground[ok]})

    return _cells(rows.distinct(), rows, df.count(), reach, per_cell).groupBy("cell").applyInPandas(join, "lat_1 double, lon_1 double, lat_2 double, lon_2 double, metres double")


def near_rows(df: DataFrame, key: str, entity: str, lat: str, lon: str, metres: float) -> DataFrame:
    """(key_1, key_2) of the pairs of rows of different entities at most `metres` apart, smaller key first.

    A null entity differs from every other. The pairs of places are joined back to the rows; the expansion is the result."""
    rows = df.where(usable(F.col(lat), F.col(lon))).select(F.col(key).alias("k"), F.col(entity).alias("e"), (F.col(lat) + 0.0).alias("x"), (F.col(lon) + 0.0).alias("y"))
    pairs = near_locations(df, lat, lon, metres).drop("metres")
    ends = lambda n: rows.select(F.col("k").alias(f"k{n}"), F.col("e").alias(f"e{n}"), F.col("x").alias(f"lat_{n}"), F.col("y").alias(f"lon_{n}"))
    apart = pairs.join(ends(1), ["lat_1", "lon_1"]).select("k1", "e1", "lat_2", "lon_2").join(ends(2), ["lat_2", "lon_2"]).select("k1", "e1", "k2", "e2")
    crowded = rows.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")
    several = rows.join(crowded, ["x", "y"], "left_semi")
    one, two = several.select("x", "y", F.col("k").alias("k1"), F.col("e").alias("e1")), several.select("x", "y", F.col("k").alias("k2"), F.col("e").alias("e2"))
    same = one.join(two, ["x", "y"]).where("k1 < k2").select("k1", "e1", "k2", "e2")
    both = apart.unionByName(same).where(F.col("e1").isNull() | F.col("e2").isNull() | (F.col("e1") != F.col("e2")))
    return both.select(F.least("k1", "k2").alias(f"{key}_1"), F.greatest("k1", "k2").alias(f"{key}_2"))


def near_counts(df: DataFrame, key: str, lat: str, lon: str, metres: float, keep: Sequence[str] = (), per_cell: int = 8192) -> DataFrame:
    """One row per row of df: n_here (rows at the very location, itself included), n_near (rows at other locations within
    `metres`) and nearest_m (distance to the nearest other location within), and the columns to keep. All null where the
    location is not usable.

    Rows count through their location, so a crowded place costs one location however many rows it holds, and its rows aren't
    shuffled to learn its counts. Neighbours are counted where the cell finds them; no pair leaves it."""
    ok = usable(F.col(lat), F.col(lon))
    rows = df.select(F.col(key), F.when(ok, F.col(lat) + 0.0).alias("__x"), F.when(ok, F.col(lon) + 0.0).alias("__y"), *keep)
    here = cut_lineage(rows.where("__x is not null").groupBy(F.col("__x").alias("lat"), F.col("__y").alias("lon")).agg(F.count("*").alias("n")))
    reach = _reach(metres)

    def count(cell: pd.DataFrame) -> pd.DataFrame:
        x, y, own, n = (cell[c].to_numpy() for c in ("lat", "lon", "own", "n"))
        i, j, d = close_pairs(unit_vectors(x, y), reach)
        ground = _ground(d)
        fine = ground <= metres
        i, j, ground = np.concatenate([i[fine], j[fine]]), np.concatenate([j[fine], i[fine]]), np.concatenate([ground[fine], ground[fine]])
        near, least = np.bincount(i, n[j], len(x)).astype(np.int64), np.full(len(x), np.inf)
        np.minimum.at(least, i, ground)
        return pd.DataFrame({"__x": x[own], "__y": y[own], "n": n[own], "n_here": n[own], "n_near": near[own], "nearest_m": np.where(np.isinf(least[own]), np.nan, least[own])})

    cells = _cells(here, here, here.count(), reach, per_cell, "n")
    per_place = cells.groupBy("cell").applyInPandas(count, "__x double, __y double, n bigint, n_here bigint, n_near bigint, nearest_m double")
    per_place = per_place.withColumn("nearest_m", F.nanvl("nearest_m", F.lit(None).cast("double")))
    return join_counted(rows, cut_lineage(per_place), ["__x", "__y"]).select(key, "n_here", "n_near", "nearest_m", *keep)


class Slabs:
    """Polygon edges by slab of longitude, from a sweep over all corners of some zones."""

    def __init__(self, ids: list[int], lats: list[np.ndarray], lons: list[np.ndarray]) -> None:
        edges = []
        for zone, lat, lon in zip(ids, lats, lons):
            lat, lon = np.asarray(lat, float), np.asarray(lon, float)
            fine = np.isfinite(lat) & np.isfinite(lon)
            lat, lon = lat[fine], lon[fine]
            if len(lat) < 3:
                continue
            step = np.diff(np.append(lon, lon[0]))
            step -= 360 * np.round(step / 360)
            lon = lon[0] + np.concatenate([[0], np.cumsum(step)])
            lat = np.append(lat, lat[0])
            if abs(lon[-1] - lon[0]) > 180:  # around a pole: close over it
                pole = 90.0 if lat.mean() > 0 else -90.0
                lat, lon = np.concatenate([lat, [pole, pole, lat[0]]]), np.concatenate([lon, [lon[-1], lon[0], lon[0]]])
            for shift in (-360, 0, 360):
                if lon.max() + shift >= -180 and lon.min() + shift <= 180:
                    x, y = lon + shift, lat
                    flip = x[:-1] > x[1:]
                    edges += [(zone, *e) for e in np.column_stack([np.where(flip, x[1:], x[:-1]), np.where(flip, y[1:], y[:-1]), np.where(flip, x[:-1], x[1:]), np.where(flip, y[:-1], y[1:])]) if e[0] < e[2]]
        e = np.array(edges) if edges else np.zeros((0, 5))
        self.zone, self.x1, self.y1, self.x2, self.y2 = e[:, 0].astype(np.int64), e[:, 1], e[:, 2], e[:, 3], e[:, 4]
        self.cuts = np.unique(np.concatenate([self.x1, self.x2])) if len(e) else np.zeros(0)
        first, stop = np.searchsorted(self.cuts, self.x1), np.searchsorted(self.cuts, self.x2)
        slab = np.repeat(first, stop - first) + np.arange((stop - first).sum()) - np.repeat(np.cumsum(stop - first) - (stop - first), stop - first)
        edge = np.repeat(np.arange(len(e)), stop - first)
        self.edge = edge[np.argsort(slab, kind="stable")]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(slab, minlength=max(1, len(self.cuts))))])

    def holding(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """Smallest id of the zones that hold each point, -1 for none."""
        out = np.full(len(lat), -1, np.int64)
        slab = np.searchsorted(self.cuts, lon, side="right") - 1
        fine = np.flatnonzero((slab >= 0) & (slab < len(self.cuts) - 1))
        s = slab[fine]
        many = self.begin[s + 1] - self.begin[s]
        at = np.repeat(fine, many)
        edge = self.edge[np.repeat(self.begin[s], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        run = (lon[at] - self.x1[edge]) / (self.x2[edge] - self.x1[edge])
        below = self.y1[edge] + run * (self.y2[edge] - self.y1[edge]) <= lat[at]
        at, zone = at[below], self.zone[edge[below]]
        order = np.lexsort((zone, at))
        at, zone = at[order], zone[order]
        if len(at):
            head = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(zone) != 0)))
            odd = np.diff(np.append(head, len(at))) % 2 == 1
            at, zone = at[head[odd]], zone[head[odd]]
            out[at[::-1]] = zone[::-1]
        return out


class Bands:
    """Slabs by band of latitude: bands grow with the root of the zones, so edges in slabs don't grow with their square."""

    def __init__(self, ids: list[int], lats: list[np.ndarray], lons: list[np.ndarray]) -> None:
        lats, lons = [np.asarray(x, float) for x in lats], [np.asarray(x, float) for x in lons]
        fine = [k for k, x in enumerate(lats) if np.isfinite(x).any()]
        low = np.array([np.nanmin(lats[k]) for k in fine])
        high = np.array([np.nanmax(lats[k]) for k in fine])
        around = np.array([abs(((np.diff(np.append(lons[k], lons[k][0])) + 180) % 360 - 180).sum()) > 180 for k in fine], bool)  # holds a pole
        low, high = np.where(around & (low < 0), -90, low), np.where(around & (high > 0), 90, high)
        many = max(1, int(np.sqrt(len(fine) / 4)))
        self.cuts = np.unique(np.quantile((low + high) / 2, np.arange(1, many) / many)) if many > 1 else np.zeros(0)
        first, last = np.searchsorted(self.cuts, low, side="right"), np.searchsorted(self.cuts, high, side="right")
        self.slabs, self.edges = [], 0
        for band in range(len(self.cuts) + 1):
            own = [fine[k] for k in np.flatnonzero((first <= band) & (last >= band))]
            self.slabs.append(Slabs([ids[k] for k in own], [lats[k] for k in own], [lons[k] for k in own]))
            self.edges += len(self.slabs[-1].edge)
            if self.edges > MAX_EDGES:
                raise ValueError(f"the zones have more than {MAX_EDGES} edges in slabs")

    def holding(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """Smallest id of the zones that hold each point, -1 for none."""
        out = np.full(len(lat), -1, np.int64)
        band = np.searchsorted(self.cuts, lat, side="right")
        for b in np.unique(band):
            at = band == b
            out[at] = self.slabs[b].holding(lat[at], lon[at])
        return out


def zone_of(df: DataFrame, key: str, lat: str, lon: str, zones: DataFrame, max_zones: int = 100_000) -> DataFrame:
    """(key, lat, lon, zone_id) of every row, zone_id null where no zone holds it; with several, the smallest id.

    zones: zone_id, ring_latitude, ring_longitude. A fixed table: more than max_zones rows, or MAX_EDGES edges in slabs, are an
    error, not a slow broadcast."""
    rings = bounded_rows(zones.select("zone_id", "ring_latitude", "ring_longitude").where("zone_id is not null and ring_latitude is not null and ring_longitude is not null").orderBy("zone_id"), max_zones, "the zone table")
    bands = Bands([r[0] for r in rings], [np.array(r[1], float) for r in rings], [np.array(r[2], float) for r in rings])
    shared = df.sparkSession.sparkContext.broadcast(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            with np.errstate(invalid="ignore"):
                ok = (np.abs(x) <= 90) & (np.abs(y) <= 180)
            zone = np.full(len(x), -1, np.int64)
            zone[ok] = shared.value.holding(x[ok].astype(float), y[ok].astype(float))
            yield pa.record_batch([*batch.columns, pa.array(zone.astype(np.int32), mask=zone < 0)], names=[key, lat, lon, "zone_id"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(lat).cast("double"), F.col(lon).cast("double")).mapInArrow(run, f"`{key}` {kind}, `{lat}` double, `{lon}` double, zone_id int")
