import math

import numpy as np

from waymark.operators.nearby import EARTH_M, Planes, Slabs, chord, close_pairs, near_counts, near_rows, unit_vectors, zone_of


def metres(a, b):
    p, q = unit_vectors(*np.array([[a[0]], [a[1]]])), unit_vectors(*np.array([[b[0]], [b[1]]]))
    return 2 * EARTH_M * math.asin(min(1, float(np.linalg.norm(p - q)) / 2))


def points(n=400, seed=3):
    r = np.random.default_rng(seed)
    lat, lon = np.degrees(np.arcsin(r.uniform(-1, 1, n))), r.uniform(-180, 180, n)
    lat[: n // 2] = np.clip(lat[n // 2 :] + r.normal(0, 0.0003, n // 2), -90, 90)
    lon[: n // 2] = lon[n // 2 :] + r.normal(0, 0.0003, n // 2)
    lat[:4], lon[:4] = [90, 89.9999, 0, 0], [10, -100, 180, -180]
    return lat, np.clip(lon, -180, 180)


def test_local_tree():
    p = unit_vectors(*points(1500))
    for r in (50, 3000, 400_000):
        i, j, d = close_pairs(p, chord(r))
        full = np.argwhere(np.triu(np.linalg.norm(p[:, None] - p[None], axis=2) <= chord(r), 1))
        assert {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist())} == set(map(tuple, full.tolist())) and len(i) == len(full)
    assert all(len(x) == 0 for x in close_pairs(p[:1], 1.0))
    assert len(close_pairs(np.repeat(p[:1], 90, axis=0), 0.1)[0]) == 90 * 89 // 2


def test_cells_cover_every_pair():
    p = unit_vectors(*points(800))
    planes = Planes(p[::9], 40)
    at, leaf, own = planes.cells(p, chord(2000))
    assert own.sum() == len(p)
    cells = {k: set(at[leaf == k].tolist()) for k in set(leaf.tolist())}
    home = dict(zip(at[own].tolist(), leaf[own].tolist()))
    for i, j in np.argwhere(np.triu(np.linalg.norm(p[:, None] - p[None], axis=2) <= chord(2000), 1)):
        assert j in cells[home[i]] and i in cells[home[j]]


def test_rows_against_brute_force(spark):
    lat, lon = points(300)
    rows = [(i, f"e{i % 250}", float(a), float(o)) for i, (a, o) in enumerate(zip(lat, lon))]
    rows += [(1000, "x", None, 1.0), (1001, "y", float("nan"), 0.0), (1002, "z", 999.0, 999.0), (1003, "e5", *rows[5][2:]), (1004, None, *rows[5][2:]), (1005, "q", -0.0, -180.0)]
    df = spark.createDataFrame(rows, "k bigint, e string, lat double, lon double")
    good = [r for r in rows if r[2] is not None and abs(r[2]) <= 90]
    want = {(min(a[0], b[0]), max(a[0], b[0])) for x, a in enumerate(good) for b in good[:x] if (a[1] is None or a[1] != b[1]) and metres(a[2:], b[2:]) <= 50}
    got = [tuple(r) for r in near_rows(df, "k", "e", "lat", "lon", 50.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    counts = {r["k"]: r for r in near_counts(df, "k", "lat", "lon", 50.0).collect()}
    assert len(counts) == len(rows) and counts[1000]["n_here"] is None
    for a in good[:60]:
        same = sum(b[2] == a[2] and b[3] == a[3] for b in good)
        assert (counts[a[0]]["n_here"], counts[a[0]]["n_near"]) == (same, sum(metres(a[2:], b[2:]) <= 50 for b in good) - same)
    assert near_rows(df.limit(0), "k", "e", "lat", "lon", 50.0).count() == 0
    assert near_rows(df.where("k >= 1000 and k < 1003"), "k", "e", "lat", "lon", 50.0).count() == 0


def inside(lat, lon, ring):
    odd = False
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
        if (x1 > lon) != (x2 > lon) and lat > y1 + (lon - x1) / (x2 - x1) * (y2 - y1):
            odd = not odd
    return odd


def test_zones(spark):
    r = np.random.default_rng(8)
    rings = []
    for k in range(12):
        cy, cx, size = r.uniform(-60, 60), r.uniform(-180, 180), r.uniform(2, 15)
        t = np.sort(r.uniform(0, 2 * np.pi, 9))
        rings.append([(cy + size * np.sin(a), cx + size * np.cos(a)) for a in t])
    wrapped = [[(y, (x + 180) % 360 - 180) for y, x in ring] for ring in rings]
    slabs = Slabs(list(range(12)), [np.array([y for y, _ in w]) for w in wrapped], [np.array([x for _, x in w]) for w in wrapped])
    lat, lon = r.uniform(-80, 80, 4000), r.uniform(-180, 180, 4000)
    want = [next((k for k, ring in enumerate(rings) if any(inside(a, o + s, ring) for s in (-360, 0, 360))), -1) for a, o in zip(lat, lon)]
    assert slabs.holding(lat, lon).tolist() == want and max(want) > 0
    pole = Slabs([7], [np.full(6, 80.0)], [np.array([0.0, 60, 120, 180, -120, -60])])
    assert pole.holding(np.array([85.0, 89.9, 79.0]), np.array([10.0, -170, 33])).tolist() == [7, 7, -1]
    zones = spark.createDataFrame([(k, [float(y) for y, _ in w], [float(x) for _, x in w]) for k, w in enumerate(wrapped)] + [(99, None, None)], "zone_id int, ring_latitude array<double>, ring_longitude array<double>")
    df = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(zip(lat[:200], lon[:200]))] + [(500, None, 1.0), (501, float("nan"), 1.0)], "k bigint, lat double, lon double")
    got = {x["k"]: x["zone_id"] for x in zone_of(df, "k", "lat", "lon", zones).collect()}
    assert [got[i] if got[i] is not None else -1 for i in range(200)] == want[:200] and got[500] is None and got[501] is None
