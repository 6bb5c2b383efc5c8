"""Searches that used to compare everything with everything, against that."""

import numpy as np

from waymark.operators import nearby, places, ranking


def test_gazetteer_against_all_distances():
    r = np.random.default_rng(3)
    for n in (1, 2, 33, 700, 5000):
        lat, lon = np.degrees(np.arcsin(r.uniform(-1, 1, n))), r.uniform(-180, 180, n)
        lat[n // 2 :], lon[n // 2 :] = lat[: n - n // 2], lon[: n - n // 2]  # equal places: the smaller id wins
        ids = r.permutation(n).astype(np.int64) + 7
        xyz = nearby.unit_vectors(lat, lon)
        p = np.concatenate([nearby.unit_vectors(np.degrees(np.arcsin(r.uniform(-1, 1, 300))), r.uniform(-180, 180, 300)), xyz[:50]])
        got, metres = places.Gazetteer(ids, xyz).nearest(p)
        d = np.round(2 * nearby.EARTH_M * np.arcsin(np.minimum(1, np.linalg.norm(p[:, None] - xyz[None], axis=2) / 2)), 3)
        want = np.array([min(zip(row, ids))[1] for row in d])
        assert (got == want).all() and np.allclose(metres, d.min(axis=1), atol=2e-3)


def rings(n, r):
    out = []
    for k in range(n):
        lat, lon, size = r.uniform(-70, 70), r.uniform(-180, 180), r.uniform(0.05, 1.5)
        turn = np.sort(r.uniform(0, 2 * np.pi, 7))
        out.append((k, lat + size * np.sin(turn), (lon + size * np.cos(turn) + 180) % 360 - 180))
    out.append((n, np.array([80.0, 82, 81, 83]), np.array([0.0, 90, 180, -90])))  # around the pole
    out.append((n + 1, np.array([np.nan, 1, 2]), np.array([1.0, 2, 3])))
    return out


def test_bands_hold_what_one_sweep_holds():
    r = np.random.default_rng(5)
    zones = rings(600, r)
    ids, lats, lons = zip(*zones)
    lat, lon = r.uniform(-90, 90, 20_000), r.uniform(-180, 180, 20_000)
    inside = np.concatenate([np.array([x.mean() for x in lats[:600]])]), np.array([y[0] for y in lons[:600]])
    lat, lon = np.concatenate([lat, inside[0]]), np.concatenate([lon, inside[1]])
    one, many = nearby.Slabs(list(ids), list(lats), list(lons)), nearby.Bands(list(ids), list(lats), list(lons))
    assert len(many.slabs) > 5 and (one.holding(lat, lon) == many.holding(lat, lon)).all() and (many.holding(lat, lon) >= 0).sum() > 300
    assert (many.holding(np.array([89.0]), np.array([10.0])) == 600).all()
    small, large = (nearby.Bands(*map(list, zip(*rings(n, np.random.default_rng(1))))).edges for n in (500, 8000))
    assert large < 16**1.6 * small  # far from the square
    assert nearby.Bands([], [], []).holding(np.zeros(3), np.zeros(3)).tolist() == [-1] * 3


def test_knn_in_passes_and_blocks(spark, monkeypatch):
    r = np.random.default_rng(2)
    v = np.round(r.normal(size=(400, 5)), 1)
    v[200:260] = v[:60]  # equal scores
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    q = df.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    s = np.round(v.astype(np.float32).astype(float) @ v.astype(np.float32).astype(float).T, 6)
    want = {(i, k + 1): j for i in range(0, 400, 3) for k, j in enumerate(sorted(range(400), key=lambda j: (-s[i, j], j))[:7])} | {(900, 0): None}
    want.pop((900, 0))
    for block, per_pass in ((2048, 16 * 2048), (10, 40)):
        monkeypatch.setattr(ranking, "BLOCK", block)
        monkeypatch.setattr(ranking, "PASS", per_pass)
        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ranking.knn(q, df, 7).collect()}
        assert got == want
    assert ranking.knn(q.limit(0), df, 7).count() == 0 and ranking.knn(q, df.limit(0), 7).count() == 0


def test_nearest_centre(spark):
    c = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "c int, embedding array<double>")
    v = spark.createDataFrame([(1, [5.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0])], "vec_id bigint, embedding array<float>")
    assert {r["vec_id"]: (r["nearest"], r["score"]) for r in ranking.nearest_centre(v, c, "vec_id", "c").collect()} == {1: (1, 5.0), 2: (3, 1.0), 3: (None, None), 4: (None, None)}


def test_counts_in_a_crowd(spark):
    rows = [(i, 10.0, 20.0) for i in range(500)] + [(500, 10.0, 20.0003), (501, 10.0002, 20.0), (502, None, 1.0), (503, 50.0, 50.0)]
    df = spark.createDataFrame(rows, "k bigint, lat double, lon double").repartition(4)
    got = {r["k"]: (r["n_here"], r["n_near"], r["nearest_m"]) for r in nearby.near_counts(df, "k", "lat", "lon", 50.0).collect()}
    assert len(got) == 504 and got[0][:2] == (500, 2) and got[500][:2] == (1, 501) and got[502] == (None, None, None) and got[503] == (1, 0, None)
    assert abs(got[0][2] - 22.24) < 0.1 and abs(got[500][2] - 32.85) < 0.1
