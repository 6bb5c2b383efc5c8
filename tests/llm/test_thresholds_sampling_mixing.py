import random

import pytest
from pyspark.sql import functions as F

from waymark.llm import mixing, sampling, thresholds


def test_thresholds_against_sorting(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.6 else r.choice("abc"), r.randrange(-(2**63), 2**63), r.choice([0, 1, 5, 40])) for _ in range(4000)]
    rows += [("tie", 77, 3)] * 5
    items = spark.createDataFrame(rows, "g string, h bigint, size int").repartition(6)
    budgets = [(k, g, b) for k, b in enumerate([0, 1, 333, 5000, 10**9]) for g in ("hot", "a", "b", "tie", "none")]
    got = {(x["plan"], x["g"]): x["tau"] for x in thresholds.budget_thresholds(items, spark.createDataFrame(budgets, "plan int, g string, budget int")).collect()}
    for k, g, b in budgets:
        own = sorted((h, s) for x, h, s in rows if x == g)
        want, upto = set(), 0
        for h in sorted({h for h, _ in own}):
            upto += sum(s for x, s in own if x == h)
            if upto > b:
                break
            want.add(h)
        tau = got[k, g]
        assert {h for h, _ in own if tau is None or h <= tau} == want, (k, g)


def pool(spark):
    rows = [(f"i{i}", ["Tower", " tower", "TOWER ", "Gate", None][i % 5], "N" if i % 3 else "S", "x") for i in range(500)]
    rows += rows[:120] + [(None, "Gate", "N", "x")]
    return spark.createDataFrame(rows, "id string, category string, continent string, extra string").repartition(5)


TARGETS = [(1, "category", "tower", 0.5, 0.2, 5), (1, "category", "gate", 0.5, 0.2, 5), (1, "category", "gone", 0.0, 0.2, 3), (2, "continent", "n", 1.0, 0.9, 1), (2, "continent", "s", 0.1, 0.9, 0), (3, "nofield", "n", 0.1, 0.9, 1)]


def test_sampling(spark):
    p, t = pool(spark), spark.createDataFrame(TARGETS, "plan_id int, field_name string, field_value string, target_share double, sample_fraction double, min_rows int")
    q = {(r["plan_id"], r["field_value"]): r for r in sampling.quotas(p, t, "id", ["category", "continent"]).collect()}
    assert (q[1, "tower"]["available"], q[1, "tower"]["quota"], q[1, "gone"]["met"], q[3, "n"]["met"]) == (300, 50, False, False)
    assert (q[2, "n"]["wanted"], q[2, "n"]["available"], q[2, "n"]["quota"], q[2, "n"]["met"]) == (450, 333, 333, False)
    s = sampling.draw(p, t, "id", ["category", "continent"])
    got = {(r[0], r[1]): r[2] for r in s.groupBy("plan_id", "field_value").agg(F.count_distinct("id")).collect()}
    assert got == {(1, "tower"): 50, (1, "gate"): 50, (2, "n"): 333, (2, "s"): 45} and s.count() == 478
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, sampling.draw(p.repartition(2), t, "id", ["category", "continent"]).collect()))
    assert sampling.draw(p.limit(0), t, "id", ["category"]).count() == 0
    assert all(r["quota"] == 0 for r in sampling.quotas(p.limit(0), t, "id", ["category", "continent"]).collect())


def test_sample_is_uniform(spark):
    t = spark.createDataFrame([(1, "category", "gate", 1.0, 0.1, 0)], "plan_id int, field_name string, field_value string, target_share double, sample_fraction double, min_rows int")
    seen = [int(r["id"][1:]) for seed in range(12) for r in sampling.draw(pool(spark), t, "id", ["category"], seed).collect()]
    assert len(seen) == 600 and abs(sum(seen) / 600 - 250) < 30 and len(set(seen)) > 95


def test_reservoirs_hold_the_smallest_hashes(spark, monkeypatch):
    rows = [(f"i{i % 3000}", ["Tower", " tower", "Gate", None][i % 3000 % 4], "x" if i % 2 else None) for i in range(5000)]
    p = spark.createDataFrame(rows, "id string, category string, kind string").repartition(3)
    caps = {"category\x1ftower": 40, "category\x1fgate": 10_000, "kind\x1fx": 5, "kind\x1fgone": 9}
    plain = sampling.reservoirs(p, "id", ["category", "kind"], caps).collect()
    h = {r["id"]: r["h"] for r in p.select("id", thresholds.hash_of(F.col("id"), sampling.SEED).alias("h")).collect()}
    held = {g: set() for g in caps}
    for i, *labels in rows:
        for f, v in zip(("category", "kind"), labels):
            held.get(f"{f}\x1f{v and v.strip().lower()}", set()).add(i)
    seen = {}
    for r in plain:
        if r["n"] is not None:
            seen[r["g"]] = seen.get(r["g"], 0) + r["n"]
    assert seen == {g: len(x) for g, x in held.items()} | {None: 3000}
    for g, cap in caps.items():
        got, best = {r["entity"] for r in plain if r["g"] == g and r["n"] is None}, sorted(held[g], key=h.get)[:cap]
        assert set(best) <= got <= held[g] and len(got) <= cap * 4
    assert next(r["h"] for r in plain if r["entity"]) == h[next(r["entity"] for r in plain if r["entity"])]


def test_mixing(spark):
    r = random.Random(1)
    rows = [(i, "big" if i % 3 else "small", r.randrange(1, 90)) for i in range(900)] + [(1000, None, 50), (1001, "big", 0)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    total = sum(x[2] for x in rows)
    t = spark.createDataFrame([(1, "big", 0.5, 3), (1, "small", 0.5, 5), (2, "small", 0.9, 2), (2, "gone", 0.1, 9), (3, "big", 2.5, 4)], "mix_id int, source string, target_share double, max_repeat int")
    rep = {(x["mix_id"], x["source"]): x for x in mixing.mix_report(sizes, t).collect()}
    assert {k for k, x in rep.items() if x["short"]} == {(2, "small"), (2, "gone")}
    for k in ((1, "big"), (1, "small"), (3, "big")):
        assert 0 <= rep[k]["target_share"] - rep[k]["reached_share"] <= 90 / total and rep[k]["most_copies"] <= rep[k]["max_repeat"]
    small = sum(n for _, s, n in rows if s == "small")
    assert rep[2, "small"]["reached_tokens"] == 2 * small and rep[2, "gone"]["reached_tokens"] == 0
    m = mixing.mix(sizes, t)
    assert m.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0
    empty = mixing.mix_report(sizes.limit(0), t).collect()
    assert len(empty) == 5 and all(x["reached_share"] is None and not x["short"] for x in empty)


@pytest.mark.parametrize("n", [1, 3])
def test_one_source_holds_all(spark, n):
    sizes = spark.createDataFrame([(i, "s", 10) for i in range(50)], "doc_id bigint, source string, n_tokens bigint")
    t = spark.createDataFrame([(1, "s", float(n), n)], "mix_id int, source string, target_share double, max_repeat int")
    x = mixing.mix_report(sizes, t).collect()[0]
    assert x["reached_tokens"] == 500 * n and not x["short"]
