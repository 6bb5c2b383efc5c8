import random

from waymark.operators.hotkeys import hot_keys, key_states


def brute(rows):
    out = {}
    for k in {r[0] for r in rows if r[0] is not None}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[3]))
        at = [r[1] for r in own if r[1] is not None]
        gaps = [b - a for a, b in zip(at, at[1:])]
        labels = [r[2] or "" for r in own]
        out[k] = (len(own), min(at, default=None), max(at, default=None), max(gaps, default=None), 1 + sum(a != b for a, b in zip(labels, labels[1:])))
    return out


def test_states_and_hot_keys(spark):
    r = random.Random(4)
    rows = [("hot" if r.random() < 0.5 else r.choice(["a", "b", "c", None, "d%d" % r.randrange(40)]), None if r.random() < 0.05 else float(r.randrange(500)), r.choice(["x", "y", None]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, at double, label string, part bigint").repartition(5)
    for n in (1, 7, 32):
        s = key_states(df, "key", "at", "part", "label", partitions=n)
        got = {x["key"]: (x["n"], x["first_at"], x["last_at"], x["longest_gap"], x["n_runs"]) for x in s.collect()}
        assert got == brute(rows)
    keyed = [k for k, *_ in rows if k is not None]
    want = {k for k in set(keyed) if keyed.count(k) > 0.02 * len(keyed)}
    assert {x["key"] for x in hot_keys(key_states(df, "key", None, "part"), 0.02).collect()} == want
    assert key_states(df.limit(0), "key", "at", "part").count() == 0


def test_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [("k", float(i), "ab"[i // 4 % 2], i) for i in range(20)] + [("l", 1.0, "a", 99)]
        df = spark.createDataFrame(rows, "key string, at double, label string, tie bigint")
        got = {x["key"]: (x["n"], x["first_at"], x["last_at"], x["longest_gap"], x["n_runs"]) for x in key_states(df, "key", "at", "tie", "label", partitions=2).collect()}
        assert got == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
