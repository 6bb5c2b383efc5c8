"""Training-data operators where their bounds used to bite."""

import random
from collections import Counter

from pyspark.sql import functions as F

from waymark.llm import canonical, catalog, grouped_splits, mixing, sampling


def test_any_number_of_labels_gives_splits(spark):
    n = 6000
    rows = [(i, None, None, f"one-off {i}" if i % 4 == 0 else "" if i % 4 == 1 else "tower") for i in range(n)]
    df = spark.createDataFrame(rows, "k bigint, land bigint, image bigint, label string").repartition(5)
    members = grouped_splits.row_groups(df, "k", "land", F.col("image"), F.col("label"))
    split = grouped_splits.assign_groups(members)
    placed = [(r["label"], r["split"]) for r in members.join(split, ["kind", "grp"]).select("label", "split").collect()]
    assert len(placed) == n and len({label for label, _ in placed}) > grouped_splits.MAX_LABELS
    for own in (lambda x: x.startswith("one-off"), lambda x: x == "", lambda x: x == "tower"):
        seen = Counter(s for label, s in placed if own(label))
        whole = sum(seen.values())
        assert all(abs(seen[s] - share * whole) <= 2 for s, share in grouped_splits.SPLITS)


def spied(monkeypatch, module):
    """The results of the module's budget_thresholds, as they come."""
    seen, real = [], module.budget_thresholds
    monkeypatch.setattr(module, "budget_thresholds", lambda *a: seen.append(real(*a)) or seen[-1])
    return seen


def test_p1_found_trims_the_reservoirs(spark, tmp_path, monkeypatch):
    pool = [(f"i{i % 250}", ["Tower", " tower", "Gate"][i % 250 % 3], "N", "X" if i % 250 % 2 else None) for i in range(400)]
    targets = [(p, f, v, s, 0.2, m) for p in (1, 2) for f, v, s, m in [("category", "tower", 0.5 * p, 5), ("category", "gate ", 1.0, 84 * p), ("country", "x", 0.1, 126), ("country", "y", 0.1, 1), ("none", "y", 0.0, 0), ("continent", None, 0.1, 1)]]
    spark.createDataFrame(pool, "id string, category string, continent string, country string").write.parquet(f"{tmp_path}/image_pool.parquet")
    spark.createDataFrame(targets, "plan_id int, field_name string, field_value string, target_share double, sample_fraction double, min_rows int").write.parquet(f"{tmp_path}/sample_target.parquet")
    ids = {"category": {}, "continent": {}, "country": {}, "none": {}}
    for i, *values in pool:
        for f, v in zip(ids, values):
            if v:
                ids[f].setdefault(v.strip().lower(), set()).add(i)
    have = lambda f, v: len(ids[f].get(v and v.strip(), ()))
    want = {(p, f, v) for p, f, v, s, k, m in targets if max(m, s * k * 250) > have(f, v)}
    cuts = spied(monkeypatch, sampling)
    got = catalog.QUERIES["p1_found"](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and 0 < len(want) < len(targets)
    assert len(cuts) == 1 and cuts[0].count() == len(targets) and cuts[0].where("tau is not null").count() > 0
    used = got._jdf.queryExecution().optimizedPlan().toString()
    assert "tau" in used or "below" in used


def test_p9_found_deals_the_mix(spark, tmp_path, monkeypatch):
    sizes = [(i, ["a", "a", "b", None][i % 4], i % 7) for i in range(400)]
    targets = [(1, "a", 0.5, 1), (1, "b", 0.5, 1), (2, "b", 0.6, 3), (2, "gone", 0.1, 2), (3, "a", 0.9, 2), (3, "b", 0.0, 1)]
    df = spark.createDataFrame(sizes, "doc_id bigint, source string, n_tokens bigint").repartition(3)
    spark.createDataFrame(targets, "mix_id int, source string, target_share double, max_repeat int").write.parquet(f"{tmp_path}/mix_target.parquet")
    monkeypatch.setattr(catalog, "_sizes", lambda *_: df)
    total = sum(n for *_, n in sizes)
    have = Counter()
    for _, source, n in sizes:
        have[source] += n
    cuts = spied(monkeypatch, mixing)
    got = sorted(map(tuple, catalog.QUERIES["p9_found"](spark, str(tmp_path)).collect()))
    assert got == sorted((m, s) for m, s, share, most in targets if have[s] * most < share * total) and 0 < len(got) < len(targets)
    assert len(cuts) == 1 and cuts[0].count() == len(targets) and cuts[0].where("tau is not null").count() > 0


def test_every_form_within_two_slips_is_compared():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(5, 8)))
    names = sorted({word() for _ in range(900)})
    matcher = canonical.Matcher([(n, n) for n in names])
    values = sorted({word() for _ in range(200)} - set(names))
    for v, (forms, _) in zip(values, matcher._candidates([(v, v) for v in values])):
        assert {n for n, k in zip(names, canonical.few_slips([v] * len(names), names)) if k <= 2} <= {matcher.forms[f] for f in forms}
    closer_by_cosine = [("abc" * k, "long") for k in range(3, 90)]
    assert canonical.Matcher([*closer_by_cosine, ("abcabd", "D")]).match(["abcabc"]) == ["D"]
    assert canonical.Matcher([*closer_by_cosine, ("abcabd", "D"), ("abcabe", "E")]).match(["abcabc"]) == [""]
