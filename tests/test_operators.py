import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import losses, pages, places, query_sets, ranking, relational, samplers, splits
from waymark.sources import readers, writers
from waymark.streaming import enrich


def test_ranking_against_numpy(spark, monkeypatch):
    r = np.random.default_rng(0)
    v = r.normal(size=(300, 8))
    v[10] = v[11]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(900, None), (901, [1.0])], "vec_id bigint, embedding array<double>").repartition(7)
    q = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    for block in (2048, 2):
        monkeypatch.setattr(ranking, "BLOCK", block)
        got = {}
        for x in ranking.knn(q, df, 20).orderBy("query_id", "rank").collect():
            got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
        for i in range(0, 300, 50):
            s = np.round(v @ v[i], 6)
            want = sorted(range(300), key=lambda j: (-s[j], j))[:20]
            assert [a for a, _ in got[i]] == want
    assert ranking.knn(q, df.limit(0), 5).count() == 0


def ap(pred, gt, k):
    hits = total = 0
    for i, p in enumerate(pred[:k], 1):
        if p in gt:
            hits += 1
            total += hits / i
    return total / min(len(gt), k)


def test_metrics(spark):
    pred = {1: [5, 6, 7, 8], 2: [1, 2, 3], 3: [9]}
    gt = {1: [6, 8, 99], 2: [4], 4: [1, 1, 2]}
    ranked = spark.createDataFrame([(q, i, p) for q, ps in pred.items() for i, p in enumerate(ps, 1)], "query_id bigint, rank int, vec_id bigint")
    rel = spark.createDataFrame([(q, p) for q, ps in gt.items() for p in ps], "query_id bigint, vec_id bigint")
    qs = spark.createDataFrame([(q,) for q in (1, 2, 3, 4)], "query_id bigint")
    per = {r["query_id"]: r for r in ranking.per_query_metrics(qs, ranked, rel, [2, 5]).collect()}
    for k in (2, 5):
        assert per[1][f"ap_{k}"] == pytest.approx(ap(pred[1], gt[1], k))
        assert per[2][f"ap_{k}"] == 0 and per[4][f"ap_{k}"] == 0 and per[3][f"ap_{k}"] is None and per[3][f"recall_{k}"] == 0
    assert per[1]["recall_5"] == pytest.approx(2 / 3) and per[4]["r"] == 3


def test_relational(spark):
    df = spark.createDataFrame([("u", 1, "x", "429"), ("u", 2, "y", None), ("u", 3, "z", "500"), ("v", 4, "w", "500"), ("v", 5, "q", "404"), (None, 6, "n", "")], "url string, n int, v string, error string")
    got = {r["url"]: r["n"] for r in relational.last_success(df, "url", "error", ["n"]).collect()}
    assert got == {"u": 2, "v": 5, None: 6}
    assert [r["url"] for r in relational.pending(df, df.where(relational.succeeded("error")), "url").select("url").distinct().collect()] == ["v"]
    n = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 5, 6, 7, 8, None)], "x int")
    assert [relational.nearest_quantile(n, "x", q).collect()[0][0] for q in (0, 0.25, 0.5, 0.9, 1)] == [1, 3, 5, 7, 8]
    assert n.agg(relational.distinct_count("x").alias("k")).collect()[0][0] == 9
    filled = relational.fill_from(df.select("url", "v"), spark.createDataFrame([("u", "zz")], "url string, v string"), ["url"], ["v"])
    assert filled.count() == 6
    numbered = relational.row_numbers(spark.range(0, 1000, 3).withColumnRenamed("id", "k").repartition(6), "k").orderBy("k").collect()
    assert [r["row_idx"] for r in numbered] == list(range(len(numbered)))


def test_splits_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i, f"u{i % 90}", "c" if i % 90 < 60 else "d" if i % 90 < 64 else "e") for i in range(900)], "k bigint, url string, cell string")
    a, b = (sorted(map(tuple, splits.url_disjoint_split(rows.repartition(n), "url", ["cell"]).collect())) for n in (1, 8))
    assert a == b
    by = {c: [r[4] for r in a if r[1] == c] for c in "cde"}
    assert by["c"].count("test") == by["c"].count("val") == 9 and set(by["d"]) == {"train"} and by["e"].count("test") == 4
    s = splits.stratified_split(rows, "k", ["cell"])
    assert {r["cell"]: r["n"] for r in s.where("is_test").groupBy("cell").agg(F.count("*").alias("n")).collect()} == {"c": 60, "d": 4, "e": 26}
    seeds = splits.balanced_seeds(rows.withColumn("co", F.lit("x")).withColumn("la", F.col("k") % 50), "k", "cell", "co", "url", "la", 30)
    assert 0 < seeds.count() <= 30


def test_samplers(spark):
    rows = spark.createDataFrame([(i, "abcd"[0 if i < 50 else 1 if i < 63 else 2 if i < 66 else 3]) for i in range(67)], "k bigint, cell string")
    pairs = samplers.pair_batches(rows, "k", ["cell"], 8, cap=10).collect()
    used = [x for p in pairs for x in (p["first"], p["second"])]
    assert len(used) == len(set(used)) and len(pairs) == (10 + 6 + 1) // 4 * 4
    cell = {r["k"]: r["cell"] for r in rows.collect()}
    assert all(cell[p["first"]] == cell[p["second"]] for p in pairs)
    assert sorted(p["pos"] for p in pairs) == list(range(len(pairs)))
    pk = samplers.pk_batches(rows, "k", ["cell"], 8, 4, drop_last=False).collect()
    slots = {}
    for r in pk:
        slots.setdefault((r["batch"], r["slot"]), []).append(r["item"])
    assert len(slots) == 12 + 3 + 1 and all(len(v) == 4 and len({cell[x] for x in v}) == 1 for v in slots.values())
    assert all(len(set(v)) == 4 for v in slots.values() if cell[v[0]] != "c")
    w = samplers.class_weights(rows, ["cell"], 0.9).collect()
    assert np.mean([r["weight"] for r in w]) == pytest.approx(1)


def test_losses_against_numpy(spark):
    r = np.random.default_rng(1)
    a, b, cells = r.normal(size=(6, 4)), r.normal(size=(6, 4)), [0, 0, 1, 1, 1, 2]
    df = spark.createDataFrame([(0, i, cells[i], [float(x) for x in a[i]], [float(x) for x in b[i]]) for i in range(6)], "batch int, i int, cell int, a array<double>, b array<double>")
    pairs = losses.batch_pairs(df)
    mask = np.equal.outer(cells, cells) & ~np.eye(6, dtype=bool)

    def side(z):
        lp = z - np.log(np.exp(z).sum(1, keepdims=True))
        has = mask.any(1)
        return (-(lp * mask).sum(1)[has] / mask.sum(1)[has]).mean(), -np.diag(lp).mean()

    want = np.mean([side(a @ b.T / 0.5), side(b @ a.T / 0.5)], axis=0)
    assert losses.multi_positive_infonce(pairs, 0.5).collect()[0]["loss"] == pytest.approx(want[0])
    assert losses.cross_entropy(pairs, 0.5).collect()[0]["loss"] == pytest.approx(want[1])
    alone = losses.batch_pairs(df.where("i in (0, 2)"))
    assert losses.multi_positive_infonce(alone, 0.5).collect()[0]["loss"] == 0


PAGE = """<html><head><link rel="canonical" href="https://c.example/wiki/Category:Canon"><script>"</p>"</script></head><body>
<h1 id="firstHeading">Category: Old mill</h1>
<div class="hatnote">See <a href="/wiki/Category:Hat">hat</a></div>
<div id="mw-content-text"><p>This was MOVED to <a href="/wiki/Category:New">new</a><p><a href="/wiki/Category:Other">other</a><br>
<a href="//geo.example/x?params=1_N_2_E">map</a><a href="https://www.wikidata.org/wiki/Q42">i</a></div>
<table id="wdinfobox"><tr><th class="wikidatainfobox-lcell">Instance of</th><td><a href="#">mill</a>, <a href="#">tower</a></td></tr>
<tr><th class="wikidatainfobox-lcell">height</th><td><a href="#">9 m</a></td></tr></table></body>"""


def test_pages(spark):
    p = pages.parse_page(PAGE, "https://c.example/wiki/Category:Mill", "c.example", ("geo.example",))
    assert (p["poi_name"], p["wikidata_id"], p["instance_tag"]) == ("Old mill", "Q42", "mill,tower")
    assert p["geohack_url"] == "https://geo.example/x?params=1_N_2_E"
    assert [u.rsplit(":", 1)[1] for u in p["candidate_links"]][0] == "Hat" and p["candidate_links"][-1].endswith("Other")
    assert pages.parse_page(None, "", "c.example", ())["candidate_links"] == []
    site = {"https://c.example/wiki/Category:A": '<div class="redirectMsg"><a href="/wiki/Category:B">b</a></div>', "https://c.example/wiki/Category:B": '<h1 id="firstHeading">B</h1><a href="https://geo.example/?params=1_30_S_2_E">m</a><a href="https://www.wikidata.org/wiki/Q1">q</a>'}
    urls = spark.createDataFrame([("http://c.example/wiki/Category:A",), ("http://c.example/wiki/Category:Gone",), (None,)], "url string")
    got = {r["input_url"][-1]: r for r in pages.crawl(urls, "url", lambda u: (u, site[u]), "c.example", ("geo.example",)).collect()}
    assert (got["A"]["latitude"], got["A"]["pages"], got["A"]["error"], got["A"]["wikidata_id"]) == (-1.5, 2, None, "Q1")
    assert "KeyError" in got["e"]["error"] and len(got) == 2


def test_nearest_place(spark):
    gaz = spark.createDataFrame([(1, 0.0, 179.5), (2, 0.0, -179.0), (3, 50.0, 0.0), (4, 50.0, 0.0), (5, None, 1.0)], "pid int, la double, lo double")
    rows = spark.createDataFrame([(1, 0.0, -179.9), (2, 49.0, 1.0), (3, None, 1.0), (4, float("nan"), 0.0), (5, 0.0, -179.9)], "k bigint, lat double, lon double")
    got = {r["k"]: r["place_id"] for r in places.nearest_place(rows, "k", "lat", "lon", gaz, "pid", "la", "lo").collect()}
    assert got == {1: 1, 2: 3, 3: None, 4: None, 5: 1}
    assert places.nearest_place(rows, "k", "lat", "lon", gaz.limit(0), "pid", "la", "lo").where("place_id is null").count() == 5


def test_query_sets(spark):
    rows = spark.createDataFrame([(i, "t" if i < 7 else None, "X" if i % 2 else "Y") for i in range(10)], "row_idx bigint, category string, country string")
    q = query_sets.build_queries(rows, "country", "country", min_relevant=4).collect()
    assert [(r["stratify_key"], r["text"], r["relevant"]) for r in q] == [("t|Y", "A t landmark located in Y", [0, 2, 4, 6])]
    grid = query_sets.templated_grid(spark.createDataFrame([("X", None), ("Korea, Republic of", "R")], "country string, region string"), spark.createDataFrame([("t",), ("u",)], "category string"), rows, "row_idx").collect()
    assert len(grid) == 4 and {(r["text"], tuple(r["relevant"])) for r in grid} >= {("a t located in X", (1, 3, 5)), ("a u located in Republic of Korea", ())}


def test_sources_and_sinks(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "a.csv").write_text('id,n,caption\nx,1,"a, ""b""\nc"\n,2,no key\ny,bad,d\n')
    assert [tuple(r) for r in readers.csv_typed(spark, f"{p}/a.csv", "id string, n int, caption string").where("id is not null").collect()] == [("x", 1, 'a, "b"\nc'), ("y", None, "d")]
    (tmp_path / "b.csv").write_text("id,caption\nx,one\n,two\ny,three,extra\n")
    assert sorted(r["id"] for r in readers.csv_tolerant(spark, f"{p}/b.csv", "id string, caption string", "id", ["id", "caption"]).collect()) == ["x", "y"]
    (tmp_path / "q.json").write_text(json.dumps([{"text": "t", "relevant": [1, 2]}]))
    assert readers.wrapped_json(spark, f"{p}/q.json", "text string, relevant array<bigint>").collect()[0]["relevant"] == [1, 2]
    (tmp_path / "l.json").write_text(json.dumps({"a": ["p", "q"], "b": []}))
    assert [tuple(r) for r in readers.label_prompts(spark, f"{p}/l.json").collect()] == [("a", 0, "p"), ("a", 1, "q")]
    with tarfile.open(tmp_path / "i.tar", "w") as t:
        for name, size in (("a.jpg", 6000), ("small.jpg", 10), ("b.txt", 9000)):
            info = tarfile.TarInfo(name)
            info.size = size
            t.addfile(info, io.BytesIO(b"x" * size))
    assert [tuple(r) for r in readers.tar_members(spark, f"{p}/i.tar").select("member", "size").collect()] == [("a.jpg", 6000)]
    (tmp_path / "g.csv").write_text("LAT,LON\n1.5,2.5\n")
    assert tuple(readers.gallery(spark, f"{p}/g.csv").collect()[0]) == (1.5, 2.5)
    df = spark.range(5)
    df.write.parquet(f"{p}/t")
    writers.swap(spark, f"{p}/t", spark.read.parquet(f"{p}/t").where("id > 2"))
    assert spark.read.parquet(f"{p}/t").count() == 2
    assert readers.harmonise(spark.createDataFrame([("x",)], "pred_label string")).columns == ["category"]


def test_enrich_and_stream(spark, tmp_path):
    waits = []
    tries = iter([enrich.Retry("a", 3.0), enrich.Retry("b"), None])

    def call():
        e = next(tries)
        if e:
            raise e
        return "ok"

    assert enrich.with_retries(call, base=1.0, sleep=waits.append)() == "ok" and waits == [3.0, 2.0]
    rows = [("u", 1, "429"), ("v", 2, "500"), ("u", 3, ""), ("v", 4, "404"), ("u", 5, "500")]
    whole = spark.createDataFrame(rows, "url string, n int, error string")
    states = []
    for name, parts in (("one", 1), ("many", 5)):
        src = f"{tmp_path}/{name}"
        whole.repartition(parts, "n").write.parquet(src)
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(src)
        enrich.stream_last_success(stream, "url", "error", ["n"], f"{src}-state", f"{src}-cp").awaitTermination()
        states.append(sorted(map(tuple, spark.read.parquet(f"{src}-state").collect())))
    assert states[0] == states[1] == [("u", 3, ""), ("v", 4, "404")]


def test_plans(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "vec_id bigint, embedding array<double>")
    plan = ranking.knn(df.select(F.col("vec_id").alias("query_id"), "embedding"), df, 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan
