"""Pages with notices, boxes and moves; crawls with retries and redirects; states that survive crashes and bad reads."""

import os

import numpy as np
import pytest

from waymark.operators import pages
from waymark.operators.retries import Retry
from waymark.sources import writers
from waymark.streaming import enrich

SITE, GEO = "c.example", ("geo.example",)
link = lambda name: f'<a href="/wiki/Category:{name}">{name}</a>'
full = lambda *names: [f"https://{SITE}/wiki/Category:{n}" for n in names]


def links(body, head=""):
    return pages.parse_page(f"<html><head>{head}</head><body>{body}</body></html>", f"https://{SITE}/wiki/Category:Here", SITE, GEO)["candidate_links"]


@pytest.mark.parametrize("phrase", ["was moved", "renamed to", "redirect:", "is now at", "Please SEE", "replaced by", "use category"])
def test_blocks_that_speak_of_a_move_come_first(phrase):
    assert links(f'<div id="mw-content-text"><p>{link("Plain")}</p><p>{phrase} {link("New")}</p></div>') == full("New", "Plain")


def test_order_of_links():
    body = f"""<div class="mw-parser-output"><div class="notice">{link("Inner")}</div></div><div class="notice">{link("Outside")}</div><div class="hatnote">{link("Hat")}</div><div class="redirectMsg">{link("Redirect")}</div>
    <div id="mw-content-text"><ul><li>{link("Plain")}</li></ul><div>{link("Before")}<p>moved to {link("Moved")}</p></div><a href="https://elsewhere.example/wiki/Category:X">x</a><a href="/wiki/Page">p</a></div>"""
    canonical = f'<link rel="canonical" href="https://{SITE}/wiki/Category:Canonical">'
    assert links(body, canonical) == full("Redirect", "Hat", "Inner", "Before", "Moved", "Canonical", "Plain")


def test_info_box():
    html = """<table id="wdinfobox"><tr><th class="wikidatainfobox-lcell">Instance of</th><td><a>tower</a>, <a>gate &amp; keep</a></td><td><a>no</a></td></tr>
    <tr><th class="wikidatainfobox-lcell">Height</th><td><a>12 m</a></td></tr><tr><th class="wikidatainfobox-lcell">subclass of</th><td><a> mill </a></td></tr></table><table><tr><th class="wikidatainfobox-lcell">Instance of</th><td><a>outside</a></td></tr></table>"""
    assert pages.parse_page(html, "", SITE, GEO)["instance_tag"] == "tower,gate & keep,mill"


META = '<h1 id="firstHeading">Category: Mill</h1><a href="https://www.wikidata.org/wiki/Q9">q</a>'
PLACE = '<a href="https://geo.example/x?params=1_30_N_2_15_W">m</a>'


def walk(spark, site, start, **options):
    """site: url -> html, (resolved, html) or an exception."""

    def fetch(url):
        page = site[url]
        if isinstance(page, Exception):
            raise page
        return page if isinstance(page, tuple) else (url, page)

    df = spark.createDataFrame([(u,) for u in start], "u string")
    return {r["input_url"]: r for r in pages.crawl(df, "u", fetch, SITE, GEO, concurrency=2, base=0.0, **options).collect()}


def test_crawl(spark):
    a, b, c, d, e, f, g = full(*"ABCDEFG")
    content = lambda inner: f'<div id="mw-content-text">{inner}</div>'
    site = {
        a: content(f"<p>moved to {link('B')}</p><p>{link('C')}</p>"), b: META, c: PLACE + content(link("A")),
        d: (b, META), e: ValueError("gone"), f: content(link("G")), g: content(link("F")), "https://c.example/": '<a href="https://geo.example/x?params=north">m</a>',
    }
    got = walk(spark, site, [a, a, None, "http" + a[5:], d, e, f, "https://c.example/"])
    assert len(got) == 6
    for x in (a, "http" + a[5:]):
        assert (got[x]["latitude"], got[x]["longitude"], got[x]["poi_name"], got[x]["wikidata_id"], got[x]["pages"], got[x]["error"], got[x]["resolved_url"]) == (1.5, -2.25, "Mill", "Q9", 3, None, c)
    assert got[d]["pages"] == 2 and got[d]["resolved_url"] == b and "no coordinates after 2" in got[d]["error"] and got[d]["poi_name"] == "Mill"
    assert got[e]["error"] == "ValueError: gone" and got[e]["pages"] == 1
    assert got[f]["pages"] == 2 and "no coordinates after 2" in got[f]["error"]
    assert "no coordinates in" in got["https://c.example/"]["error"]
    assert walk(spark, site, [d], need_geohack=False)[d]["error"] is None and walk(spark, site, [d], need_geohack=False)[d]["pages"] == 1
    only_place = walk(spark, site, [a], need_meta=False)[a]
    assert (only_place["latitude"], only_place["poi_name"], only_place["pages"]) == (1.5, None, 3)
    assert walk(spark, site, [a], max_pages=2)[a]["error"] == "ValueError: no coordinates after 2 page(s)"
    assert walk(spark, site, []) == {}


def test_crawl_retries(spark, tmp_path):
    count = str(tmp_path / "n")

    def fetch(url):
        with open(count, "a") as f:
            f.write("x")
        if os.path.getsize(count) < 3:
            raise Retry("busy")
        return url, META + PLACE

    r = pages.crawl(spark.createDataFrame([(full("A")[0],)], "u string"), "u", fetch, SITE, GEO, base=0.0, concurrency=1).collect()[0]
    assert r["error"] is None and r["latitude"] == 1.5 and os.path.getsize(count) == 3


def test_swap_survives_a_crash_between_the_renames(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    real = writers._rename

    def crash(fs, one, two):
        if str(one).endswith(".new"):
            raise RuntimeError("killed")
        real(fs, one, two)

    monkeypatch.setattr(writers, "_rename", crash)
    with pytest.raises(RuntimeError):
        writers.swap(spark, path, spark.read.parquet(path).where("id > 2"))
    monkeypatch.setattr(writers, "_rename", real)
    assert not os.path.exists(path)
    assert writers.stored(spark, path).count() == 5
    writers.swap(spark, path, spark.read.parquet(path).where("id > 2"))
    assert spark.read.parquet(path).count() == 2 and not os.path.exists(path + ".old")
    spark.range(9).write.parquet(path + ".old")  # a crash before the old table was removed
    assert writers.stored(spark, path).count() == 2 and not os.path.exists(path + ".old")
    assert writers.stored(spark, str(tmp_path / "none")) is None


def test_an_unreadable_state_is_kept(spark, tmp_path):
    path = str(tmp_path / "state")
    os.mkdir(path)
    with open(f"{path}/part-0.parquet", "w") as f:
        f.write("not a table")
    calls = []
    with pytest.raises(Exception):  # noqa: B017
        enrich.resume(spark, spark.range(3).withColumnRenamed("id", "k"), "k", [], lambda r: calls.append(r) or "x", path, 1).collect()
    assert os.listdir(path) == ["part-0.parquet"]
    rows = spark.createDataFrame([("u", 1, None)], "u string, n int, e string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception):  # noqa: B017
        enrich.stream_last_success(stream, "u", "e", ["n"], path, str(tmp_path / "cp")).awaitTermination()
    assert open(f"{path}/part-0.parquet").read() == "not a table"


def test_encode(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(7)], "k int, t string").repartition(3)
    got = {r["k"]: r["embedding"] for r in enrich.encode(df, "k", ["t"], lambda b: np.column_stack([b["t"].str.len(), b["k"] * 2]), 2).collect()}
    assert got == {i: [i, 2 * i] for i in range(7)}
    assert enrich.encode(df.limit(0), "k", ["t"], lambda b: b, 2).count() == 0
    with pytest.raises(Exception, match="encoder gave"):
        enrich.encode(df, "k", ["t"], lambda b: np.zeros((1, 3)), 2).collect()


def test_geocode_asks_once_for_each_open_place(spark, tmp_path):
    rows = [(1, 1.0, 2.0, None, None), (2, 1.0, 2.0, None, "kept"), (3, 5.0, 5.0, None, None), (4, None, 2.0, None, None), (5, 9.0, 9.0, "XX", None), (6, float("nan"), 1.0, None, None)]
    log = str(tmp_path / "log")

    def provider(p):
        with open(log, "a") as f:
            f.write(f"{p['latitude']}\n")
        if p["latitude"] == 5.0:
            raise OSError("down")
        return {"code": "AA", "city": "town"}

    df = spark.createDataFrame(rows, "i int, lat double, lon double, code string, city string").repartition(4)
    got = {r["i"]: (r["code"], r["city"]) for r in enrich.geocode_missing(df, "lat", "lon", "code", provider, ["code", "city"], 0.0).collect()}
    assert got == {1: ("AA", "town"), 2: ("AA", "kept"), 3: (None, None), 4: (None, None), 5: ("XX", None), 6: (None, None)}
    assert sorted(open(log).read().split()) == ["1.0", "5.0"]

