"""Queries over fixtures that hold what a narrower query would leave out, against plain Python."""

import math

from test_packed import plain

from waymark.plans import reference_queries


def save(rows, schema, spark, folder, name):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")


def test_list_filter_replace_unique_takes_every_field(spark, tmp_path):
    parents = {"tower": "stronghold", "keep": "stronghold", "mill/forge": "works", "garden,walled": "garden", 'dock, "wet"': "port", "Zürich gate": "portal", "nothing": None}
    fields = [
        "tower, keep", "tower; mill/forge", 'keep|"dock, ""wet"""', "[tower, 'keep']", "Q12, tower", "Tower, TOWER", "garden,walled; tower", "Zürich gate",
        "tower\nmill/forge", "nothing", "Archive category", "", None, "keep，tower\t mill/forge",
    ]
    save(list(parents.items()), "tags string, human_tag_parent string", spark, tmp_path, "tag_cluster")
    save(list(enumerate(fields)), "scrape_id bigint, instance_tag string", spark, tmp_path, "wikidata")
    want = {}
    for i, field in enumerate(fields):
        found = {parents.get(v) for v in plain(field, [("garden", ",", "walled")])} - {None}
        if found:
            want[i] = ",".join(sorted(found))
    got = {r["scrape_id"]: r["categories"] for r in reference_queries.QUERIES["list_filter_replace_unique"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) == 9


def test_pivot_top_plus_other_counts_every_row(spark, tmp_path):
    labels = ["Crossing", " portal", "lookout", "rail_stop", "garden_park", None]
    countries = ["A", "A", "A", "B", "B", "B", "C", "C", "D", "D", "E", "E", "F", None]
    rows = [(labels[i % 6], countries[i % 14]) for i in range(500)]
    save(rows, "pred_label string, country string", spark, tmp_path, "idk2")
    want = {}
    for label, country in rows:
        row = want.setdefault(label and label.strip().lower(), dict.fromkeys("ABCDE", 0) | {"Other": 0})
        row[country if country in tuple("ABCDE") else "Other"] += 1
    got = {r["label"]: {k: v for k, v in r.asDict().items() if k != "label"} for r in reference_queries.QUERIES["pivot_top_plus_other"](spark, str(tmp_path)).collect()}
    assert got == want and sum(n for row in got.values() for n in row.values()) == len(rows)


def test_polar_locations_are_projected_and_encoded(spark, tmp_path):
    places = [(1, 84.0, 10.0), (2, 85.0, -20.0), (3, -89.5, 180.0), (4, 90.0, 30.0), (5, -90.0, 40.0), (6, 90.5, 0.0), (7, None, 0.0)]
    save(places, "geo_id bigint, latitude double, longitude double", spark, tmp_path, "reverse_geocode")
    got = {n: {r["geo_id"]: r for r in reference_queries.QUERIES[n](spark, str(tmp_path)).collect()} for n in ("equal_earth", "web_mercator", "fourier_features")}
    assert all(set(rows) == {1, 2, 3, 4, 5} for rows in got.values())
    for i, lat, lon in places[:5]:
        m, t = got["web_mercator"][i], math.asin(math.sqrt(3) / 2 * math.sin(math.radians(lat)))
        y = None if abs(lat) == 90 else math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * 6378137 / 20037508.3427892
        assert (m["y"] is None) == (y is None) and (y is None or abs(m["y"] - y) < 1e-7) and abs(m["x"] - math.radians(lon) * 6378137 / 20037508.3427892) < 1e-7
        assert abs(got["equal_earth"][i]["y"] - (0.003796 * t**9 + 0.000893 * t**7 - 0.081106 * t**3 + 1.340264 * t) * 66.50336 / 180) < 1e-7
        assert abs(got["fourier_features"][i]["basic_1"] - math.cos(2 * math.pi * lat / 90)) < 1e-7


def test_page_fields_parses_every_scrape(spark, tmp_path):
    url, geo = "https://commons.heritage-archive.example/wiki/Category:A_%26_B", "https://geohack.heritage-archive.example/x?a=1&params=1_N_2_E"
    full = ("Mill & <Forge>", geo, "Q7", 'tower, "keep" & gate', url)
    rows = [(i, *[None if i >> k & 1 else v for k, v in enumerate(full)]) for i in range(32)]
    save(rows, "scrape_id bigint, poi_name string, geohack_url string, wikidata_id string, instance_tag string, wikimedia_url string", spark, tmp_path, "wikidata")
    got = {r["scrape_id"]: (r["poi_name"], r["geohack_url"], r["wikidata_id"], r["instance_tag"], r["candidate_links"]) for r in reference_queries.QUERIES["page_fields"](spark, str(tmp_path)).collect()}
    assert got == {i: (*fields, [link] if link else []) for i, *fields, link in rows}
