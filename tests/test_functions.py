"""Hand-derived cases of the column rules."""

import math

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, text, urls, vectors


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()) or "z string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("r")).collect()[0]["r"]


@pytest.mark.parametrize("raw,want", [
    ("  “caption: a  tower\nby the sea” ", "A tower by the sea"),
    ("This image shows the old mill", "The old mill"),
    ("here's a text: words", "Words"),
    ("éa", "Éa"),
    ("", ""),
    (None, None),
])
def test_tidy(spark, raw, want):
    assert one(spark, text.tidy_caption(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw,n,want", [
    ("one two three", 3, ("One two three", 3, "no")),
    ("one two, three", 2, ("One two.", 2, "yes")),
    ("is it? so", 2, ("Is it?", 2, "yes")),
    (None, 2, ("", 0, "no")),
    ("   ", 2, ("", 0, "no")),
])
def test_finalize(spark, raw, n, want):
    assert tuple(one(spark, text.finalize_caption(F.col("t"), n), t=raw)) == want


def test_names_and_templates(spark):
    assert one(spark, text.display_country(F.col("c")), c="Korea, Republic of") == "Republic of Korea"
    assert one(spark, text.display_country(F.col("c")), c="Elsewhere") == "Elsewhere"
    assert one(spark, text.display_country(F.col("c")), c=None) is None
    assert one(spark, text.query_text("region", F.lit("tower"), F.lit("North"))) == "A tower landmark located in the North region"
    assert one(spark, text.query_text("city", F.lit("tower"), F.col("g")), g=None) is None
    assert one(spark, text.training_caption(F.lit("tower"), F.lit("Virgin Islands, British"))) == "a tower located in British Virgin Islands"
    assert one(spark, text.place_text(F.lit("A"), F.col("s"), F.lit("C")), s=None) == "A street view photo taken in A, C"
    assert one(spark, text.image_path(F.lit("src"), F.lit("a.jpg"))) == "src/a.jpg" and one(spark, text.image_path(F.lit("src"), F.lit("a"))) == "src/a.jpg"
    assert one(spark, text.prompt(F.lit("Describe."), F.col("a"), F.lit("X")), a="") == "Describe.\nCountry: X"
    assert one(spark, text.is_error(text.mark_error(F.lit("x")))) is True and one(spark, text.is_error(F.col("e")), e=None) is False
    assert [one(spark, text.tier(F.lit(w))) for w in (1, 2, 6, 19, 20)] == ["W=1", "W=2", "W 3-6", "W 7-19", "W>=20"]


@pytest.mark.parametrize("value,want", [
    ("48_51_29.1_N_2_17_40.2_E", (48 + 51 / 60 + 29.1 / 3600, 2 + 17 / 60 + 40.2 / 3600)),
    ("48,5_S_2_W_type:landmark", (-48.5, -2.0)),
    ("-10_30_S_5_E", (10.5, 5.0)),
    ("48_N_E", (None, None)),
    ("48_N_7", (None, None)),
    ("N_2_E", (None, None)),
    ("x_N_2_E", (None, 2.0)),
    ("", (None, None)),
    (None, (None, None)),
])
def test_coordinates(spark, value, want):
    got = one(spark, urls.coordinates(F.col("v")), v=value)
    assert tuple(got) == pytest.approx(want) if None not in want else tuple(got) == want


def test_urls(spark):
    u = "http://Geo.Example/x.php?a=1&params=1%255F2_N"
    assert one(spark, urls.host(F.col("u")), u=u) == "geo.example"
    assert one(spark, urls.query_value(F.col("u"), "params"), u=u) == "1_2_N"
    assert one(spark, urls.query_value(F.col("u"), "no"), u=u) is None
    assert one(spark, urls.https(F.col("u")), u=u).startswith("https://Geo")
    assert one(spark, urls.entity_id(F.col("u")), u="/wiki/Q12#x") == "Q12" and one(spark, urls.entity_id(F.col("u")), u="/wiki/P1") is None
    assert one(spark, urls.heading(F.col("u")), u="category: Old mill") == "Old mill"
    assert one(spark, urls.is_category_link(F.col("u"), "c.example"), u="https://C.example/wiki/Category:X") is True
    assert one(spark, urls.is_category_link(F.col("u"), "c.example"), u="no url at all") is False


def test_geo(spark):
    p = one(spark, geo.equal_earth(F.col("a"), F.col("o")), a=0.0, o=90.0)
    assert p["y"] == 0 and p["x"] == pytest.approx(2 * math.sqrt(3) * (math.pi / 2) / (3 * 1.340264) * 66.50336 / 180)
    p = one(spark, geo.web_mercator(F.col("a"), F.col("o")), a=85.05112878, o=180.0)
    assert (p["y"], p["x"]) == pytest.approx((1, 1))
    v = F.array(F.lit(0.25), F.lit(0.5))
    assert one(spark, geo.basic_encoding(v)) == pytest.approx([0, -1, 1, 0], abs=1e-12)
    assert one(spark, geo.positional_encoding(v, 4.0, 2)) == pytest.approx([math.cos(math.pi / 2), math.cos(math.pi), math.sin(math.pi / 2), 0, -1, 1, 0, 0], abs=1e-12)
    assert one(spark, geo.gaussian_encoding(v, [[1, 1]])) == pytest.approx([math.cos(1.5 * math.pi), math.sin(1.5 * math.pi)], abs=1e-12)
    assert one(spark, geo.great_circle_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * geo.EARTH_M)


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.l2_normalise(v)) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.l2_normalise(F.array(F.lit(0.0)))) == [0.0]
    score = vectors.dot(vectors.image_vector(v, v, v), vectors.text_vector(v, v, 2))
    assert one(spark, score) == pytest.approx(2 / math.sqrt(6))
    assert one(spark, vectors.temperature(F.lit(0.7))) == 0.5
    assert one(spark, vectors.class_balance(F.lit(1), 0.9)) == pytest.approx(1.0) and one(spark, vectors.class_balance(F.lit(9), 0)) == 1.0
