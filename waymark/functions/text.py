"""Text rules: captions, templates, display names, paths, prompts. All JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inverted country names and their natural phrasing (fixed values).
COUNTRY_DISPLAY = {
    "Bolivia, Plurinational State of": "Plurinational State of Bolivia",
    "Congo, The Democratic Republic of the": "Democratic Republic of the Congo",
    "Iran, Islamic Republic of": "Islamic Republic of Iran",
    "Korea, Democratic People's Republic of": "Democratic People's Republic of Korea",
    "Korea, Republic of": "Republic of Korea",
    "Micronesia, Federated States of": "Federated States of Micronesia",
    "Moldova, Republic of": "Republic of Moldova",
    "Palestine, State of": "State of Palestine",
    "Saint Helena, Ascension and Tristan da Cunha": "Saint Helena",
    "Taiwan, Province of China": "Taiwan",
    "Tanzania, United Republic of": "United Republic of Tanzania",
    "Venezuela, Bolivarian Republic of": "Bolivarian Republic of Venezuela",
    "Virgin Islands, British": "British Virgin Islands",
    "Virgin Islands, U.S.": "U.S. Virgin Islands",
    "Bonaire, Sint Eustatius and Saba": "Bonaire, Sint Eustatius and Saba",
}

#: Other names of countries and the ones to use instead (fixed values).
COUNTRY_ALIASES = {"Timor-Leste": "Timor Leste", "Lao People's Democratic Republic": "Laos", "Viet Nam": "Vietnam", "Russian Federation": "Russia"}

#: Query text by granularity (fixed values); both arguments are strings.
QUERY_TEMPLATE = {
    "country": "A %s landmark located in %s",
    "region": "A %s landmark located in the %s region",
    "subregion": "A %s landmark located in %s",
    "city": "A %s landmark located in the city of %s",
}

ERROR_PREFIX = "[error] "
#: A model's opening words that are no part of a caption (fixed pattern).
LEAD = r"(?i)^(caption\s*[:\-]\s*|here(?:'s| is)[^:]*:\s*|(?:this|the)\s+image\s+(?:shows|depicts|features|is|presents)\s+)"
QUOTES = "\"'“”`"


def remap(c: Column, names: dict[str, str]) -> Column:
    """Values of the map replaced, others and null as they are."""
    if not names:
        return c
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def display_country(c: Column) -> Column:
    return remap(c, COUNTRY_DISPLAY)


def common_country(c: Column) -> Column:
    return remap(c, COUNTRY_ALIASES)


def query_text(granularity: str, category: Column, geo: Column) -> Column:
    """Null where either part is null."""
    text = F.format_string(QUERY_TEMPLATE[granularity], category, geo)
    return F.when(category.isNotNull() & geo.isNotNull(), text)


def training_caption(category: Column, country: Column) -> Column:
    return F.concat(F.lit("a "), category, F.lit(" located in "), display_country(country))


def tidy_caption(c: Column) -> Column:
    """White space collapsed, outer quotes and a lead-in gone, first letter in upper case; null stays null."""
    one = F.trim(F.regexp_replace(c, r"\s+", " "))
    bare = F.btrim(one, F.lit(QUOTES))
    cut = F.trim(F.regexp_replace(bare, LEAD, ""))
    return F.concat(F.upper(F.substring(cut, 1, 1)), F.substring(cut, 2, 2**30))


def finish(c: Column) -> Column:
    """Trailing separators off, a full stop unless the text ends in one of .!?; the empty text stays empty."""
    bare = F.rtrim(c, F.lit(" ,;:-"))
    return F.when((bare == "") | bare.rlike(r"[.!?]$"), bare).otherwise(F.concat(bare, F.lit(".")))


def finalize_caption(c: Column, max_words: int) -> Column:
    """struct(caption, n_words, truncated): over the cap the first words, finished; null counts as empty."""
    text = tidy_caption(F.coalesce(c, F.lit("")))
    words = F.filter(F.split(text, " "), lambda w: w != "")
    over = F.size(words) > max_words
    return F.struct(
        F.when(over, finish(F.array_join(F.slice(words, 1, max_words), " "))).otherwise(text).alias("caption"),
        F.least(F.size(words), F.lit(max_words)).alias("n_words"),
        F.when(over, "yes").otherwise("no").alias("truncated"),
    )


def is_error(c: Column) -> Column:
    return F.startswith(F.coalesce(c, F.lit("")), F.lit(ERROR_PREFIX))


def mark_error(c: Column) -> Column:
    return F.concat(F.lit(ERROR_PREFIX), c)


def image_path(src: Column, image: Column) -> Column:
    """src/id.jpg, the ending added once."""
    return F.concat_ws("/", src, F.when(image.endswith(".jpg"), image).otherwise(F.concat(image, F.lit(".jpg"))))


def place_text(city: Column, state: Column, country: Column) -> Column:
    """Null parts are left out."""
    return F.concat(F.lit("A street view photo taken in "), F.concat_ws(", ", city, state, country))


def prompt(base: Column, category: Column, country: Column) -> Column:
    """The base and a line for each hint that is there."""
    hint = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name + ": "), c))
    return F.concat_ws("\n", base, hint("Category", category), hint("Country", country))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def country_code(c: Column) -> Column:
    return F.nullif(F.upper(c), F.lit(""))


def tier(w: Column) -> Column:
    """How many members a cell has, in words."""
    return F.when(w == 1, "W=1").when(w == 2, "W=2").when(w < 7, "W 3-6").when(w < 20, "W 7-19").otherwise("W>=20")


#: Statements about a place in another map, in order of trust, with the kind of thing they name (fixed values).
PLACE_CLAIMS = (("P402", "relation"), ("P11693", "node"), ("P10689", "way"))
_VALUE = "struct<value:string>"
ENTITY = f"struct<entities:map<string,struct<labels:map<string,{_VALUE}>,aliases:map<string,array<{_VALUE}>>,claims:map<string,array<struct<mainsnak:struct<datavalue:{_VALUE}>>>>>>>"


def entity_names(entity: Column) -> Column:
    """map of language to names, the label first, then the aliases; an entity without any has null."""
    none = F.array().cast("array<string>")
    labels = F.transform_values(F.coalesce(entity["labels"], F.create_map().cast(f"map<string,{_VALUE}>")), lambda _, v: F.array(v["value"]))
    aliases = F.transform_values(F.coalesce(entity["aliases"], F.create_map().cast(f"map<string,array<{_VALUE}>>")), lambda _, v: F.transform(v, lambda x: x["value"]))
    both = F.map_zip_with(labels, aliases, lambda _, a, b: F.concat(F.coalesce(a, none), F.coalesce(b, none)))
    return F.when(F.size(both) > 0, both)


def entity_place(entity: Column) -> Column:
    """kind/value of the first statement of the first claim in order of trust that has a value, null without one."""
    value = lambda p: F.get(F.try_element_at(entity["claims"], F.lit(p)), F.lit(0))["mainsnak"]["datavalue"]["value"]
    return F.coalesce(*[F.concat(F.lit(kind + "/"), value(p)) for p, kind in PLACE_CLAIMS])


def parse_entity(document: Column, name: Column) -> Column:
    """The entity of that name in a JSON document of entities; null where the document is broken or another's."""
    return F.try_element_at(F.from_json(document, ENTITY)["entities"], name)
