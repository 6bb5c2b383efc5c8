"""Fields of a category page, and the crawl over moved pages. Parsing needs Python; it runs in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import urls as url_rules
from waymark.operators.retries import with_retries
from waymark.runtime import cut_lineage, join_counted

FIELDS = "geohack_url string, poi_name string, wikidata_id string, instance_tag string, candidate_links array<string>"
#: Classes of notice boxes, those that count anywhere and those within the parser's output (fixed values).
NOTICES = ("redirectMsg", "hatnote", "mbox-text")
INNER_NOTICES = ("notice", "plainlinks")
#: What a page says about its successor (fixed values).
MOVED = ("moved", "renamed", "redirect", "now at", "see", "has moved", "replaced by", "use category")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Elements that a following one closes by HTML's rules (fixed values).
IMPLIED = {"p": ("p", "div", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6"), "li": ("li",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "tr": ("tr",)}
INFO_ROWS = ("instance of", "subclass of")


class _Page(HTMLParser):
    """One walk over the page; open elements are kept with their text, links are judged where their blocks end.

    Links rank by (score, block, place): notices by kind of box, blocks that speak of a move by where they begin, the canonical
    address after them, and last all category links of the content."""

    def __init__(self, base: str, site: str, geo: tuple[str, ...]) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.site, self.geo = base, site, geo
        self.open: list[dict] = []
        self.links: list[tuple[int, float, int, str]] = []
        self.n = 0
        self.geohack = self.heading = self.entity = None
        self.tags: list[str] = []

    def _link(self, score: int, block: float, place: int, url: str) -> None:
        p = urlparse(url)
        if (p.hostname or "").lower() == self.site and p.path.startswith("/wiki/Category:"):
            self.links.append((score, block, place, url))

    def _within(self, test: Callable[[dict], bool]) -> bool:
        return any(map(test, self.open))

    def _anchor(self, href: str) -> None:
        full = urljoin(self.base, href)
        host = (urlparse(full).hostname or "").lower()
        if self.geohack is None and "params=" in full and any(g in host for g in self.geo):
            self.geohack = full
        m = re.search(r"/(Q\d+)(?:[^0-9]|$)", href)
        if self.entity is None and m and "wikidata.org" in href:
            self.entity = m[1]
        outer = next((i for i, e in enumerate(self.open) if "mw-parser-output" in e["class"]), len(self.open))
        for k, name in enumerate((*NOTICES, *INNER_NOTICES)):
            if any(name in e["class"] for e in (self.open if name in NOTICES else self.open[outer + 1 :])):
                self._link(0, k, self.n, full)
        for e in self.open:
            if e["block"]:
                e["links"].append((self.n, full))
        if href.startswith("/wiki/Category:") and self._within(lambda e: e["id"] == "mw-content-text"):
            self._link(2, 0, self.n, full)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        self.n += 1
        if tag == "link" and "canonical" in a.get("rel", "").split() and a.get("href"):
            self._link(1, float("inf"), self.n, a["href"])
        if tag == "a" and "href" in a:
            self._anchor(a["href"])
        while self.open and tag in IMPLIED.get(self.open[-1]["tag"], ()):
            self._close(self.open.pop())
        if tag not in VOID:
            content = self._within(lambda e: e["id"] == "mw-content-text")
            row = next((e for e in reversed(self.open) if e["tag"] == "tr"), None)
            cell = tag == "td" and row is not None and not row["cell"]
            if cell:
                row["cell"] = True
            self.open.append({"tag": tag, "id": a.get("id", ""), "class": a.get("class", "").split(), "text": [], "links": [], "at": self.n, "block": content and tag in ("p", "li", "div", "td"), "label": "", "cell": False, "first": cell})

    def handle_data(self, data: str) -> None:
        if any(e["tag"] in ("script", "style") for e in self.open):
            return
        for e in self.open:
            e["text"].append(data)

    def _close(self, e: dict) -> None:
        pieces = [x for x in (re.sub(r"\s+", " ", t).strip() for t in e["text"]) if x]
        if e["tag"] == "h1" and e["id"] == "firstHeading" and self.heading is None:
            self.heading = re.sub(r"^Category:\s*", "", "".join(pieces), flags=re.IGNORECASE)
        if e["block"] and any(k in " ".join(pieces).lower() for k in MOVED):
            for place, url in e["links"]:
                self._link(1, e["at"], place, url)
        row = next((x for x in reversed(self.open) if x["tag"] == "tr"), None)
        if row is not None and self._within(lambda x: x["id"] == "wdinfobox"):
            text = "".join(pieces)
            if e["tag"] == "th" and "wikidatainfobox-lcell" in e["class"] and not row["label"]:
                row["label"] = text.lower()
            if e["tag"] == "a" and row["label"] in INFO_ROWS and self._within(lambda x: x["first"]) and text:
                self.tags.append(text)

    def handle_endtag(self, tag: str) -> None:
        if any(e["tag"] == tag for e in self.open):
            while self.open:
                e = self.open.pop()
                self._close(e)
                if e["tag"] == tag:
                    break

    def close(self) -> None:
        super().close()
        while self.open:
            self._close(self.open.pop())


def parse_page(html: str | None, base: str, site: str, geo: tuple[str, ...]) -> dict:
    """Missing fields are None; links come best first, each once. A null page has nothing."""
    page = _Page(base or "", site, geo)
    page.feed(html or "")
    page.close()
    links = list(dict.fromkeys(u for *_, u in sorted(page.links)))
    return {"geohack_url": page.geohack, "poi_name": page.heading, "wikidata_id": page.entity, "instance_tag": ",".join(page.tags) or None, "candidate_links": links}


def page_fields(df: DataFrame, key: str, html: str, url: str, site: str, geo: tuple[str, ...]) -> DataFrame:
    """(key, the page's fields), one row per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = pd.DataFrame([parse_page(h, u, site, geo) for h, u in zip(b[html], b[url])], columns=["geohack_url", "poi_name", "wikidata_id", "instance_tag", "candidate_links"])
            yield pd.concat([b[[key]].reset_index(drop=True), found], axis=1)

    return df.select(key, html, url).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {FIELDS}")


CRAWLED = ["input_url", "resolved_url", "geohack_url", "latitude", "longitude", "poi_name", "wikidata_id", "instance_tag", "pages", "error"]
_PAGE = f"url string, resolved string, {FIELDS}, failure string"


def _fetched(wanted: DataFrame, fetch: Callable[[str], tuple[str, str]], site: str, geo: tuple[str, ...], concurrency: int, tries: int, base: float) -> DataFrame:
    """wanted: url. The parsed page of each, or its failure; one partition per concurrent fetch."""
    names = [c.split()[0] for c in _PAGE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(fetch, tries, base)
        for b in batches:
            out = []
            for url in b["url"]:
                try:
                    resolved, html = call(url)
                    out.append({"url": url, "resolved": resolved, **parse_page(html, resolved, site, geo)})
                except Exception as e:  # noqa: BLE001
                    out.append({"url": url, "failure": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=names).astype(object).where(lambda x: x.notna(), None)

    return wanted.select("url").repartition(concurrency).mapInPandas(run, _PAGE)


def crawl(urls: DataFrame, url: str, fetch: Callable[[str], tuple[str, str]], site: str, geo: tuple[str, ...], max_pages: int = 4, concurrency: int = 8, need_geohack: bool = True, need_meta: bool = True, tries: int = 8, base: float = 1.0) -> DataFrame:
    """From each distinct url over moved pages, best link next, until what is needed is known or max_pages pages are seen.

    A round for all inputs at a time: the first page that an input hasn't seen is its next one; pages that no round has fetched are
    fetched once each, however many inputs lead there, with retries and doubling waits; what they say is joined to the inputs.
    Coordinates are the first found; name, entity and tags those of the last page that has them. A page under another address than
    asked for is seen next under its own. fetch(url) gives (resolved url, html), raises Retry for failures worth another try or
    anything else; a failure ends up in the row, never in the job. Where coordinates are needed and not found the row is an error.
    Null urls are left out."""
    none = lambda kind: F.lit(None).cast(kind)
    state = urls.where(F.col(url).isNotNull()).select(F.col(url).alias("input_url")).distinct().select(
        "input_url", F.array(F.regexp_replace("input_url", "^http://", "https://")).alias("queue"), F.array().cast("array<string>").alias("seen"), F.col("input_url").alias("resolved_url"),
        *[none("string").alias(c) for c in ("geohack_url", "poi_name", "wikidata_id", "instance_tag", "error")], none("double").alias("latitude"), none("double").alias("longitude"), F.lit(False).alias("done"),
    )
    pages = None
    for _ in range(max_pages):
        unseen = F.array_except("queue", "seen")
        state = cut_lineage(state.withColumn("next", F.when(~F.col("done") & (F.size("seen") < max_pages), F.try_element_at(unseen, F.lit(1)))))
        wanted = state.where("next is not null").groupBy(F.col("next").alias("url")).agg(F.count("*").alias("n"))
        new = wanted if pages is None else wanted.join(pages.select("url"), "url", "left_anti")
        if not new.limit(1).count() and pages is None:
            break
        found = _fetched(new, fetch, site, geo, concurrency, tries, base)
        pages = cut_lineage(found if pages is None else pages.unionByName(found))
        side = pages.withColumnsRenamed({c: f"p_{c}" for c in pages.columns if c != "url"}).join(wanted, "url").withColumnRenamed("url", "next")
        joined = join_counted(state, cut_lineage(side), ["next"])
        state = _after_page(joined, max_pages, need_geohack, need_meta)
    missing = F.when(F.col("latitude").isNull(), F.concat(F.lit("ValueError: no coordinates after "), F.size("seen").cast("string"), F.lit(" page(s)"))) if need_geohack else none("string")
    return state.withColumn("pages", F.size("seen")).withColumn("error", F.coalesce("error", missing)).select(*CRAWLED)


def _after_page(state: DataFrame, max_pages: int, need_geohack: bool, need_meta: bool) -> DataFrame:
    """Each input's state after its next page; as it was where there was none."""
    empty = F.array().cast("array<string>")
    take = F.lit(need_geohack) & F.col("latitude").isNull() & F.col("p_geohack_url").isNotNull()
    placed = state.withColumn("place", F.when(take, url_rules.coordinates(url_rules.query_value(F.col("p_geohack_url"), "params"))))
    seen = F.when(F.col("next").isNotNull(), F.concat("seen", F.array("next"))).otherwise(F.col("seen"))
    moved = F.when(~F.array_contains(seen, F.col("p_resolved")) & (F.size(seen) < max_pages), F.array("p_resolved")).otherwise(empty)
    bad = take & (F.col("place.latitude").isNull() | F.col("place.longitude").isNull())
    latest = {c: F.coalesce(F.when(F.lit(need_meta), F.nullif(F.col(f"p_{c}"), F.lit(""))), F.col(c)) for c in ("poi_name", "wikidata_id", "instance_tag")}
    after = placed.select(
        "input_url", "done", F.array_distinct(F.concat(moved, "queue", F.coalesce("p_candidate_links", empty))).alias("queue"), seen.alias("seen"), F.coalesce("p_resolved", "resolved_url").alias("resolved_url"),
        F.when(take & ~bad, F.col("p_geohack_url")).otherwise(F.col("geohack_url")).alias("geohack_url"), *[c.alias(n) for n, c in latest.items()],
        F.coalesce("error", "p_failure", F.when(bad, F.concat(F.lit("ValueError: no coordinates in "), "p_geohack_url"))).alias("error"),
        *[F.when(take & ~bad, F.col(f"place.{c}")).otherwise(F.col(c)).alias(c) for c in ("latitude", "longitude")],
    )
    enough = F.lit(not need_geohack) | F.col("latitude").isNotNull()
    if need_meta:
        enough &= F.col("poi_name").isNotNull() & F.col("wikidata_id").isNotNull()
    return after.withColumn("done", F.col("done") | F.col("error").isNotNull() | ((F.size("seen") > 0) & enough))
