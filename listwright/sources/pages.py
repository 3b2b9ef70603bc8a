"""Listings out of HTML pages, one profile per kind of page.

Every step works inside the page row (arrays and lambdas), so extraction never shuffles; only
"first URL over all pages" of the profiles that ask for it does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listwright.functions import cards as C
from listwright.functions.salary import salary_dollar_k, salary_from_card
from listwright.functions.text import has_any
from listwright.sources.dom import MAX_LEVELS, Dom, first_of, let, with_dom
from listwright.sources.links import (
    NAVIGATION_HREFS, PROFILES, arrival, first_seen_by_url, prefix_url, resolve_url, www_url,
)

DESCRIPTION_CHARS = 500
FEW_LISTINGS = 5

# Climb limits per profile, fallback selectors, intent words, title patterns, places.
CLIMB = {"cards_path": (100, 8, "highest"), "batch_company": (80, MAX_LEVELS, "link"),
         "concat_text": (50, 6, "highest")}
CARD_CLASSES = ("job", "listing", "card", "post", "item")
CARD_TAGS = ("article", "li")
INTENT_WORDS = ("apply", "role", "hiring", "operations", "ops", "strategy", "analyst")
TITLE_PATTERNS = (
    r"(?i)(?:head|director|vp|chief|lead|senior|junior|associate|manager|coordinator|analyst)"
    r"\s+(?:of\s+)?(?:operations|strategy|growth|finance|business|revenue)",
    r"(?i)(?:operations|strategy|growth|business|revenue)"
    r"\s+(?:lead|manager|associate|analyst|coordinator|director)",
    r"(?i)chief\s+of\s+staff",
)
COMPANY_CARD_CLASSES = ("styles_component", "job", "startup-", "result")
NEARBY_PLACES = r"(?i)San Francisco|Los Angeles|New York|Remote|NYC|SF|LA"

_D = Dom()
_NONE = "array<struct<at:int,url:string,title:string,company:string,location:string,description:string>>"


def _first_by(items: Column, value) -> Column:
    """Items whose value did not occur earlier in the array."""
    return let(items, lambda xs: let(F.transform(xs, value), lambda values: F.filter(
        xs, lambda x, i: F.array_position(values, value(x)) == i + 1)))


def _unfold(rows: DataFrame, items: str) -> DataFrame:
    """One row per array item as `x`. The outer form keeps the optimizer from testing the array
    first, which would derive it twice more."""
    return rows.select("page_id", F.posexplode_outer(items).alias("pos", "x")).where(
        F.col("x").isNotNull())


def card_context(pages: DataFrame, min_chars: int, max_levels: int,
                 past_root: str = "highest") -> DataFrame:
    """(page_id, pos, href, text, card_text): every link with the text of its card."""
    found = F.transform(_D.links(_D.all()), lambda x: F.struct(
        x.alias("link"), _D.card(x["at"], min_chars, max_levels, past_root).alias("card")))
    rows = with_dom(pages).withColumn("found", found).withColumn(
        "found", F.transform("found", lambda f: F.struct(
            f["link"]["at"].cast("bigint").alias("pos"), f["link"]["href"].alias("href"),
            f["link"]["text"].alias("text"), _D.text(f["card"], " ").alias("card_text"))))
    return _unfold(rows, "found").select("page_id", "x.*")


def _profile_cards(pages: DataFrame, profile: str, company_href: str) -> DataFrame:
    """Links of a profile with card text, company links of the card and its text blocks."""
    rule = PROFILES[profile]
    found = F.transform(_first_by(_D.links(_D.all(), rule), lambda x: x["href"]),
                        lambda x: F.struct(x.alias("link"), _D.card(
                            x["at"], *CLIMB[profile]).alias("card")))

    def company_links(card):
        hits = F.filter(_D.inside(card), lambda i: (
            _D.is_link(i) & _D.get("href", i).rlike(company_href)))
        return F.transform(hits, lambda i: F.struct(
            _D.text(i, "").alias("text"), _D.text(i, " ").alias("spaced"),
            F.exists(_D.inside(i), lambda j: _D.get("tag", j) == "img").alias("image")))

    def blocks(card):
        hits = F.filter(_D.inside(card), lambda i: _D.get("tag", i).isin("p", "div"))
        return F.transform(hits, lambda i: _D.text(i, ""))

    rows = with_dom(pages).withColumn("found", found).withColumn(
        "found", F.transform("found", lambda f: F.struct(
            f["link"]["at"].cast("bigint").alias("pos"), f["link"]["href"].alias("href"),
            f["link"]["text"].alias("title"), _D.text(f["card"], " ").alias("card_text"),
            company_links(f["card"]).alias("company_links"),
            blocks(f["card"]).alias("blocks"))))
    return _unfold(rows, "found").select("page_id", "x.*")


def listings_cards_path(pages: DataFrame, base_url: str) -> DataFrame:
    """Cards around '/job/' links with a '/company/' link, salary, level and industry."""
    cards = _profile_cards(pages, "cards_path", "^/company/")
    usable = F.filter("company_links", lambda x: F.length(x["text"]) > 1)
    shown = F.transform(F.filter(usable, lambda x: ~x["image"]),
                        lambda x: F.regexp_replace(x["text"], r"\s*Logo\s*$", ""))
    named = F.transform(usable, lambda x: F.regexp_replace(x["text"], r"\s*Logo\s*$", ""))
    company = F.try_element_at(shown, F.lit(1))
    text = F.col("card_text")
    return cards.where(F.length("title") >= 3).select(
        "page_id", "pos", "title",
        F.coalesce(F.when(company != "", company), F.try_element_at(named, F.lit(1)),
                   F.lit("")).alias("company"),
        C.location_from_card(text).alias("location"),
        C.description_excerpt(F.col("blocks"), text).alias("description"),
        salary_from_card(text).alias("salary"),
        C.experience_level(text).alias("experience_required"),
        C.industry_tags(text).alias("company_industry"),
        resolve_url(F.col("href"), F.lit(base_url)).alias("url"),
    ).select("*", "salary.*").drop("salary")


def listings_batch_company(pages: DataFrame) -> DataFrame:
    """Listings of companies with a batch tag; the first URL over all pages wins.

    A URL counts as seen even when its title turns out too short.
    """
    cards = _profile_cards(pages, "batch_company", "/companies/[^/]+").withColumns({
        "url": www_url(F.col("href")), "ord": arrival(F.col("page_id"), F.col("pos"))})
    text = F.col("card_text")
    spaced = F.filter(F.transform("company_links", lambda x: x["spaced"]),
                      lambda t: F.length(t) >= 3)
    named = F.filter(F.transform(spaced, C.batch_name), lambda n: n.isNotNull())
    first = F.substring(F.try_element_at(F.transform("company_links", lambda x: x["text"]),
                                         F.lit(1)), 1, 80)
    return first_seen_by_url(cards).where(F.length("title") >= 2).select(
        "page_id", "pos", "title",
        F.coalesce(F.try_element_at(named, F.lit(1)), F.when(first != "", first),
                   F.lit("Unknown")).alias("company"),
        C.location_jobtype(text).alias("location"),
        F.substring(text, 1, DESCRIPTION_CHARS).alias("description"), "url")


def _context(i: Column) -> Column:
    card = _D.card(i, *CLIMB["concat_text"])
    return let(let(card, lambda c: _D.text(c, " ")), C.context_fields)


def _primary(base_url: str) -> list[tuple[str, Column]]:
    keep = _D.links(_D.all(), lambda href, text: (
        (F.length(text) >= 3) & ~href.isin(*NAVIGATION_HREFS)
        & PROFILES["concat_text"](href, text)))
    links = F.transform(keep, lambda x: F.struct(
        x["at"].alias("at"), resolve_url(x["href"], F.lit(base_url)).alias("url"),
        C.split_link_text(x["text"]).alias("own"), _context(x["at"]).alias("near")))

    def listing(x):
        own, near = x["own"], x["near"]
        bare = own["company"] == ""
        return F.struct(
            x["at"].alias("at"), x["url"].alias("url"), own["title"].alias("title"),
            F.when(bare, near["company"]).otherwise(own["company"]).alias("company"),
            F.when(bare & (own["location"] == ""), near["location"])
            .otherwise(own["location"]).alias("location"),
            near["description"].alias("description"))

    return [("links", _first_by(links, lambda x: x["url"])),
            ("listings", F.transform("links", listing))]


def _near_listing(link: Column, base_url: str, fallback: Column | None = None) -> Column:
    """A listing from a link struct and the text around it."""
    url = resolve_url(link["href"], F.lit(base_url))

    def listing(near):
        description = near["description"]
        if fallback is not None:
            description = F.when(description != "", description).otherwise(
                F.substring(fallback, 1, DESCRIPTION_CHARS))
        return F.struct(
            link["at"].alias("at"), url.alias("url"), link["text"].alias("title"),
            near["company"].alias("company"), near["location"].alias("location"),
            description.alias("description"))

    return let(_context(link["at"]), listing)


def _structured(base_url: str) -> list[tuple[str, Column]]:
    """Listings from card-like elements; the first selector that yields any is used."""
    sized = F.filter(_D.all(), lambda i: _D.get("chars", i).between(20, 2000))
    texts = F.transform(sized, lambda i: F.struct(
        _D.get("tag", i).alias("tag"), _D.get("cls", i).alias("cls"), _D.text(i, " ").alias("text"),
        first_of(_D.links(_D.inside(i))).alias("link")))
    usable = F.filter(texts, lambda x: (
        has_any(F.lower(x["text"]), INTENT_WORDS)
        & F.coalesce(F.length(x["link"]["text"]) > 3, F.lit(False))))
    tests = [lambda x, _w=w: x["cls"].contains(_w) for w in CARD_CLASSES]
    tests += [lambda x, _t=t: x["tag"] == _t for t in CARD_TAGS]
    tries = [F.filter("elements", lambda x: test(x)) for test in tests]
    chosen = first_of(F.filter(F.array(*tries), lambda t: F.size(t) > 0))
    return [("elements", F.when(F.size("listings") < FEW_LISTINGS, usable)),
            ("extra", F.transform(chosen, lambda x: _near_listing(x["link"], base_url, x["text"])))]


def _by_title(base_url: str) -> list[tuple[str, Column]]:
    """Listings from body links whose text reads like a title."""
    def titled(href, text):
        hit = F.lit(False)
        for p in TITLE_PATTERNS:
            hit = hit | text.rlike(p)
        return (F.length(text) >= 5) & (href != "") & hit

    body = first_of(F.filter(_D.all(), lambda i: _D.get("tag", i) == "body"))
    below = let(body, lambda b: F.coalesce(_D.inside(b), F.array().cast("array<int>")))
    return [("elements", F.when(F.size("listings") < FEW_LISTINGS, _D.links(below, titled))),
            ("extra", F.transform("elements", lambda x: _near_listing(x, base_url)))]


def _exploded(rows: DataFrame) -> DataFrame:
    return _unfold(rows, "listings").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "x.url", "x.title", "x.company",
        "x.location", "x.description")


def listings_concat_text(pages: DataFrame, base_url: str) -> DataFrame:
    """Links whose text runs title, company and place together; first URL per page."""
    rows = with_dom(pages)
    for name, c in _primary(base_url):
        rows = rows.withColumn(name, c)
    return _exploded(rows)


def listings_fallback(pages: DataFrame, base_url: str) -> DataFrame:
    """`listings_concat_text`, topped up on pages with fewer than five listings.

    First from structured cards, then from title-like links, each skipping URLs already found.
    """
    rows = with_dom(pages)
    for name, c in _primary(base_url):
        rows = rows.withColumn(name, c)
    for steps in (_structured(base_url), _by_title(base_url)):
        for name, c in steps:
            rows = rows.withColumn(name, c)
        both = F.concat("listings", F.coalesce("extra", F.array().cast(_NONE)))
        rows = rows.withColumn("listings", _first_by(both, lambda x: x["url"])).drop(
            "elements", "extra")
    return _exploded(rows)


def _company_cards(prefix: str) -> list[tuple[str, Column]]:
    def selected(word):
        return F.filter(_D.all(), lambda i: _D.get("cls", i).contains(word))

    tries = F.array(*[selected(w) for w in COMPANY_CARD_CLASSES])
    cards = F.coalesce(first_of(F.filter(tries, lambda t: F.size(t) > 0)),
                       F.array().cast("array<int>"))

    def named(i):
        cls = _D.get("cls", i)
        return (_D.get("tag", i) == "h2") | cls.contains("company") | cls.contains("name")

    def roles(card):
        def place(i):
            near = F.filter(_D.strings(_D.get("parent", i)), lambda t: t.rlike(NEARBY_PLACES))
            return F.coalesce(first_of(near), F.lit(""))

        return F.transform(_D.links(_D.inside(card), PROFILES["company_card"]), lambda x: F.struct(
            x["text"].alias("title"), prefix_url(x["href"], prefix).alias("url"),
            place(x["at"]).alias("location")))

    def card_struct(card):
        title = first_of(F.filter(_D.inside(card), named))
        return F.struct(
            F.coalesce(let(title, lambda t: _D.text(t, "")), F.lit("")).alias("company"),
            _D.text(card, "").alias("glued"),
            F.substring(_D.text(card, " "), 1, DESCRIPTION_CHARS).alias("description"),
            roles(card).alias("roles"))

    def flat(card):
        kept = F.filter(_first_by(card["roles"], lambda r: r["title"]), lambda r: (
            (F.length(r["title"]) >= 3) & (r["title"] != card["company"])))
        return F.transform(kept, lambda r: F.struct(
            r["title"].alias("title"), card["company"].alias("company"),
            r["location"].alias("location"), card["description"].alias("description"),
            salary_dollar_k(card["glued"]).alias("salary"), r["url"].alias("url")))

    return [("cards", F.transform(cards, card_struct)),
            ("listings", F.flatten(F.transform("cards", flat)))]


def listings_company_card(pages: DataFrame, prefix: str) -> DataFrame:
    """Several roles per company card, each title once per card."""
    rows = with_dom(pages)
    for name, c in _company_cards(prefix):
        rows = rows.withColumn(name, c)
    return _unfold(rows, "listings").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "x.title", "x.company", "x.location",
        "x.description", "x.salary.salary_min", "x.salary.salary_max", "x.url")


def listings_keyword_links(pages: DataFrame, prefix: str) -> DataFrame:
    """Links with a role word, on pages without any company card listing; first href per page."""
    rows = with_dom(pages)
    for name, c in _company_cards(prefix):
        rows = rows.withColumn(name, c)
    links = _D.links(_D.all(), lambda href, text: (
        (F.length(text) >= 5) & PROFILES["keyword_links"](href, text)))

    def company(i):
        def heading(above):
            found = F.filter(_D.inside(above), lambda j: _D.get("tag", j) == "h2")
            return F.when(above >= 0, let(first_of(found), lambda h: _D.text(h, "")))

        return let(_D.get("parent", _D.get("parent", i)), heading)

    found = F.transform(links, lambda x: F.struct(
        x["href"].alias("href"), x["text"].alias("title"),
        F.coalesce(company(x["at"]), F.lit("")).alias("company")))
    rows = rows.where(F.size("listings") == 0).withColumn("found", found).withColumn(
        "found", _first_by(F.col("found"), lambda x: x["href"]))
    return _unfold(rows, "found").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "x.title", "x.company",
        prefix_url(F.col("x.href"), prefix).alias("url"))
