"""Fields read out of the visible text of a listing card or link."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from listwright.functions.text import WS, blank, strip

# Place names and experience labels looked for in card text, in order.
CARD_PLACES = (
    ("Los Angeles|Long Beach|Santa Monica|Beverly Hills|Culver City|Playa Vista|El Segundo"
     "|Venice|Marina del Rey", "CA|California"),
    ("San Francisco|Palo Alto|Mountain View|Menlo Park|Sunnyvale|Oakland|San Jose|Redwood City"
     "|Berkeley", "CA|California"),
    ("New York|Brooklyn|Manhattan", "NY|New York"),
)
EXPERIENCE_LABELS = ("Entry level", "Junior", "Mid level", "Senior level", "Expert/Leader")
CONTEXT_PLACES = (
    r"(?i)((?:Los Angeles|San Francisco|New York|Brooklyn|Manhattan|LA|SF|NYC|Bay Area)[^·•|]*)",
    r"(?i)(?:Based in|Located in|HQ:?)\s*([^·•|\n]+)",
    r"(?i)(Remote|Onsite|Hybrid)",
)

_BATCH_LINE = r"(?s)^\s*(.+?)\s*\(([A-Z]\d+)\)\s*[•·]\s*(.+?)(?:\s*\(about\s+.+\))?\s*$"
_BATCH_ONLY = r"^\s*(.+?)\s*\(([A-Z]\d+)\)\s*$"
_JOB_TYPE = r"(?i)(?:fulltime|parttime|contract|internship)\s*([^·\n]*)"
_GLUED = r"(?s)^(.*?[a-z)])([A-Z][a-zA-Z].*)$"
_WORD = r"[\p{L}\p{N}_]"
_WORDS = rf"{_WORD}[\p{{L}}\p{{N}}_{WS}]+"
_INDUSTRY_RUN = rf"((?:{_WORDS}•[{WS}]*)+{_WORDS})"


def location_from_card(text: Column) -> Column:
    """First known city with its state, else Remote, else Hybrid, else empty."""
    found = []
    for cities, states in CARD_PLACES:
        pattern = rf"(?i)((?:{cities})[,\s]*(?:{states})?[,\s]*(?:USA)?)"
        hit = F.regexp_replace(strip(F.regexp_extract(text, pattern, 1)), ",+$", "")
        found.append(F.nullif(hit, F.lit("")))
    mode = F.when(text.contains("Remote"), "Remote").when(text.contains("Hybrid"), "Hybrid")
    return F.coalesce(*found, mode, F.lit(""))


def experience_level(text: Column) -> Column:
    return F.coalesce(*[F.when(text.contains(x), x) for x in EXPERIENCE_LABELS])


def industry_tags(text: Column) -> Column:
    """First run of bullet-separated words, or NULL."""
    run = strip(F.regexp_extract(text, _INDUSTRY_RUN, 1))
    return F.when(text.contains("•"), F.nullif(run, F.lit("")))


def description_excerpt(blocks: Column, card_text: Column) -> Column:
    """First block over 80 characters that is not a skills list, else the card; 500 characters."""
    long = F.filter(blocks, lambda b: (F.length(b) > 80) & ~b.startswith("Top Skills"))
    return F.substring(F.coalesce(F.try_element_at(long, F.lit(1)), card_text), 1, 500)


def batch_name(text: Column) -> Column:
    """'Name (S15)' when the text starts that way, else NULL."""
    def named(pattern):
        return F.when(text.rlike(pattern), F.concat(
            strip(F.regexp_extract(text, pattern, 1)), F.lit(" ("),
            F.regexp_extract(text, pattern, 2), F.lit(")")))

    return F.coalesce(named(_BATCH_LINE), named(_BATCH_ONLY))


def company_batch(text: Column) -> Column:
    first = F.substring(strip(blank(text)), 1, 80)
    return F.coalesce(batch_name(text), F.when(first != "", first), F.lit("Unknown"))


def location_jobtype(text: Column) -> Column:
    """Place after the employment type, else Remote if mentioned, else empty."""
    place = F.regexp_replace(strip(F.regexp_extract(text, _JOB_TYPE, 1)), "^,+|,+$", "")
    return (
        F.when(place != "", place)
        .when(F.lower(text).contains("remote"), "Remote")
        .otherwise("")
    )


def split_link_text(text: Column) -> Column:
    """'Job TitleCompany · Place · Posted on ...' as struct<title, company, location>."""
    parts = F.split(text, rf"[{WS}]*·[{WS}]*")
    several = F.size(parts) >= 2
    head = strip(F.element_at(parts, 1))
    glued = several & head.rlike(_GLUED)
    second = strip(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))
    place = F.when(several & ~second.startswith("Posted"), second).otherwise("")
    return F.struct(
        F.when(glued, strip(F.regexp_extract(head, _GLUED, 1)))
        .when(several, head).otherwise(text).alias("title"),
        F.when(glued, strip(F.regexp_extract(head, _GLUED, 2))).otherwise("").alias("company"),
        strip(F.regexp_replace(place, rf"[{WS}]*Posted on.*$", "")).alias("location"),
    )


def context_fields(text: Column) -> Column:
    """Company, place and excerpt from the text around a link."""
    company = strip(F.regexp_extract(text, r"^([A-Z][A-Za-z0-9\s&.-]+?)(?:\s*[·•|—\-])", 1))
    places = [F.when(text.rlike(p), strip(F.regexp_extract(text, p, 1))) for p in CONTEXT_PLACES]
    return F.struct(
        company.alias("company"),
        F.coalesce(*places, F.lit("")).alias("location"),
        F.substring(text, 1, 500).alias("description"),
    )
