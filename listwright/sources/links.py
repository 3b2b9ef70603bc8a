"""Links out of raw pages with native regular expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from listwright.functions.text import WS, has_any, strip
from listwright.operators.skew import first_per_key

_ANCHOR = r"(?is)<a\b[^>]*>.*?</a\s*>"
_HREF = r"(?is)^<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"

# Entities decoded in link text, link rules and their words.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
NAVIGATION_HREFS = ("#", "/", "./", "./jobs", "./investors", "./news", "./subscribe")
INDUSTRY_TAGS = (
    ".productivity", ".fintech", ".ai", ".devtools", ".analytics", ".web3", ".healthcare",
    ".cybersecurity", ".hr & recruiting", ".construction", ".education", ".real estate",
)
JOB_PLATFORMS = (
    "greenhouse.io", "lever.co", "ashbyhq.com", "workable.com", "jobs.lever",
    "boards.greenhouse", "apply.workable", "careers.", "jobs.", "/careers", "/jobs", "/job/",
)
JOB_WORDS = (
    "operations", "ops", "strategy", "chief of staff", "analyst", "associate", "coordinator",
    "manager", "business", "finance", "growth", "revenue", "head of", "director", "lead",
)
ROLE_WORDS = (
    "operations", "ops", "strategy", "chief of staff", "associate", "analyst", "manager",
    "finance", "growth", "revenue",
)


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, text) for every anchor with an href, in page order."""
    tags = F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(0))

    def href(tag):
        return unescape(F.concat(*[F.regexp_extract(tag, _HREF, g) for g in (1, 2, 3)]))

    def text(tag):
        return strip(unescape(F.regexp_replace(tag, rf"[{WS}]*<[^>]*>[{WS}]*", "")))

    return pages.select("page_id", F.posexplode_outer(tags).alias("pos", "tag")).where(
        F.col("tag").rlike(_HREF)
    ).select("page_id", F.col("pos").cast("bigint").alias("pos"),
             href(F.col("tag")).alias("href"), text(F.col("tag")).alias("text"))


def _plain_path(path: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""
    none = F.array().cast("array<string>")
    kept = F.aggregate(F.split(path, "/"), none, lambda acc, s: (
        F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))))
    tail = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.concat(F.array_join(kept, "/"), tail)


def resolve_url(href: Column, base: Column) -> Column:
    """Links with a scheme of their own stay; the others are joined with the base URL."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^([^#]*)", 1)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*$", "")
    own_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    return (
        F.when(href.startswith("http") | href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href == "", base)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("#"), F.concat(query, href))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .when(href.startswith("/"), F.concat(origin, _plain_path(own_path), rest))
        .otherwise(F.concat(origin, _plain_path(F.concat(folder, own_path)), rest))
    )


def prefix_url(href: Column, prefix: str) -> Column:
    """Plain concatenation, for sources that never resolve paths."""
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(prefix), href))


def www_url(href: Column) -> Column:
    return F.when(href.startswith("http"), href).otherwise(
        F.concat(F.lit("https://www."), F.regexp_replace(href, "^/+", "")))


def first_seen_by_url(links: DataFrame, order: str = "ord") -> DataFrame:
    """Per URL the first occurrence in arrival order."""
    return first_per_key(links, "url", order)


def arrival(page_id: Column, pos: Column) -> Column:
    """Order of a link over all pages of a source. A place or page number that does not fit its
    24 or 39 bits is an error, never another link's number."""
    fits = (pos >= 0) & (pos < 1 << 24) & (page_id >= 0) & (page_id < 1 << 39)
    return F.when(fits, F.shiftleft(page_id, 24) + pos).otherwise(
        F.raise_error(F.lit("page or place number out of range")).cast("bigint"))


@dataclass(frozen=True)
class LinkRule:
    """When a link counts as a job link: a path pattern, words in its text, or the tiered rule."""

    href_pattern: str = ""
    text_words: tuple = ()
    tiered: bool = False

    def __call__(self, href: Column, text: Column) -> Column:
        if self.tiered:
            return tiered_job_link(href, text)
        if self.href_pattern:
            return href.rlike(self.href_pattern)
        return has_any(F.lower(text), self.text_words)


def tiered_job_link(href: Column, text: Column) -> Column:
    """Rejections first, then platform, path and wording, in this order."""
    words, target = F.lower(text), F.lower(href)
    return (
        F.when(has_any(words, INDUSTRY_TAGS), False)
        .when(~strip(text).contains(" "), False)
        .when(has_any(target, JOB_PLATFORMS), True)
        .when(target.rlike("/jobs?/") & (F.length(href) > 10), True)
        .otherwise(has_any(words, JOB_WORDS))
    )


PROFILES = {
    "cards_path": LinkRule(href_pattern=r"^/job/"),
    "batch_company": LinkRule(href_pattern=r"ycombinator\.com/companies/.+/jobs/"),
    "company_card": LinkRule(href_pattern=r"/jobs/|/company/"),
    "keyword_links": LinkRule(text_words=ROLE_WORDS),
    "concat_text": LinkRule(tiered=True),
}
