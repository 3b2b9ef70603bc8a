"""Job-board pages rendered from the listings, ten to a page, for the page profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from checks.views import view

PER_PAGE = 10

TITLE = "replace(title, '&', '&amp;')"
# Every seventeenth listing repeats the address of the one before it.
LINK = "CAST(CASE WHEN ord % 17 = 16 THEN ord - 1 ELSE ord END AS STRING)"

CARDS_PATH = f"""concat('<div class="card"><div>',
  CASE WHEN ord % 4 = 1 THEN concat('<a href="/company/', ord, '"><img src="l.png">', company, ' Logo</a>')
       ELSE concat('<a href="/company/', ord, '"><img src="l.png"></a><a href="/company/', ord, '">', company, '</a>') END,
  '</div><h2><a href="/job/', ord, '/v">', CASE WHEN ord % 23 = 0 THEN 'Op' ELSE {TITLE} END, '</a></h2><span>',
  split_part('Santa Monica, CA, USA#Remote#Lisbon', '#', CAST(1 + ord % 3 AS INT)), '</span> <span>',
  split_part('92K-164K Annually#150K Annually#23-30 Hourly#', '#', CAST(1 + ord % 4 AS INT)), '</span> <span>',
  CASE WHEN ord % 2 = 0 THEN 'Senior level' ELSE 'Junior' END, '</span>',
  CASE WHEN ord % 6 = 0 THEN '<span>| Fintech • Banking |</span>' ELSE '' END,
  CASE WHEN ord % 5 = 0 THEN concat('<a href="/job/', ord, '/v">Apply</a>') ELSE '' END,
  '<p>This role at ', company, ' covers planning, reporting and daily routines across many teams and regions of the firm.</p></div>')"""

BATCH_COMPANY = f"""concat('<div class="row"><a href="https://www.ycombinator.com/companies/c', ord, '/jobs/', {LINK}, '">', {TITLE}, '</a> <a href="/companies/c', ord, '">',
  CASE WHEN ord % 3 = 0 THEN concat(company, ' builds things') ELSE concat(company, ' (S', CAST(10 + ord % 15 AS STRING), ') • makes tools (about 2 months ago)') END,
  '</a><span>fulltime', location, ', US</span><span>· equity and a long enough tail to fill the whole card with text</span></div>')"""

CONCAT_TEXT = f"""concat('<li>', CASE WHEN ord % 4 = 3
  THEN concat('<span>Acme Works — Remote team, we are building tools for many people</span> <a href="/jobs/role-', {LINK}, '">', {TITLE}, '</a>')
  ELSE concat('<a href="/jobs/role-', {LINK}, '">', {TITLE}, split_part('Hedra#Cocoon#Decagon', '#', CAST(1 + ord % 3 AS INT)), ' · ', location, ' · Posted on Feb 7, 2026</a><span>We are building tools for many people in many places</span>') END, '</li>')"""

FALLBACK = f"""CASE
  WHEN ord % 10 < 2 THEN concat('<p><a href="/jobs/role-', ord, '">', {TITLE}, 'Hedra · Remote</a><span>We are building tools for many people in many places</span></p>')
  WHEN ord % 10 < 4 OR (ord % 10 < 6 AND floor(ord / 10) % 2 = 1) THEN concat('<div class="job-box"><a href="/x/', ord, '">View Position ', ord, '</a><span>we are hiring in our office — come and see it</span></div>')
  WHEN ord % 10 IN (6, 7) THEN concat('<p><a href="/y/', ord, '">Head of Growth.Fintech</a> joins a small team that ships every single week</p>')
  ELSE '' END"""

ROLE = f"""concat('<div><a href="/jobs/', ord, '">', {TITLE}, ' ', ord % 2, '</a><span>', location, '</span></div>')"""

KEYWORD = f"""concat('<section><h2>Firm ', ord % 7, '</h2><p><a href="/r/', {LINK}, '">', {TITLE}, '</a></p></section>')"""


def _joined(html: str) -> Column:
    parts = F.sort_array(F.collect_list(F.struct("ord", F.expr(html).alias("html"))))
    return F.array_join(parts["html"], "")


def _pages(spark, sf_dir, html: str, head: str = "", tail: str = "") -> DataFrame:
    """At most PER_PAGE fragments meet per page."""
    page = F.floor(F.col("ord") / PER_PAGE).alias("page_id")
    return view(spark, sf_dir, "listings").groupBy(page).agg(_joined(html).alias("body")).select(
        "page_id", F.concat(F.lit("<html><body>" + head), "body",
                            F.lit(tail + "</body></html>")).alias("html"))


def cards_path(spark, sf_dir) -> DataFrame:
    return _pages(spark, sf_dir, CARDS_PATH)


def batch_company(spark, sf_dir) -> DataFrame:
    return _pages(spark, sf_dir, BATCH_COMPANY)


def concat_text(spark, sf_dir) -> DataFrame:
    return _pages(spark, sf_dir, CONCAT_TEXT,
                  '<a href="./jobs">Jobs board</a><a href="/about">About</a><ul>', "</ul>")


def fallback(spark, sf_dir) -> DataFrame:
    return _pages(spark, sf_dir, FALLBACK, '<script>var a="<a href=1>Chief of Staff</a>"</script>')


def company_card(spark, sf_dir) -> DataFrame:
    """Two company cards of five roles per page."""
    listings = view(spark, sf_dir, "listings")
    half = F.floor(F.col("ord") / 5).alias("half")
    cards = listings.groupBy(half).agg(_joined(ROLE).alias("roles")).selectExpr(
        "half AS ord", "concat('<div class=\"styles_component__x\"><h2>Firm ', half, '</h2>"
        "<a href=\"/company/f\">Firm ', half, '</a>', roles, '<b>$', 80 + half % 50, 'k - $', "
        "90 + half % 50, 'K</b></div>') AS html")
    parts = F.sort_array(F.collect_list(F.struct("ord", "html")))
    return cards.groupBy(F.floor(F.col("ord") / 2).alias("page_id")).agg(
        F.concat(F.lit("<html><body>"), F.array_join(parts["html"], ""),
                 F.lit("</body></html>")).alias("html"))


def keyword_links(spark, sf_dir) -> DataFrame:
    card = ("<div class=\"job-x\"><h2>Firm</h2><a href=\"/jobs/1\">Some role</a></div>")
    pages = _pages(spark, sf_dir, KEYWORD)
    return pages.withColumn("html", F.when(
        F.col("page_id") % 3 == 0, F.concat("html", F.lit(card))).otherwise(F.col("html")))
