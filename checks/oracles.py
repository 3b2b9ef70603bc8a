"""DuckDB SQL with the expected result of each query, written independently of the Spark plans."""

from __future__ import annotations

from checks import boards
from checks.views import AS_OF, with_views
from listwright import prefs as P
from listwright.operators import export, filters, health
from listwright.functions import cards
from listwright.sources import links

ORACLES = {}

WS = r"\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}"
PUNCT = rf"[^\p{{L}}\p{{N}}_{WS}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def low(col: str) -> str:
    return f"lower(coalesce({col}, ''))"


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def norm_company(c: str) -> str:
    words = ", ".join(q(w) for w in P.COMPANY_SUFFIXES)
    return (f"array_to_string(list_filter(regexp_split_to_array(regexp_replace({low(c)}, '{PUNCT}', '', 'g'), "
            f"'[{WS}]+'), lambda w: w <> '' AND w NOT IN ({words})), ' ')")


def norm_title(c: str) -> str:
    return strip(f"regexp_replace({low(c)}, '{PUNCT}', '', 'g')")


def norm_location(c: str, test=any_of) -> str:
    t = strip(low(c))
    whens = " ".join(f"WHEN {test(t, words)} THEN '{city}'" for city, words in P.CITY_KEYWORDS)
    return f"CASE {whens} ELSE {t} END"


def whole_words(t, words):
    return rf"regexp_matches({t}, '\b({'|'.join(words)})\b')"


KEY = f"concat({norm_company('company')}, '|', {norm_title('title')}, '|', {norm_location('location')})"
COMPLETENESS = """(CASE WHEN length(coalesce(description, '')) > 100 THEN 3 ELSE 0 END
  + CASE WHEN salary_min IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN salary_max IS NOT NULL THEN 2 ELSE 0 END
  + CASE WHEN coalesce(experience_required, '') <> '' THEN 1 ELSE 0 END
  + CASE WHEN coalesce(date_posted, '') <> '' THEN 1 ELSE 0 END
  + CASE WHEN coalesce(company_industry, '') <> '' THEN 1 ELSE 0 END)"""


def oracle(name: str, sql: str, *views: str) -> None:
    ORACLES[name] = with_views(sql, *views)


# Sources

ANCHOR = r"(?is)<a\b[^>]*>.*?</a\s*>"
LINKS = rf"""tags AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '{ANCHOR}')) AS tag,
    unnest(range(len(regexp_extract_all(html, '{ANCHOR}')))) AS pos FROM pages),
  found AS (SELECT page_id, base, pos, regexp_extract(tag, '(?is)^<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1) AS href,
    trim(regexp_replace(tag, '\s*<[^>]*>\s*', '', 'g')) AS text FROM tags)"""
DECODED = ("replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')")
oracle("extract_links", f"WITH {LINKS} SELECT page_id, pos, href, {DECODED} AS text FROM found")
oracle("resolve_url", rf"""WITH {LINKS}, made AS (SELECT page_id, pos, base, CASE pos % 11
    WHEN 8 THEN 'mailto:a@b.c' WHEN 9 THEN 'tel:' || pos WHEN 10 THEN 'javascript:void(0)'
    WHEN 0 THEN href WHEN 1 THEN 'http://abs.test' || href WHEN 2 THEN '#' || pos WHEN 3 THEN '?p=' || pos
    WHEN 4 THEN 'sub' || href WHEN 5 THEN '../up' || href WHEN 6 THEN '//cdn.test' || href ELSE '' END AS href,
    regexp_extract(base, '^(https?:)', 1) AS scheme, regexp_extract(base, '^(https?://[^/]*)', 1) AS origin,
    regexp_extract(base, '^https?://[^/]*([^?#]*)', 1) AS path FROM found)
  SELECT page_id, pos, CASE WHEN pos % 11 > 7 THEN href ELSE CASE pos % 11 WHEN 0 THEN origin || href WHEN 1 THEN href
    WHEN 2 THEN regexp_replace(base, '#.*', '') || href WHEN 3 THEN origin || path || href
    WHEN 4 THEN origin || regexp_replace(path, '[^/]*$', '') || href
    WHEN 5 THEN origin || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]*/$', '') || substr(href, 4)
    WHEN 6 THEN scheme || href ELSE base END END AS url FROM made""")
oracle("first_seen_url", f"""WITH {LINKS} SELECT href AS url, page_id, pos FROM found
  QUALIFY row_number() OVER (PARTITION BY href ORDER BY page_id, pos) = 1""")

TIERED = f"""CASE WHEN {any_of('lower(text)', links.INDUSTRY_TAGS)} THEN false
  WHEN NOT contains(trim(text), ' ') THEN false WHEN {any_of('lower(href)', links.JOB_PLATFORMS)} THEN true
  WHEN regexp_matches(lower(href), '/jobs?/') AND length(href) > 10 THEN true
  ELSE {any_of('lower(text)', links.JOB_WORDS)} END"""
oracle("job_link_filter", f"""WITH l AS (SELECT ord, CASE ord % 3 WHEN 0 THEN '/JOBS/' || ord
    WHEN 1 THEN '/job/' || ord || '/x' ELSE '/team/' || ord END AS href,
    CASE WHEN ord % 7 = 0 THEN 'Bank for shops.Fintech ' ELSE '' END || title AS text FROM listings)
  SELECT ord, starts_with(href, '/job/') AS cards_path,
    regexp_matches(href, 'ycombinator\\.com/companies/.+/jobs/') AS batch_company,
    contains(href, '/jobs/') OR contains(href, '/company/') AS company_card,
    {any_of('lower(text)', links.ROLE_WORDS)} AS keyword_links, {TIERED} AS concat_text FROM l""", "listings")

# In the given pages a link sits in li, ul and nav (all short) below body, as nodes 11, 13, ...
_PLAIN = "x"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_entity}', '{_char}')"
oracle("card_context", rf"""WITH {LINKS},
  body AS (SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(
      regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '(?s)<!--.*?-->', '<!>', 'g'), '<[^>]*>'),
      lambda x: {strip(_PLAIN)}), lambda x: x <> ''), ' ') AS all_text FROM pages),
  nav AS (SELECT page_id, string_agg({DECODED}, ' ' ORDER BY pos) AS nav_text FROM found GROUP BY page_id)
  SELECT page_id, 11 + 2 * pos AS pos, href, {DECODED} AS text,
    CASE WHEN length(nav_text) > 100 THEN nav_text ELSE all_text END AS card_text
  FROM found JOIN body USING (page_id) JOIN nav USING (page_id)""")

PAGE = "CAST(floor(ord / 10) AS BIGINT) AS page_id"
oracle("listings_cards_path", f"""SELECT {PAGE}, title, company,
    CASE ord % 3 WHEN 0 THEN 'Santa Monica, CA, USA' WHEN 1 THEN 'Remote' ELSE '' END AS location,
    concat('This role at ', company, ' covers planning, reporting and daily routines across many teams and regions of the firm.') AS description,
    CASE ord % 4 WHEN 0 THEN 92000.0 WHEN 1 THEN 150000.0 WHEN 2 THEN 47840.0 END::DOUBLE AS salary_min,
    CASE ord % 4 WHEN 0 THEN 164000.0 WHEN 1 THEN 150000.0 WHEN 2 THEN 62400.0 END::DOUBLE AS salary_max,
    CASE WHEN ord % 2 = 0 THEN 'Senior level' ELSE 'Junior' END AS experience_required,
    CASE WHEN ord % 6 = 0 THEN 'Fintech • Banking' END AS company_industry,
    concat('https://board.test/job/', ord, '/v') AS url
  FROM listings WHERE ord % 23 <> 0""", "listings")
BATCH_TEXT = """concat(title, ' ', CASE WHEN ord % 3 = 0 THEN company || ' builds things'
    ELSE concat(company, ' (S', 10 + ord % 15, ') • makes tools (about 2 months ago)') END,
    ' fulltime', location, ', US · equity and a long enough tail to fill the whole card with text')"""
oracle("listings_batch_company", f"""SELECT {PAGE}, title,
    CASE WHEN ord % 3 = 0 THEN substr(title, 1, 80) ELSE concat(company, ' (S', 10 + ord % 15, ')') END AS company,
    CASE WHEN location = '' THEN ' US' ELSE location || ', US' END AS location,
    substr({BATCH_TEXT}, 1, 500) AS description,
    concat('https://www.ycombinator.com/companies/c', ord, '/jobs/', {boards.LINK}) AS url
  FROM listings""", "listings")
SPAN = "We are building tools for many people in many places"
oracle("listings_concat_text", f"""SELECT {PAGE}, concat('https://board.test/jobs/role-', {boards.LINK}) AS url, title,
    CASE WHEN ord % 4 = 3 THEN 'Acme Works' ELSE split_part('Hedra#Cocoon#Decagon', '#', CAST(1 + ord % 3 AS INT)) END AS company,
    CASE WHEN ord % 4 = 3 THEN 'Remote' ELSE location END AS location,
    CASE WHEN ord % 4 = 3 THEN concat('Acme Works — Remote team, we are building tools for many people ', title)
      ELSE concat(title, split_part('Hedra#Cocoon#Decagon', '#', CAST(1 + ord % 3 AS INT)), ' · ', location, ' · Posted on Feb 7, 2026 {SPAN}') END AS description
  FROM listings WHERE NOT (ord % 17 = 16 AND ord % 10 <> 0)""", "listings")
oracle("listings_fallback", f"""SELECT {PAGE},
    concat('https://board.test/', CASE WHEN ord % 10 < 2 THEN 'jobs/role-' WHEN ord % 10 < 6 THEN 'x/' ELSE 'y/' END, ord) AS url,
    CASE WHEN ord % 10 < 2 THEN title WHEN ord % 10 < 6 THEN concat('View Position ', ord) ELSE 'Head of Growth.Fintech' END AS title,
    CASE WHEN ord % 10 < 2 THEN 'Hedra' WHEN ord % 10 < 6 THEN concat('View Position ', ord, ' we are hiring in our office') ELSE '' END AS company,
    CASE WHEN ord % 10 < 2 THEN 'Remote' ELSE '' END AS location,
    CASE WHEN ord % 10 < 2 THEN concat(title, 'Hedra · Remote {SPAN}')
      WHEN ord % 10 < 6 THEN concat('View Position ', ord, ' we are hiring in our office — come and see it')
      ELSE 'Head of Growth.Fintech joins a small team that ships every single week' END AS description
  FROM listings WHERE ord % 10 < 4 OR (ord % 10 < 6 AND floor(ord / 10) % 2 = 1)
    OR (ord % 10 IN (6, 7) AND floor(ord / 10) % 2 = 0)""", "listings")
oracle("listings_company_card", f"""WITH r AS (SELECT ord, CAST(floor(ord / 5) AS BIGINT) AS half, concat(title, ' ', ord % 2) AS role,
      location FROM listings),
    c AS (SELECT half, concat('Firm ', half, ' Firm ', half, ' ', string_agg(concat(role,
      CASE WHEN location = '' THEN '' ELSE ' ' || location END), ' ' ORDER BY ord), ' $', 80 + half % 50, 'k - $', 90 + half % 50, 'K') AS body
      FROM r GROUP BY half)
  SELECT CAST(floor(ord / 10) AS BIGINT) AS page_id, role AS title, concat('Firm ', half) AS company,
    CASE WHEN location IN ('San Francisco', 'Atlanta, GA', 'Remote', 'Oakland') THEN location ELSE '' END AS location,
    substr(body, 1, 500) AS description, ((80 + half % 50) * 1000)::DOUBLE AS salary_min,
    ((90 + half % 50) * 1000)::DOUBLE AS salary_max, concat('https://board.test/jobs/', ord) AS url
  FROM r JOIN c USING (half) QUALIFY row_number() OVER (PARTITION BY half, role ORDER BY ord) = 1""", "listings")
oracle("listings_keyword_links", f"""SELECT {PAGE}, title, concat('Firm ', ord % 7) AS company,
    concat('https://board.test/r/', {boards.LINK}) AS url
  FROM listings WHERE floor(ord / 10) % 3 <> 0 AND {any_of('lower(title)', links.ROLE_WORDS)}
  QUALIFY row_number() OVER (PARTITION BY floor(ord / 10), {boards.LINK} ORDER BY ord) = 1""", "listings")


def api_salary(text: str, hourly) -> str:
    """Columns low and high for a salary text."""
    nums = (f"list_filter(list_transform(list_transform(regexp_extract_all({text}, '\\$?([\\d,]+(?:\\.\\d+)?)\\s*[kK]?', 1), "
            f"lambda a: TRY_CAST(replace(a, ',', '') AS DOUBLE)), lambda a: CASE WHEN a < 1000 THEN a * 1000 ELSE a END), "
            f"lambda a: a BETWEEN 20000 AND 500000)")
    ok = f"NOT {any_of(f'lower({text})', hourly)} AND len({nums}) > 0"
    return (f"CASE WHEN {ok} THEN list_min({nums}) END",
            f"CASE WHEN {ok} AND len({nums}) > 1 THEN list_max({nums}) END")


for _name, _hourly, _pref in (("search_api_listings", ("hour", "/hr"), "pref.test"),
                              ("search_api_listings_indeed", ("hour",), "b.test")):
    _low, _high = api_salary("pay", _hourly)
    oracle(_name, f"""WITH s AS (SELECT ord, search_location, response_json::JSON->'jobs_results'->0 AS j FROM search_api),
      t AS (SELECT ord, j->>'title' AS title, j->>'company_name' AS company,
        coalesce(j->>'location', search_location) AS location, j->>'share_link' AS share,
        (j->'apply_options'->>'$[*].link') AS options, j->'detected_extensions'->>'salary' AS pay,
        j->'detected_extensions'->>'posted_at' AS date_posted FROM s)
      SELECT ord, title, company, location, coalesce(
          list_filter(options, lambda x: contains(x, '{_pref}'))[1], list_filter(options, lambda x: x <> '')[1], share) AS url,
        {_low} AS salary_min, {_high} AS salary_max, date_posted
      FROM t WHERE title <> '' AND company <> ''""", "search_api")
oracle("choose_apply_url", """WITH u AS (SELECT ord, CASE WHEN ord % 2 = 0 THEN url ELSE '' END AS a,
    'https://pref.test/' || ord AS b, CASE WHEN ord % 10 = 0 THEN url END AS share FROM listings),
  c AS (SELECT ord, share, CASE WHEN ord % 5 = 0 THEN NULL WHEN contains(b, 'pref.test/1') THEN b
    WHEN a <> '' THEN a ELSE b END AS url FROM u)
  SELECT ord, coalesce(url, share, 'job') AS with_id, coalesce(url, share, '') AS without_id FROM c""", "listings")
oracle("union_sources", """WITH r AS (SELECT *, CASE source WHEN 'src4' THEN 0 WHEN 'src0' THEN 2 WHEN 'src3' THEN 3 ELSE 4 END AS rnk
    FROM listings WHERE source <> 'src2')
  SELECT source, rnk::BIGINT AS source_rank, row_number() OVER (ORDER BY rnk, ord) - 1 AS ord,
    CASE WHEN source <> 'src3' THEN url END AS url, 1::BIGINT AS errors FROM r""", "listings")

# Scalar functions


def scalar(name: str, view: str, **columns: str) -> None:
    cols = ", ".join(f"{sql} AS {c}" for c, sql in columns.items())
    oracle(name, f"SELECT ord, {cols} FROM {view}", view)


scalar("normalize_company", "listings", v=norm_company("company"))
scalar("normalize_title", "listings", v=norm_title("title"))
scalar("normalize_location", "listings", v=norm_location("location"),
       whole_words=norm_location("location", whole_words))
scalar("fuzzy_key", "listings", v=KEY)
scalar("completeness", "listings", points=f"CAST({COMPLETENESS} AS BIGINT)")


def num(text, pattern, group, factor):
    return f"TRY_CAST(regexp_extract({text}, '{pattern}', {group}) AS DOUBLE) * {factor}"


_SPAN = r"(\d+)[kK]\s*[-–]\s*(\d+)[kK]\s*(?:Annually|Annual|/yr)"
_ONE = r"(\d+)[kK]\s*(?:Annually|Annual|/yr)"
_HOUR = r"(\d+)\s*[-–]\s*(\d+)\s*Hourly"
scalar("salary_card", "cards", **{
    c: f"""CASE WHEN regexp_matches(card_text, '{_SPAN}') THEN {num('card_text', _SPAN, g, 1000)}
       WHEN regexp_matches(card_text, '{_ONE}') THEN {num('card_text', _ONE, 1, 1000)}
       WHEN regexp_matches(card_text, '{_HOUR}') THEN {num('card_text', _HOUR, g, 2080)} END"""
    for g, c in ((1, "salary_min"), (2, "salary_max"))})
_LI, _IN = api_salary("api_salary_text", ("hour", "/hr")), api_salary("api_salary_text", ("hour",))
scalar("salary_api", "cards", linkedin_min=_LI[0], linkedin_max=_LI[1], indeed_min=_IN[0], indeed_max=_IN[1])
_DOLLAR = r"\$(\d+)[kK]\s*[-–]\s*\$(\d+)[kK]"
scalar("salary_dollar_k", "cards", salary_min=num("dollar_text", _DOLLAR, 1, 1000),
       salary_max=num("dollar_text", _DOLLAR, 2, 1000))


def _place(n):
    cities, states = cards.CARD_PLACES[n]
    p = rf"(?i)((?:{cities})[,\s]*(?:{states})?[,\s]*(?:USA)?)"
    return f"WHEN regexp_matches(card_text, '{p}') THEN rtrim(trim(regexp_extract(card_text, '{p}', 1)), ',')"


scalar("location_card", "cards", v=f"""CASE {_place(0)} {_place(1)} {_place(2)}
  WHEN contains(card_text, 'Remote') THEN 'Remote' WHEN contains(card_text, 'Hybrid') THEN 'Hybrid' ELSE '' END""")
_RUN = rf"((?:[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_{WS}]+•[{WS}]*)+[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_{WS}]+)"
scalar("card_fields", "cards",
       level="CASE " + " ".join(f"WHEN contains(card_text, '{x}') THEN '{x}'" for x in cards.EXPERIENCE_LABELS) + " END",
       industry=f"nullif({strip(f'''regexp_extract(card_text, '{_RUN}', 1)''')}, '')",
       excerpt="substr(CASE WHEN length(context_text) > 80 AND NOT starts_with(context_text, 'Top Skills') THEN context_text ELSE card_text END, 1, 500)")
_LINE = r"(?s)^\s*(.+?)\s*\(([A-Z]\d+)\)\s*[•·]\s*(.+?)(?:\s*\(about\s+.+\))?\s*$"
_ONLY = r"^\s*(.+?)\s*\(([A-Z]\d+)\)\s*$"
scalar("company_batch", "cards", v=f"""CASE
  WHEN regexp_matches(batch_text, '{_LINE}') THEN concat(regexp_extract(batch_text, '{_LINE}', 1), ' (', regexp_extract(batch_text, '{_LINE}', 2), ')')
  WHEN regexp_matches(batch_text, '{_ONLY}') THEN concat(regexp_extract(batch_text, '{_ONLY}', 1), ' (', regexp_extract(batch_text, '{_ONLY}', 2), ')')
  WHEN trim(batch_text) <> '' THEN substr(trim(batch_text), 1, 80) ELSE 'Unknown' END""")
_TYPE = r"(?i)(?:fulltime|parttime|contract|internship)\s*([^·\n]*)"
_TYPED = f"trim(trim(regexp_extract(jobtype_text, '{_TYPE}', 1)), ',')"
scalar("location_jobtype", "cards", v=f"""CASE WHEN {_TYPED} <> '' THEN {_TYPED}
  WHEN contains(lower(jobtype_text), 'remote') THEN 'Remote' ELSE '' END""")
_GLUED = r"(?s)^(.*?[a-z)])([A-Z][a-zA-Z].*)$"
_PARTS = r"regexp_split_to_array(link_text, '\s*·\s*')"
_HEAD = f"trim({_PARTS}[1])"
_SEV = f"len({_PARTS}) >= 2"
scalar("split_link_text", "cards",
       title=f"CASE WHEN {_SEV} AND regexp_matches({_HEAD}, '{_GLUED}') THEN trim(regexp_extract({_HEAD}, '{_GLUED}', 1)) WHEN {_SEV} THEN {_HEAD} ELSE link_text END",
       company=f"CASE WHEN {_SEV} AND regexp_matches({_HEAD}, '{_GLUED}') THEN trim(regexp_extract({_HEAD}, '{_GLUED}', 2)) ELSE '' END",
       location=f"CASE WHEN {_SEV} AND NOT starts_with(trim({_PARTS}[2]), 'Posted') THEN trim(regexp_replace(trim({_PARTS}[2]), '\\s*Posted on.*$', '')) ELSE '' END")
_CTX = " ".join(f"WHEN regexp_matches(context_text, {q(p)}) THEN {strip(f'regexp_extract(context_text, {q(p)}, 1)')}" for p in cards.CONTEXT_PLACES)
scalar("context_fields", "cards",
       company=strip(r"regexp_extract(context_text, '^([A-Z][A-Za-z0-9\s&.-]+?)(?:\s*[·•|—\-])', 1)"),
       location=f"CASE {_CTX} ELSE '' END", description="substr(context_text, 1, 500)")

YEARS_TEXT = "lower(concat(coalesce(experience_required, ''), ' ', coalesce(description, '')))"
_ALL = ", ".join(f"regexp_extract_all({YEARS_TEXT}, {q(p)}, 1)" for p in filters.YEARS_PATTERNS)
YEARS = f"list_min(list_filter(list_transform(flatten([{_ALL}]), lambda y: TRY_CAST(y AS BIGINT)), lambda y: y <= 20))"
scalar("min_years", "listings", years=YEARS)

_T = strip("lower(date_posted)")


def ago(unit, seconds):
    n = rf"regexp_extract({_T}, '(\d+)\s*{unit}s?\s*ago', 1)"
    return f"WHEN {n} <> '' THEN {AS_OF} - TRY_CAST({n} AS BIGINT) * INTERVAL {seconds} SECOND"


RELATIVE = f"""CASE {ago('day', 86400)} {ago('week', 604800)} {ago('hour', 3600)}
  WHEN contains({_T}, 'today') OR contains({_T}, 'just posted') THEN {AS_OF}
  WHEN contains({_T}, 'yesterday') THEN {AS_OF} - INTERVAL 1 DAY {ago('month', 2592000)} END"""
POSTED = f"""coalesce(try_strptime({strip('date_posted')}, ['%Y-%m-%d', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M:%SZ',
  '%Y-%m-%dT%H:%M:%S.%f', '%m/%d/%Y', '%d/%m/%Y', '%B %d, %Y', '%b %d, %Y', '%Y-%m-%d %H:%M:%S']), {RELATIVE})"""
scalar("parse_posted_date", "listings", posted=f"CAST(epoch({POSTED}) AS BIGINT)")
scalar("parse_relative_date", "listings", posted=f"CAST(epoch({RELATIVE}) AS BIGINT)")


def fresh(ts: str) -> str:
    days = f"floor((epoch_us({AS_OF}) - epoch_us({ts})) / 86400000000.0)"
    return (f"CASE WHEN {days} IS NULL OR {days} < 0 THEN 'unknown' WHEN {days} <= 7 THEN 'green' "
            f"WHEN {days} <= 14 THEN 'yellow' WHEN {days} <= 21 THEN 'red' ELSE 'black' END")


def icon(expr: str) -> str:
    return f"CASE {expr} WHEN 'green' THEN '🟢' WHEN 'yellow' THEN '🟡' WHEN 'red' THEN '🔴' WHEN 'black' THEN '⚫' ELSE '❓' END"


scalar("freshness", "listings", by_posted=fresh(POSTED), by_scraped=fresh("date_scraped"))
scalar("freshness_icon", "listings", icon=icon(fresh("date_scraped")), other="'❓'")


def money(x):
    return f"concat('$', CAST(round_even({x} / 1000, 0) AS BIGINT), 'K')"


def pay(lo, hi):
    return (f"CASE WHEN coalesce({lo}, 0) <> 0 AND coalesce({hi}, 0) <> 0 THEN concat({money(lo)}, '–', {money(hi)}) "
            f"WHEN coalesce({lo}, 0) <> 0 THEN concat({money(lo)}, '+') "
            f"WHEN coalesce({hi}, 0) <> 0 THEN concat('Up to ', {money(hi)}) ELSE '—' END")


scalar("format_salary", "listings", v=pay("salary_min", "salary_max"), halves=pay("0.0", "(ord * 500)::DOUBLE"))


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence by the textbook table, one row per character."""
    return (f"list_reduce(string_split({a}, ''), lambda prev, ch: list_reduce(range(1, length({b}) + 1), "
            f"lambda acc, j: list_append(acc, CASE WHEN {b}[j] = ch THEN prev[j] + 1 ELSE greatest(prev[j + 1], acc[j]) END), "
            f"[0::BIGINT]), list_transform(range(0, length({b}) + 1), lambda i: 0::BIGINT))[length({b}) + 1]")


def alike(a: str, b: str, ratio: int) -> str:
    total = f"(length({a}) + length({b}))"
    return (f"CASE WHEN {a} = {b} THEN true WHEN length({a}) = 0 OR length({b}) = 0 THEN false "
            f"WHEN levenshtein({a}, {b}) * 100 <= {100 - ratio} * {total} "
            f"THEN {lcs(a, b)} * 200 >= {ratio} * {total} ELSE false END")


oracle("indel_ratio", f"""WITH t AS (SELECT ord, concat(title, ' ', company) AS a FROM listings),
  p AS (SELECT t.ord, t.a, n.a AS b FROM t JOIN t n ON n.ord = t.ord + 1)
  SELECT ord, round({lcs('a', 'b')} * 200.0 / (length(a) + length(b)), 6)::DOUBLE AS ratio FROM p""", "listings")

ENRICHED = """enriched AS (SELECT l.*, CASE WHEN c.company_name IS NULL THEN 'unknown' ELSE 'cache' END AS vc_source,
    CASE WHEN c.company_name IS NOT NULL THEN coalesce(c.backed_by_notable, false) END AS vc_backed,
    coalesce(from_json(c.investors::JSON, '["VARCHAR"]'), []) AS investors
  FROM listings l LEFT JOIN vc_cache c ON c.company_name = lower(trim(l.company)))"""
SHOWN = "array_to_string(investors[1:3], ', ')"
oracle("vc_display", f"""WITH {ENRICHED} SELECT ord, CASE WHEN len(investors) > 0 THEN {SHOWN} WHEN vc_backed THEN 'VC-backed'
    WHEN vc_backed = false THEN 'No notable VC' ELSE 'Unknown' END AS export,
  CASE WHEN vc_backed IS NULL THEN 'Unknown' WHEN len(investors) > 0 THEN {SHOWN}
    WHEN vc_backed THEN 'VC-backed (details unknown)' ELSE 'No notable VC' END AS prompt FROM enriched""", "listings", "vc_cache")
oracle("json_list", """SELECT ord, CASE ord % 5 WHEN 0 THEN 'a/b' WHEN 4 THEN title ELSE '' END AS joined,
  (CASE ord % 5 WHEN 0 THEN 2 WHEN 4 THEN 1 ELSE 0 END)::BIGINT AS n FROM listings""", "listings")

BODY = r"""stripped AS (SELECT listing_id, trim(response_text) AS t FROM responses),
  unfenced AS (SELECT listing_id, CASE WHEN starts_with(t, '```') THEN trim(regexp_replace(regexp_replace(t, '^[^\n]*\n', ''), '```$', '')) ELSE t END AS t FROM stripped),
  body AS (SELECT listing_id, CASE WHEN starts_with(t, 'json') THEN trim(substr(t, 5)) ELSE t END AS t FROM unfenced),
  doc AS (SELECT listing_id, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM body),
  answer AS (SELECT listing_id, j, TRY_CAST(j->>'score' AS DOUBLE) AS score,
    CASE WHEN TRY_CAST(j->>'score' AS DOUBLE) IS NOT NULL THEN j END AS ok,
    (ok->>'$.detected_vc_investors[*]') AS detected, (ok->>'$.matching_skills[*]') AS skills,
    (ok->>'$.missing_requirements[*]') AS missing FROM doc)"""


def listed(j: str, field: str) -> str:
    return f"CASE WHEN ({j}->'{field}') IS NOT NULL THEN array_to_string({j}->>'$.{field}[*]', ',') END"


oracle("parse_llm_response", f"""WITH {BODY} SELECT listing_id, score, ok->>'reasoning' AS reasoning,
  {listed('ok', 'matching_skills')} AS skills, {listed('ok', 'detected_vc_investors')} AS detected FROM answer""", "responses")
oracle("build_prompt", f"""WITH {ENRICHED} SELECT ord AS listing_id, concat('Role ', title, ' at ', company, ' in ',
    CASE WHEN coalesce(location, '') = '' THEN 'Not specified' ELSE location END, ', ',
    CASE WHEN coalesce(date_posted, '') = '' THEN 'Not specified' ELSE date_posted END, '. ',
    CASE WHEN vc_backed IS NULL THEN 'Unknown' WHEN len(investors) > 0 THEN {SHOWN}
      WHEN vc_backed THEN 'VC-backed (details unknown)' ELSE 'No notable VC' END, '. ',
    substr(CASE WHEN coalesce(description, '') = '' THEN 'No description available' ELSE description END, 1, 3000)) AS prompt
  FROM enriched""", "listings", "vc_cache")
FINAL = "CASE WHEN coalesce(vc_backed, false) AND score < 10 THEN least(10.0, score + 0.5) ELSE score END::DOUBLE"
oracle("final_score", f"SELECT id, {FINAL} AS v FROM scored", "scored")
oracle("seniority_cap", r"""WITH t AS (SELECT ord, replace(lower(split_part('#SVP #Director, #Head of #Senior Manager ', '#', CAST(1 + ord % 5 AS INT)) || title), 'chief of staff', '') AS t FROM listings)
  SELECT ord, CAST(CASE WHEN regexp_matches(t, '\b(senior manager|senior director|svp|evp|c-suite)\b') THEN 3
    WHEN regexp_matches(t, '\b(vp|vice president|director|head of|principal|staff)\b') THEN 4
    WHEN regexp_matches(t, '\bsenior\b') THEN 6 END AS BIGINT) AS cap FROM t""", "listings")
oracle("score_band", """SELECT id, CASE WHEN score >= 9 THEN 'perfect' WHEN score >= 6 THEN 'good'
  WHEN score >= 3 THEN 'weak' ELSE 'none' END AS band FROM scored""", "scored")
_NAMES = "[" + ", ".join(q(n) for n in P.NOTABLE_INVESTORS) + "]"
oracle("notable_investors", f"""WITH i AS (SELECT ord, lower(CASE WHEN ord % 2 = 1 THEN 'Linear ' || company
    WHEN ord % 4 = 0 THEN 'Accel Partners' ELSE 'Unknown Fund' END) AS i FROM listings)
  SELECT ord, len(list_filter({_NAMES}, lambda n: contains(i, n) OR contains(n, i))) > 0 AS notable FROM i""", "listings")
oracle("vc_flag_code", "SELECT id, CAST(CASE WHEN vc_backed THEN 1 WHEN vc_backed = false THEN 0 END AS BIGINT) AS code FROM scored", "scored")
_GENERIC = rf"/?({'|'.join(p[1:] for p in health.GENERIC_PATHS)})/?$"
oracle("generic_redirect", rf"""WITH u AS (SELECT page_id, lower(url || split_part('/careers#/JOBS/#/jobs/1#/404#', '#', CAST(1 + page_id % 5 AS INT))) AS u FROM pages)
  SELECT page_id, {' OR '.join(f"ends_with(u, '{p}') OR ends_with(u, '{p}/')" for p in health.GENERIC_PATHS)} AS generic FROM u""")
_W = "list_filter(string_split(title, ' '), lambda w: w <> '&')"
_SOME = f"CASE WHEN ord % 3 = 0 THEN [] ELSE list_concat({_W}, {_W}) END"
oracle("display_lists", f"""WITH s AS (SELECT ord, {_SOME} AS s FROM listings)
  SELECT ord, array_to_string(s, ', ') AS "every", CASE WHEN len(s) > 0 THEN array_to_string(s[1:4], ', ') ELSE '—' END AS four,
    CASE WHEN len(s) > 0 THEN array_to_string(s[1:3], ', ') ELSE '—' END AS three FROM s""", "listings")

# Filters

LOC_OK = f"""(contains({low('location')}, 'remote') OR contains({low('description')}, 'remote') OR contains({low('title')}, 'remote')
  OR {any_of(f"concat({low('location')}, ' ', {low('description')})", P.LOCATION_ALIASES)})"""
EXP_OK = f"coalesce({YEARS} <= 3, true)"
PAY_OK = "coalesce(coalesce(salary_max, salary_min) >= 70000, true)"
IND_OK = f"""NOT ({any_of(low('company_industry'), P.EXCLUDED_INDUSTRIES)} OR {any_of(low('title'), P.INDUSTRY_TITLE_KEYWORDS)}
  OR {any_of(low('company'), P.INDUSTRY_COMPANY_KEYWORDS)} OR {any_of(low('description'), P.INDUSTRY_DESCRIPTION_PHRASES)})"""
REASON = f"CASE WHEN NOT {LOC_OK} THEN 'location' WHEN NOT {EXP_OK} THEN 'experience' WHEN NOT {PAY_OK} THEN 'salary' WHEN NOT ({IND_OK}) THEN 'industry' END"
_TEXT = f"concat({low('title')}, ' ', {low('description')})"
CATEGORIES = f"""({any_of(low('title'), P.TITLE_KEYWORDS)}::BIGINT + {any_of(_TEXT, P.SIGNAL_TOOLS)}::BIGINT
  + {any_of(_TEXT, P.SIGNAL_THEMES + P.SIGNAL_RESPONSIBILITIES)}::BIGINT)"""
scalar("filter_location", "listings", ok=LOC_OK)
scalar("filter_experience", "listings", ok=EXP_OK)
scalar("filter_salary", "listings", ok=PAY_OK)
scalar("filter_industry", "listings", ok=IND_OK)
scalar("keyword_categories", "listings", n=CATEGORIES)
scalar("hard_filters", "listings", reject_reason=REASON)
oracle("keyword_prefilter", f"SELECT ord, title FROM listings WHERE {CATEGORIES} >= 1", "listings")
EXPIRED = f"""CASE WHEN status IN (404, 410, 451) THEN true
  WHEN status IN (301, 302, 303, 307, 308) THEN regexp_matches(lower(coalesce(location, '')), '(/careers|/jobs|/open-positions|/job-openings|/404)/?$')
  WHEN status = 200 THEN {any_of(low('body'), health.EXPIRED_PHRASES)} ELSE false END"""
oracle("expired_verdict", f"SELECT page_id, {EXPIRED} AS expired FROM crawl_response", "crawl_response")
oracle("dead_urls", f"SELECT DISTINCT url FROM crawl_response WHERE {EXPIRED}", "crawl_response")

# Joins and stores

oracle("anti_seen_url", """SELECT ord, url FROM listings WHERE ord % 3 <> 0
  AND url NOT IN (SELECT url FROM listings WHERE ord % 3 = 0)""", "listings")
oracle("enrich_investors", f"""WITH {ENRICHED} SELECT ord, array_to_string(investors, ',') AS investors, vc_backed, vc_source
  FROM enriched""", "listings", "vc_cache")
NOTABLE = f"len(list_filter(detected, lambda d: len(list_filter({_NAMES}, lambda n: contains(lower(d), n) OR contains(n, lower(d)))) > 0)) > 0"
MERGED = f"""merged AS (SELECT e.* EXCLUDE (vc_source, vc_backed, investors), a.score AS raw_score, a.ok AS ok, a.skills, a.missing,
    vc_source = 'unknown' AND coalesce(len(a.detected), 0) > 0 AS use,
    CASE WHEN use THEN 'detected' ELSE e.vc_source END AS vc_source,
    CASE WHEN use THEN {NOTABLE} ELSE e.vc_backed END AS vc_backed,
    CASE WHEN use THEN a.detected ELSE e.investors END AS investors
  FROM enriched e LEFT JOIN answer a ON a.listing_id = e.ord)"""
SCORED_CTE = f"""{ENRICHED}, {BODY}, {MERGED},
  results AS (SELECT m.*, CASE WHEN coalesce(vc_backed, false) AND raw_score < 10 THEN least(10.0, raw_score + 0.5) ELSE raw_score END::DOUBLE AS score,
    coalesce(ok->>'reasoning', '') AS reasoning, {fresh(POSTED)} AS freshness, ord % 4 = 0 AS is_repost
  FROM merged m WHERE raw_score IS NOT NULL)"""
RESULT_VIEWS = ("listings", "responses", "vc_cache")
oracle("merge_detected_investors", f"""WITH {ENRICHED}, {BODY}, {MERGED}
  SELECT ord, array_to_string(investors, ',') AS investors, vc_backed, vc_source FROM merged""", *RESULT_VIEWS)
oracle("score_listings", f"""WITH {SCORED_CTE} SELECT ord, score, reasoning, coalesce(array_to_string(skills, ','), '') AS skills, vc_backed,
  vc_source, freshness FROM results""", *RESULT_VIEWS)
oracle("resolve_listing_id", """WITH f AS (SELECT url, min(ord) AS ord FROM listings GROUP BY url)
  SELECT l.ord, f.ord + 1 AS listing_id, f.ord IS NOT NULL AS listing_found
  FROM listings l LEFT JOIN f ON f.url = l.url AND f.ord % 3 = 0""", "listings")
UNSYNCED = """SELECT s.id, s.listing_id, s.score, l.title, l.url FROM scored s JOIN listings l ON l.ord + 1 = s.listing_id
  WHERE NOT s.synced ORDER BY s.score DESC, s.id"""
oracle("unsynced_scored", UNSYNCED, "scored")
GONE = "listing_id IN (SELECT ord + 1 FROM listings WHERE url IN (SELECT url FROM listings WHERE ord % 4 = 0))"
oracle("expire_by_url", f"SELECT id, 7::BIGINT AS seq, 'expired' AS status, false AS url_alive FROM scored WHERE {GONE}", "scored")
oracle("health_queue", """SELECT l.url, s.listing_id, s.id AS scored_id FROM scored s JOIN listings l ON l.ord + 1 = s.listing_id
  WHERE s.status = 'new' AND s.url_alive ORDER BY l.date_scraped NULLS FIRST, s.id LIMIT 50""", "scored")
oracle("insert_listings", """WITH b AS (SELECT ord, CASE WHEN ord % 13 <> 0 THEN url END AS url, CASE WHEN ord % 11 <> 0 THEN title END AS title
    FROM listings WHERE ord % 3 <> 0),
  v AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord) AS n FROM b WHERE title IS NOT NULL)
  SELECT ord, url, title FROM v WHERE url IS NULL OR (n = 1 AND url NOT IN (SELECT url FROM listings WHERE ord % 3 = 0))""", "listings")
oracle("assign_ids", """WITH v AS (SELECT ord, url, row_number() OVER (PARTITION BY url ORDER BY ord) AS n FROM listings WHERE ord % 3 <> 0)
  SELECT ord, (SELECT max(ord) + 1 FROM listings WHERE ord % 3 = 0) + row_number() OVER (ORDER BY ord) AS id
  FROM v WHERE n = 1 AND url NOT IN (SELECT url FROM listings WHERE ord % 3 = 0)""", "listings")
oracle("append_scored", """SELECT (SELECT max(id) FROM scored) + row_number() OVER (ORDER BY id) AS id, id AS was, listing_id, score
  FROM scored WHERE score >= 5""", "scored")
oracle("upsert_cache", """WITH u AS (SELECT lower(trim(company)) AS company_name, concat('["Fund ', ord, '"]') AS investors,
    ord % 8 = 0 AS backed_by_notable, ord FROM listings WHERE ord % 4 = 0),
  n AS (SELECT * EXCLUDE (ord) FROM u QUALIFY row_number() OVER (PARTITION BY company_name ORDER BY ord DESC) = 1)
  SELECT * FROM n UNION ALL SELECT * FROM vc_cache WHERE company_name NOT IN (SELECT company_name FROM n)""", "listings", "vc_cache")
oracle("apply_changes", f"""SELECT id, CASE WHEN {GONE} THEN 'expired' WHEN id % 5 = 1 THEN 'applied' ELSE status END AS status,
  synced OR score > 4 AS synced, CASE WHEN {GONE} THEN false ELSE url_alive END AS url_alive FROM scored""", "scored")
oracle("latest_state", """SELECT o_custkey AS id,
  arg_max(o_orderstatus, o_orderkey) FILTER (o_orderkey % 3 <> 0) AS status,
  arg_max(o_totalprice > 100000, o_orderkey) FILTER (o_orderkey % 2 = 0) AS synced,
  arg_max(o_orderpriority < '3', o_orderkey) AS url_alive FROM orders GROUP BY o_custkey""")
oracle("key_index", f"SELECT {KEY} AS fuzzy_key, max(ord) + 1 AS id FROM listings GROUP BY 1", "listings")
RUNS = f"""SELECT CAST(CAST(date_scraped AS DATE) AS VARCHAR) AS run_date, source, count(*) AS listings_scraped,
  count(*) FILTER (({REASON}) IS NULL) AS listings_passed_filter, min(ord) AS id FROM listings GROUP BY 1, 2"""
oracle("run_log", RUNS, "listings")
oracle("last_run", RUNS + " ORDER BY id DESC LIMIT 1", "listings")


def first(items: str, n: int | None, empty: str) -> str:
    shown = items if n is None else f"{items}[1:{n}]"
    return f"CASE WHEN coalesce(len({items}), 0) > 0 THEN array_to_string({shown}, ', ') ELSE '{empty}' END"


oracle("export_rows", f"""WITH {BODY} SELECT s.id, concat(s.score, '/10') AS score_text, {icon('s.freshness')} AS freshness_icon,
    coalesce(l.title, '') AS title, coalesce(l.company, '') AS company, coalesce(l.location, '') AS location,
    {pay('l.salary_min', 'l.salary_max')} AS salary,
    CASE WHEN coalesce(len(a.detected), 0) > 0 THEN array_to_string(a.detected[1:3], ', ') WHEN s.vc_backed THEN 'VC-backed'
      WHEN s.vc_backed = false THEN 'No notable VC' ELSE 'Unknown' END AS notable_vcs,
    CASE WHEN s.is_repost THEN '{export.REPOST_MARK}' ELSE '' END AS repost, l.source, {first('a.skills', None, '')} AS key_matches,
    {first('a.missing', None, '')} AS missing, l.url AS link, strftime(l.date_scraped, '%Y-%m-%dT%H:%M:%S') AS date_found,
    coalesce(l.date_posted, '') AS date_posted, s.status, coalesce(a.ok->>'recommendation', '') AS recommendation
  FROM scored s JOIN listings l ON l.ord + 1 = s.listing_id LEFT JOIN answer a ON a.listing_id + 1 = s.listing_id
  WHERE NOT s.synced""", "listings", "responses", "scored")

oracle("published_exports", """SELECT s.id, coalesce(l.title, '') AS title, l.url AS link, CASE WHEN s.id % 4 = 3 THEN 1 ELSE 2 END::BIGINT AS run,
    s.id % 4 = 1 AS newest FROM scored s JOIN listings l ON l.ord + 1 = s.listing_id
  WHERE NOT s.synced AND s.id % 2 = 1""", "listings", "scored")

# Aggregations, ranking, digest

oracle("reject_stats", f"""WITH t AS (SELECT coalesce({REASON}, 'passed') AS reason FROM listings),
  r AS (SELECT unnest(['location', 'experience', 'salary', 'industry', 'passed']) AS reason)
  SELECT reason, count(t.reason) AS n FROM r LEFT JOIN t USING (reason) GROUP BY reason""", "listings")
oracle("freshness_dist", f"SELECT {fresh(POSTED)} AS freshness, count(*) AS n FROM listings GROUP BY 1", "listings")
oracle("source_counts", "SELECT source, count(*) AS n FROM listings GROUP BY source", "listings")
oracle("funnel", f"""WITH t AS (SELECT ({REASON}) IS NULL AS passed, {CATEGORIES} >= 1 AS words, ord % 7 = 0 AS rep FROM listings)
  SELECT 0::BIGINT AS step_no, 'hard_filters' AS step, count(*) AS rows_in, count(*) FILTER (passed) AS rows_out,
    count(*) FILTER (NOT passed) AS dropped, count(*) FILTER (passed AND rep) AS reposts FROM t
  UNION ALL SELECT 1, 'keyword_prefilter', count(*) FILTER (passed), count(*) FILTER (passed AND words),
    count(*) FILTER (passed AND NOT words), count(*) FILTER (passed AND words AND rep) FROM t""", "listings")
oracle("enrichment_stats", f"""WITH {ENRICHED} SELECT count(*) AS listings, count(*) FILTER (vc_source = 'cache') AS cache_hits,
  0::BIGINT AS looked_up, count(*) FILTER (vc_source = 'unknown') AS "unknown" FROM enriched""", "listings", "vc_cache")
oracle("scoring_stats", f"""WITH {BODY} SELECT count(*) AS listings, count(a.score) AS scored, count(*) - count(a.score) AS errors
  FROM listings l LEFT JOIN answer a ON a.listing_id = l.ord""", "listings", "responses")
oracle("rank_by_score", f"""WITH {SCORED_CTE} SELECT ord, title, score FROM results ORDER BY score DESC, ord""", *RESULT_VIEWS)
oracle("digest_top", f"""WITH {SCORED_CTE} SELECT ord, score, title, concat(company, ' · ', CASE WHEN location = '' THEN 'Location N/A' ELSE location END, ' ',
    {icon('freshness')}, CASE WHEN is_repost THEN ' {export.REPOST_MARK}' ELSE '' END) AS line,
    CASE WHEN len(investors) > 0 THEN concat('Backed by: ', {SHOWN}) ELSE '' END AS backed,
    {first('skills', 4, '—')} AS matches, {first('missing', 3, '—')} AS gaps
  FROM results ORDER BY score DESC, ord LIMIT 5""", *RESULT_VIEWS)
oracle("digest_summary", f"""WITH {SCORED_CTE} SELECT count(*) AS matches, max(score) AS top_score,
  greatest(count(*) - 5, 0) AS more FROM results""", *RESULT_VIEWS)
oracle("digest_subject", f"""WITH {SCORED_CTE} SELECT CASE WHEN count(*) > 0
  THEN concat('🎯 ', count(*), ' New Job Matches (Top: ', max(score), '/10)') ELSE {q(export.SUBJECT_CLEAR)} END AS subject FROM results""", *RESULT_VIEWS)

# Streaming: the end state equals the batch result

SLICED = """sliced AS (SELECT *, floor(ord * 4 / ((SELECT max(ord) FROM listings) + 1)) AS run FROM listings),
  kept AS (SELECT *, row_number() OVER (ORDER BY ord) AS id FROM (SELECT * FROM sliced
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord) = 1))"""
oracle("stream_ingest", f"WITH {SLICED} SELECT id, ord, url FROM kept", "listings")
oracle("stream_reposts", f"""WITH {SLICED}, named AS (SELECT *, concat({norm_company('company')}, '|', {norm_title('title')}) AS name FROM kept)
  SELECT k.ord, min(o.id) IS NOT NULL AS is_repost, min(o.id) AS original_listing_id FROM named k
  LEFT JOIN named o ON o.name = k.name AND o.run < k.run AND o.date_scraped >= {AS_OF} - INTERVAL 30 DAY GROUP BY k.ord""", "listings")
oracle("stream_dedup_url", "SELECT DISTINCT url FROM listings", "listings")
oracle("stream_daily_counts", """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")

# Similarity and clustering: one leader per step, taken in arrival order


def clusters(source: str) -> str:
    """CTEs keys(ord, key) and clusters(ord, key, leader_ord) over keyed rows (ord, key)."""
    return f"""keys AS MATERIALIZED (SELECT min(ord) AS ord, key FROM {source} GROUP BY key),
  steps AS (SELECT ord, key, -1::BIGINT AS leader_ord, false AS taken FROM keys
    UNION ALL SELECT ord, key, leader_ord, ord = leader_ord OR {alike('key', 'leader_key', 85)} FROM (
      SELECT ord, key, min(ord) OVER () AS leader_ord, first_value(key) OVER (ORDER BY ord) AS leader_key
      FROM steps WHERE NOT taken)),
  clusters AS MATERIALIZED (SELECT ord, key, leader_ord FROM steps WHERE taken)"""


KEYED = f"keyed AS MATERIALIZED (SELECT *, {KEY} AS key FROM listings)"


def survivors(source: str) -> str:
    """CTE survivors(ord, leader_ord) for rows with key and points joined to clusters."""
    return f"""members AS (SELECT r.ord, c.leader_ord, c.ord = c.leader_ord AS own, {COMPLETENESS} AS points
    FROM {source} r JOIN clusters c ON c.key = r.key),
  walked AS (SELECT *, max(CASE WHEN own THEN points END) OVER (PARTITION BY leader_ord ORDER BY ord
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM members),
  survivors AS MATERIALIZED (SELECT leader_ord, coalesce(min(ord) FILTER (NOT own AND points > top),
    arg_max(ord, points::BIGINT * 1000000000000 - ord) FILTER (own)) AS ord FROM walked GROUP BY leader_ord)"""


oracle("fuzzy_clusters", f"WITH RECURSIVE {KEYED}, {clusters('keyed')} SELECT key, ord, leader_ord FROM clusters", "listings")
oracle("fuzzy_pairs", f"""WITH RECURSIVE {KEYED}, {clusters('keyed')}, close AS (SELECT k.ord, k.key AS a, l.ord AS leader_ord, l.key AS b
    FROM keys k JOIN clusters l ON l.ord = l.leader_ord AND l.ord < k.ord)
  SELECT ord, leader_ord FROM close WHERE {alike('a', 'b', 85)}""", "listings")
oracle("dedup_batch", f"WITH RECURSIVE {KEYED}, {clusters('keyed')}, {survivors('keyed')} SELECT ord, leader_ord FROM survivors", "listings")


def seen_keys(batch: str, stored: str) -> str:
    return f"""met AS (SELECT b.key AS a, s.key AS b FROM (SELECT DISTINCT key FROM {batch}) b, (SELECT DISTINCT key FROM {stored}) s),
  seen AS MATERIALIZED (SELECT DISTINCT a AS key FROM met WHERE {alike('a', 'b', 85)})"""


def reposts(batch: str, stored: str) -> str:
    """CTE originals(company, title, id): smallest recent stored id alike in both."""
    return f"""ours AS (SELECT DISTINCT split_part(key, '|', 1) AS c1, split_part(key, '|', 2) AS t1 FROM {batch}),
  theirs AS (SELECT split_part(key, '|', 1) AS c2, split_part(key, '|', 2) AS t2, min(ord) + 1 AS id FROM {stored}
    WHERE date_scraped >= {AS_OF} - INTERVAL 30 DAY GROUP BY 1, 2),
  firms AS MATERIALIZED (SELECT c1, c2 FROM (SELECT DISTINCT c1 FROM ours), (SELECT DISTINCT c2 FROM theirs) WHERE {alike('c1', 'c2', 90)}),
  names AS MATERIALIZED (SELECT t1, t2 FROM (SELECT DISTINCT t1 FROM ours), (SELECT DISTINCT t2 FROM theirs) WHERE {alike('t1', 't2', 85)}),
  originals AS MATERIALIZED (SELECT c1, t1, min(id) AS id FROM ours JOIN firms USING (c1) JOIN names USING (t1) JOIN theirs USING (c2, t2) GROUP BY 1, 2)"""


SPLIT = f"""{KEYED}, store AS (SELECT * FROM keyed WHERE ord % 3 = 0), batch AS (SELECT * FROM keyed WHERE ord % 3 <> 0)"""
oracle("anti_seen_fuzzy", f"""WITH {SPLIT}, {seen_keys('batch', 'store')}
  SELECT ord FROM batch WHERE key NOT IN (SELECT key FROM seen)""", "listings")
oracle("detect_reposts", f"""WITH {SPLIT}, {reposts('batch', 'store')}
  SELECT b.ord, o.id IS NOT NULL AS is_repost, o.id AS original_listing_id FROM batch b
  LEFT JOIN originals o ON o.c1 = split_part(b.key, '|', 1) AND o.t1 = split_part(b.key, '|', 2)""", "listings")

oracle("stream_fuzzy_reposts", f"""WITH {SLICED}, named AS MATERIALIZED (SELECT k.*, split_part({KEY}, '|', 1) AS c, split_part({KEY}, '|', 2) AS t FROM kept k),
  firms AS MATERIALIZED (SELECT c1, c2 FROM (SELECT DISTINCT c AS c1 FROM named), (SELECT DISTINCT c AS c2 FROM named) WHERE {alike('c1', 'c2', 90)}),
  names AS MATERIALIZED (SELECT t1, t2 FROM (SELECT DISTINCT t AS t1 FROM named), (SELECT DISTINCT t AS t2 FROM named) WHERE {alike('t1', 't2', 85)}),
  originals AS (SELECT n.ord, min(o.id) AS id FROM named n JOIN firms f ON f.c1 = n.c JOIN names m ON m.t1 = n.t
    JOIN named o ON o.c = f.c2 AND o.t = m.t2 AND o.run < n.run AND o.date_scraped >= {AS_OF} - INTERVAL 30 DAY GROUP BY n.ord)
  SELECT n.ord, o.id IS NOT NULL AS is_repost, o.id AS original_listing_id FROM named n LEFT JOIN originals o ON o.ord = n.ord""", "listings")

RUN = f"""{KEYED}, store AS (SELECT * FROM keyed WHERE ord % 9 = 0), batch AS MATERIALIZED (SELECT * FROM keyed WHERE ord % 9 <> 0),
  {clusters('batch')}, {survivors('batch')},
  uniq AS MATERIALIZED (SELECT b.*, s.leader_ord FROM batch b JOIN survivors s ON s.ord = b.ord),
  {seen_keys('uniq', 'store')},
  fresh AS MATERIALIZED (SELECT * FROM uniq WHERE url NOT IN (SELECT url FROM store) AND key NOT IN (SELECT key FROM seen)),
  {reposts('fresh', 'store')},
  flagged AS MATERIALIZED (SELECT f.*, o.id IS NOT NULL AS is_repost, o.id AS original_listing_id, {REASON} AS reject_reason, {CATEGORIES} AS words
    FROM fresh f LEFT JOIN originals o ON o.c1 = split_part(f.key, '|', 1) AND o.t1 = split_part(f.key, '|', 2)),
  {ENRICHED.replace('FROM listings l', 'FROM flagged l')}, {BODY}, {MERGED},
  results AS (SELECT m.*, CASE WHEN coalesce(vc_backed, false) AND raw_score < 10 THEN least(10.0, raw_score + 0.5) ELSE raw_score END::DOUBLE AS score,
    {fresh(POSTED)} AS freshness FROM merged m WHERE raw_score IS NOT NULL AND reject_reason IS NULL AND words >= 1)"""
oracle("run_scored", f"""WITH RECURSIVE {RUN} SELECT ord, title, company, score, freshness, vc_source, is_repost, original_listing_id, leader_ord
  FROM results""", *RESULT_VIEWS)
oracle("run_funnel", f"""WITH RECURSIVE {RUN}, c AS (SELECT (SELECT count(*) FROM batch) AS n0, (SELECT count(*) FROM uniq) AS n1,
    (SELECT count(*) FROM flagged) AS n2, (SELECT count(*) FROM flagged WHERE reject_reason IS NULL) AS n3,
    (SELECT count(*) FROM flagged WHERE reject_reason IS NULL AND words >= 1) AS n4, (SELECT count(*) FROM results) AS n5,
    (SELECT count(*) FROM flagged WHERE is_repost) AS r2, (SELECT count(*) FROM flagged WHERE is_repost AND reject_reason IS NULL) AS r3,
    (SELECT count(*) FROM flagged WHERE is_repost AND reject_reason IS NULL AND words >= 1) AS r4,
    (SELECT count(*) FROM results WHERE is_repost) AS r5)
  SELECT 0::BIGINT AS step_no, 'deduplication' AS step, n0 AS rows_in, n1 AS rows_out, n0 - n1 AS dropped, r2 AS reposts FROM c
  UNION ALL SELECT 1, 'already_seen', n1, n2, n1 - n2, r2 FROM c UNION ALL SELECT 2, 'hard_filters', n2, n3, n2 - n3, r3 FROM c
  UNION ALL SELECT 3, 'keyword_prefilter', n3, n4, n3 - n4, r4 FROM c UNION ALL SELECT 4, 'scoring', n4, n5, n4 - n5, r5 FROM c""", *RESULT_VIEWS)

# What a run leaves behind: ids of inserted listings and new scores, expiry, export, digest and log

END = f"""{RUN}, held AS (SELECT ord + 1 AS id, url, title, company, location, salary_min, salary_max, source, date_posted, date_scraped FROM store),
  entered AS (SELECT (SELECT max(id) FROM held) + row_number() OVER (ORDER BY ord) AS id, * FROM (SELECT * FROM flagged
    WHERE title IS NOT NULL AND company IS NOT NULL AND url NOT IN (SELECT url FROM held)
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord) = 1)),
  shelf AS (SELECT * FROM held UNION ALL SELECT id, url, title, company, location, salary_min, salary_max, source, date_posted, date_scraped FROM entered),
  logged AS MATERIALIZED (SELECT row_number() OVER (ORDER BY r.ord) AS id, s.listing_id, r.* EXCLUDE (id)
    FROM (SELECT *, 0 AS id FROM results) r JOIN (SELECT url, min(id) AS listing_id FROM shelf GROUP BY url) s ON s.url = r.url),
  queue AS (SELECT s.url FROM logged l JOIN shelf s ON s.id = l.listing_id ORDER BY s.date_scraped NULLS FIRST, l.id LIMIT 50),
  gone AS (SELECT id FROM shelf WHERE url IN (SELECT url FROM queue) AND url IN (
    SELECT concat('https://ex.test/job/', page_id) FROM crawl_response WHERE {EXPIRED})),
  expired AS MATERIALIZED (SELECT id FROM logged WHERE listing_id IN (SELECT id FROM gone))"""
END_VIEWS = (*RESULT_VIEWS, "crawl_response")
oracle("run_changes", f"""WITH RECURSIVE {END} SELECT id, 1::BIGINT AS seq, 'new' AS status, false AS synced, true AS url_alive FROM logged
  UNION ALL SELECT id, 2, 'expired', NULL, false FROM expired UNION ALL SELECT id, 3, NULL, true, NULL FROM logged""", *END_VIEWS)
oracle("run_entry", f"""WITH RECURSIVE {END} SELECT CAST({AS_OF} AS VARCHAR) AS run_date, 'all' AS source, (SELECT count(*) FROM batch) AS listings_scraped,
  (SELECT count(*) FROM flagged) AS listings_new, (SELECT count(*) FROM flagged WHERE reject_reason IS NULL AND words >= 1) AS listings_passed_filter,
  (SELECT count(*) FROM results) AS listings_scored, (SELECT count(*) FROM expired) AS listings_expired, CAST(NULL AS DOUBLE) AS duration_seconds""", *END_VIEWS)
oracle("run_export", f"""WITH RECURSIVE {END} SELECT l.id, concat(l.score, '/10') AS score_text, {icon('l.freshness')} AS freshness_icon,
    coalesce(s.title, '') AS title, coalesce(s.company, '') AS company, coalesce(s.location, '') AS location,
    {pay('s.salary_min', 's.salary_max')} AS salary,
    CASE WHEN coalesce(len(l.investors), 0) > 0 THEN array_to_string(l.investors[1:3], ', ') WHEN l.vc_backed THEN 'VC-backed'
      WHEN l.vc_backed = false THEN 'No notable VC' ELSE 'Unknown' END AS notable_vcs,
    CASE WHEN l.is_repost THEN '{export.REPOST_MARK}' ELSE '' END AS repost, s.source, {first('l.skills', None, '')} AS key_matches,
    {first('l.missing', None, '')} AS missing, s.url AS link, coalesce(strftime(s.date_scraped, '%Y-%m-%dT%H:%M:%S'), '') AS date_found,
    coalesce(s.date_posted, '') AS date_posted, 'new' AS status, coalesce(l.ok->>'recommendation', '') AS recommendation
  FROM logged l JOIN shelf s ON s.id = l.listing_id""", *END_VIEWS)
oracle("run_digest", f"""WITH RECURSIVE {RUN} SELECT ord, score, title, concat(company, ' · ', CASE WHEN coalesce(location, '') = '' THEN 'Location N/A' ELSE location END, ' ',
    {icon('freshness')}, CASE WHEN is_repost THEN ' {export.REPOST_MARK}' ELSE '' END) AS line,
    CASE WHEN len(investors) > 0 THEN concat('Backed by: ', {SHOWN}) ELSE '' END AS backed,
    {first('skills', 4, '—')} AS matches, {first('missing', 3, '—')} AS gaps, url
  FROM results ORDER BY score DESC, ord LIMIT 5""", *RESULT_VIEWS)
