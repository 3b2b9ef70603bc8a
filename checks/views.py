"""Listing-shaped views over the given tables, in SQL that Spark and DuckDB both accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"

LISTINGS = """
SELECT p.p_partkey AS ord,
  concat('src', CAST(p.p_partkey % 5 AS STRING)) AS source,
  concat('https://ex.test/job/', CAST(CASE WHEN p.p_partkey % 17 = 16 THEN p.p_partkey - 1 ELSE p.p_partkey END AS STRING)) AS url,
  split_part('Operations Analyst|Chief of Staff|Senior Operations Analyst|Strategy & Operations Lead|Nurse Coordinator|VP Finance|Data Engineer|Growth Associate', '|', CAST(1 + p.p_size % 8 AS INT)) AS title,
  concat(p.p_name, split_part(' Inc.| LLC|, Labs| Technologies, Inc.||-Co', '|', CAST(1 + p.p_partkey % 6 AS INT))) AS company,
  split_part('Santa Monica, CA|San Francisco|Brooklyn, NY|Atlanta, GA|Remote|Berlin||Oakland', '|', CAST(1 + (p.p_partkey * 7) % 8 AS INT)) AS location,
  CASE WHEN d.doc_id IS NULL THEN NULL ELSE concat(d.text, split_part(' 5+ years of experience| 2-4 years experience| minimum 7 yrs|| requires 1 year| 10 years in ops. HIPAA', '|', CAST(1 + p.p_partkey % 6 AS INT))) END AS description,
  CASE WHEN p.p_partkey % 4 = 0 THEN NULL ELSE CAST(floor(o.o_totalprice / 4) AS DOUBLE) END AS salary_min,
  CASE WHEN p.p_partkey % 3 = 0 THEN NULL ELSE CAST(floor(o.o_totalprice / 3) AS DOUBLE) END AS salary_max,
  CASE WHEN p.p_partkey % 5 = 0 THEN '3+ years experience' ELSE NULL END AS experience_required,
  CASE p.p_partkey % 9
    WHEN 0 THEN CAST(CAST(e.ts AS DATE) AS STRING)
    WHEN 1 THEN concat(CAST(month(e.ts) AS STRING), '/', CAST(day(e.ts) AS STRING), '/', CAST(year(e.ts) AS STRING))
    WHEN 2 THEN concat(split_part('Jan|Feb', '|', CAST(month(e.ts) AS INT)), ' ', CAST(day(e.ts) AS STRING), ', ', CAST(year(e.ts) AS STRING))
    WHEN 3 THEN concat(CAST(p.p_partkey % 40 AS STRING), ' days ago')
    WHEN 4 THEN '2 weeks ago' WHEN 5 THEN 'yesterday' WHEN 6 THEN '30+ days ago' WHEN 7 THEN '' ELSE NULL END AS date_posted,
  CASE p.p_partkey % 4 WHEN 0 THEN 'Biotech' WHEN 1 THEN 'Fintech' WHEN 2 THEN '' ELSE NULL END AS company_industry,
  e.ts AS date_scraped
FROM part p
LEFT JOIN documents d ON d.doc_id = p.p_partkey - 1
LEFT JOIN (SELECT o_orderkey % (SELECT count(*) FROM part) AS k, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1) o ON o.k = p.p_partkey
LEFT JOIN (SELECT event_id % (SELECT count(*) FROM part) AS k, min(ts) AS ts FROM events GROUP BY 1) e ON e.k = p.p_partkey
"""

RESPONSES = """
SELECT ord AS listing_id, CASE ord % 6
  WHEN 0 THEN concat('{"score": ', CAST(1 + ord % 10 AS STRING), '.5, "reasoning": "r", "matching_skills": ["a","b"], "missing_requirements": [], "detected_vc_investors": ["North Fund"]}')
  WHEN 1 THEN concat('```json', chr(10), '{"score": ', CAST(1 + ord % 10 AS STRING), ', "matching_skills": []}', chr(10), '```')
  WHEN 2 THEN '{"reasoning": "no score"}' WHEN 3 THEN 'not json'
  WHEN 4 THEN concat('json {"score": ', CAST(ord % 10 AS STRING), '}')
  ELSE '{"score": 9.8, "detected_vc_investors": []}' END AS response_text
FROM listings
"""

VC_CACHE = """
SELECT lower(trim(company)) AS company_name,
  CASE min(ord) % 3 WHEN 0 THEN '["North Fund","Acme Capital"]' WHEN 1 THEN '[]' ELSE NULL END AS investors,
  CASE min(ord) % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS backed_by_notable
FROM listings WHERE ord % 5 = 0 GROUP BY lower(trim(company))
"""

CRAWL_RESPONSE = """
SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 302 WHEN 3 THEN 503 ELSE 200 END AS status,
  CASE page_id % 6 WHEN 1 THEN 'https://ex.test/Careers/' WHEN 2 THEN 'https://ex.test/jobs/77' ELSE NULL END AS location,
  CASE WHEN page_id % 12 = 4 THEN concat(html, 'This listing has expired') ELSE html END AS body
FROM pages
"""

SEARCH_API = """
SELECT ord, location AS search_location, concat('{"jobs_results":[{"title":"', title, '","company_name":"', company,
  CASE WHEN ord % 2 = 0 THEN concat('","location":"', location) ELSE '' END,
  '","share_link":"https://ex.test/s/', CAST(ord AS STRING), '","apply_options":[',
  CASE ord % 3 WHEN 0 THEN '{"link":"https://a.test/1"},{"link":"https://pref.test/2"}' WHEN 1 THEN '{"link":""},{"link":"https://b.test/3"}' ELSE '' END,
  '],"detected_extensions":{"posted_at":"3 days ago","salary":"', split_part('$80K-$120K a year|95,000 a year|$50/hr|20 an hour|', '|', CAST(1 + ord % 5 AS INT)), '"}}]}') AS response_json
FROM listings
"""

# Card and link texts with every wording the extractors know, cycling over the listings.
CARDS = """
SELECT ord, title, company, location,
  concat(title, ' ', company, ' ',
    split_part('Long Beach, CA, USA|San Francisco, CA,|Hybrid|Remote|new york, NY USA|Berlin|Hybrid in Oakland', '|', CAST(1 + ord % 7 AS INT)), ' ',
    split_part('92K-164K Annually|150K Annually|23-30 Hourly|200k – 210K /yr||Hourly', '|', CAST(1 + ord % 6 AS INT)), ' ',
    split_part('Senior level|Entry level|Mid level|Expert/Leader|Junior Mid level', '|', CAST(1 + ord % 5 AS INT)),
    CASE WHEN ord % 3 = 0 THEN ' | Fintech • Financial Services • Data' ELSE '' END) AS card_text,
  CASE ord % 6
    WHEN 0 THEN concat(company, ' (S15) • Makes things (about 1 month ago)')
    WHEN 1 THEN concat('  ', company, ' (W21) ')
    WHEN 2 THEN concat(company, ' (W22) · We build')
    WHEN 3 THEN concat(company, ' builds ', title, ' tools for everyone, everywhere, at any time and in any place you want')
    WHEN 4 THEN '  ' ELSE concat(company, ' (15S)') END AS batch_text,
  concat(title, ' ', split_part('fulltime|PartTime |contract|Internship |perm ', '|', CAST(1 + ord % 5 AS INT)),
    location, CASE WHEN ord % 2 = 0 THEN ', US, · more' ELSE '' END,
    CASE WHEN ord % 11 = 0 THEN ' or Remote' ELSE '' END) AS jobtype_text,
  CASE ord % 5
    WHEN 0 THEN concat(title, 'Acme', ' · ', location, ' · Posted on Feb 7, 2026')
    WHEN 1 THEN concat(title, ' · Posted on Jan 3, 2026')
    WHEN 2 THEN concat(title, ' (Ops)Big Co', ' · ', location, ' Posted on Feb 7, 2026')
    WHEN 3 THEN title ELSE concat('  ', lower(title), ' · ', location, ' · x') END AS link_text,
  concat(CASE WHEN ord % 4 = 0 THEN 'Acme & Sons — ' WHEN ord % 4 = 1 THEN 'Blue Ring Ltd. · ' ELSE '' END, title, ' ',
    split_part('HQ: Lisbon • remote|Based in Rome | x|fully REMOTE now|Brooklyn Heights · y|at sea', '|', CAST(1 + ord % 5 AS INT)), ' ',
    coalesce(description, '')) AS context_text,
  concat('Pay $', CAST(50 + ord % 70 AS STRING), 'k', CASE WHEN ord % 3 = 0 THEN concat(' - $', CAST(90 + ord % 70 AS STRING), 'K') ELSE ' or more' END) AS dollar_text,
  split_part('$80K-$120K a year#95,000 a year#$50/hr#20 an hour#, negotiable 70,000.50#30-40k plus 1,000,000 stock#none', '#', CAST(1 + ord % 7 AS INT)) AS api_salary_text
FROM listings
"""

SCORED = """
SELECT ord * 2 + 1 AS id, ord + 1 AS listing_id, CAST(ord % 21 AS DOUBLE) / 2 AS score,
  ord % 3 = 0 AS synced, CASE ord % 5 WHEN 0 THEN 'applied' ELSE 'new' END AS status, ord % 7 <> 0 AS url_alive,
  CASE ord % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS vc_backed,
  split_part('green|yellow|red|black|unknown', '|', CAST(1 + ord % 5 AS INT)) AS freshness,
  ord % 4 = 0 AS is_repost
FROM listings
UNION ALL
SELECT ord * 2 + 2 AS id, ord + 1 AS listing_id, CAST(ord % 19 AS DOUBLE) / 2 AS score,
  FALSE AS synced, 'new' AS status, TRUE AS url_alive, CAST(NULL AS BOOLEAN) AS vc_backed,
  'green' AS freshness, FALSE AS is_repost
FROM listings WHERE ord % 6 = 0
"""

VIEWS = {
    "listings": LISTINGS, "responses": RESPONSES, "vc_cache": VC_CACHE,
    "crawl_response": CRAWL_RESPONSE, "search_api": SEARCH_API, "cards": CARDS, "scored": SCORED,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived views as a DataFrame, timestamps as session-zone timestamps."""
    for t in ("part", "documents", "orders", "events", "pages"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    if name not in ("listings", "crawl_response"):
        spark.sql(LISTINGS).createOrReplaceTempView("listings")
    df = spark.sql(VIEWS[name])
    if "date_scraped" in df.columns:
        df = df.withColumn("date_scraped", df["date_scraped"].cast("timestamp"))
    return df


def with_views(sql: str, *names: str) -> str:
    """The query with the named views (and `listings` where they need it) as leading CTEs."""
    wanted = [n for n in VIEWS if n in names]
    if set(wanted) - {"crawl_response", "listings"} and "listings" not in wanted:
        wanted.insert(0, "listings")
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    tail = sql.strip()
    if not ctes:
        return tail
    for head in ("WITH RECURSIVE ", "WITH "):
        if tail.startswith(head):
            return f"{head}{ctes},\n{tail[len(head):]}"
    return f"WITH {ctes}\n{tail}"
