"""Column layouts of the tables the operators read and write."""

LISTING = (
    "ord bigint, source string, url string, title string, company string, location string, "
    "description string, salary_min double, salary_max double, experience_required string, "
    "date_posted string, company_industry string, date_scraped timestamp"
)
SCORE_RESPONSE = (
    "score double, reasoning string, matching_skills array<string>, "
    "missing_requirements array<string>, recommendation string, "
    "detected_vc_investors array<string>"
)
SEARCH_API = (
    "jobs_results array<struct<title string, company_name string, location string, "
    "description string, share_link string, job_id string, "
    "apply_options array<struct<link string>>, "
    "detected_extensions struct<salary string, qualifications string, schedule_type string, "
    "posted_at string>>>"
)
RUN_LOG = (
    "run_date timestamp, source string, listings_scraped bigint, listings_new bigint, "
    "listings_passed_filter bigint, listings_scored bigint, listings_expired bigint, "
    "errors array<string>, duration_seconds double"
)
LISTING_DEFAULTS = {
    "salary_min": "double", "salary_max": "double", "experience_required": "string",
    "date_posted": "string", "company_industry": "string",
}
