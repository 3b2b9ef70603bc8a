"""Listings out of search-API JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listwright.functions.salary import salary_from_api
from listwright.functions.text import present
from listwright.schemas import SEARCH_API


def choose_apply_url(options: Column, preferred_domain: str, share_link: Column,
                     job_id: Column | None = None) -> Column:
    """First link on the preferred domain, else the first non-empty one, else the fallbacks.

    `job_id` is the last resort of the flavour that has one, used when share_link is absent.
    """
    links = F.transform(options, lambda o: F.coalesce(o["link"], F.lit("")))

    def first(keep):
        return F.try_element_at(F.filter(links, keep), F.lit(1))

    fallback = share_link if job_id is None else F.coalesce(share_link, job_id)
    return F.coalesce(
        first(lambda x: x.contains(preferred_domain)), first(lambda x: x != ""), fallback,
        F.lit(""))


def parse_search_api(documents: DataFrame, flavour: str, preferred_domain: str) -> DataFrame:
    """One listing per result with title and company.

    The search location fills in when a result has none; JSON null counts as absent.
    """
    job = F.col("job")
    ext = F.col("job.detected_extensions")
    parsed = documents.select(
        "ord", "search_location",
        F.posexplode_outer(F.from_json("response_json", SEARCH_API)["jobs_results"]).alias("pos", "job"))
    kept = parsed.where(present(job["title"]) & present(job["company_name"]))
    qualifications = ext["qualifications"]
    return kept.select(
        "ord", F.col("pos").cast("bigint").alias("pos"), job["title"].alias("title"),
        job["company_name"].alias("company"),
        F.coalesce(job["location"], F.col("search_location")).alias("location"),
        F.coalesce(job["description"], F.lit("")).alias("description"),
        choose_apply_url(job["apply_options"], preferred_domain, job["share_link"],
                         job["job_id"] if flavour == "linkedin" else None).alias("url"),
        salary_from_api(ext["salary"], flavour).alias("salary"),
        (F.when(present(qualifications), qualifications) if flavour == "linkedin"
         else qualifications).alias("experience_required"),
        F.coalesce(ext["posted_at"], F.lit("")).alias("date_posted"),
    ).select("*", "salary.salary_min", "salary.salary_max").drop("salary")
