"""Every operator as a query over the given tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks import boards
from checks.views import AS_OF, table, view
from listwright.functions import cards as C, dates as D, salary as S, text as X
from listwright.functions import similarity as M
from listwright.operators import (
    clustering, enrich, export, filters, health, linkage, metrics, scoring, store,
)
from listwright.operators.scratch import scratch_root, stage
from listwright.plans import pipeline
from listwright.sources import links, pages, search_api, union
from listwright.streaming import incremental

TEMPLATE = "Role {title} at {company} in {location}, {date_posted}. {vc_info}. {description}"
BASE = "https://board.test"

QUERIES = {}


def as_of() -> Column:
    return F.expr(AS_OF)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _listings(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "listings")


def _keyed(spark, sf_dir) -> DataFrame:
    return pipeline.with_keys(_listings(spark, sf_dir))


def _store(spark, sf_dir) -> DataFrame:
    return _keyed(spark, sf_dir).where("ord % 3 = 0").withColumn("id", F.col("ord") + 1)


def _batch(spark, sf_dir) -> DataFrame:
    return _keyed(spark, sf_dir).where("ord % 3 <> 0")


def _stored_all(spark, sf_dir) -> DataFrame:
    """All listings under id ord + 1, the parent of the scored view."""
    return _listings(spark, sf_dir).withColumn("id", F.col("ord") + 1)


def _enriched(spark, sf_dir) -> DataFrame:
    return enrich.enrich_investors(_listings(spark, sf_dir), view(spark, sf_dir, "vc_cache"))


def _scored(spark, sf_dir) -> DataFrame:
    scored = scoring.score_listings(_enriched(spark, sf_dir), view(spark, sf_dir, "responses"))
    return pipeline.with_freshness(scored, as_of()).withColumn("is_repost", F.col("ord") % 4 == 0)


def _long(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("bigint")


def _scalar(name, view_name, build):
    """Register ord plus the columns `build` makes from a view."""
    def run(spark, sf_dir):
        return view(spark, sf_dir, view_name).select("ord", *build())
    QUERIES[name] = run


def _pair(struct: Column) -> list[Column]:
    return [struct["salary_min"].alias("salary_min"), struct["salary_max"].alias("salary_max")]


# Sources

@query
def extract_links(spark, sf_dir):
    return links.extract_links(table(spark, sf_dir, "pages"))


@query
def resolve_url(spark, sf_dir):
    found = links.extract_links(table(spark, sf_dir, "pages"))
    base = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("base"))
    shapes = F.array(F.col("href"), F.concat(F.lit("http://abs.test"), F.col("href")),
                     F.concat(F.lit("#"), F.col("pos")), F.concat(F.lit("?p="), F.col("pos")),
                     F.concat(F.lit("sub"), F.col("href")), F.concat(F.lit("../up"), F.col("href")),
                     F.concat(F.lit("//cdn.test"), F.col("href")), F.lit(""), F.lit("mailto:a@b.c"),
                     F.concat(F.lit("tel:"), F.col("pos")), F.lit("javascript:void(0)"))
    made = found.join(base, "page_id").withColumn("href", F.get(shapes, (F.col("pos") % 11).cast("int")))
    return made.select("page_id", "pos", links.resolve_url(F.col("href"), F.col("base")).alias("url"))


@query
def first_seen_url(spark, sf_dir):
    found = links.extract_links(table(spark, sf_dir, "pages")).select(
        links.arrival(F.col("page_id"), F.col("pos")).alias("ord"), F.col("href").alias("url"),
        "page_id", "pos")
    return links.first_seen_by_url(found).select("url", "page_id", "pos")


@query
def job_link_filter(spark, sf_dir):
    href = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("/JOBS/"), F.col("ord"))).when(
        F.col("ord") % 3 == 1, F.concat(F.lit("/job/"), F.col("ord"), F.lit("/x"))).otherwise(
        F.concat(F.lit("/team/"), F.col("ord")))
    text = F.concat(F.when(F.col("ord") % 7 == 0, F.lit("Bank for shops.Fintech ")).otherwise(F.lit("")),
                    F.col("title"))
    return _listings(spark, sf_dir).select("ord", *[
        F.coalesce(rule(href, text), F.lit(False)).alias(name)
        for name, rule in links.PROFILES.items()])


@query
def card_context(spark, sf_dir):
    return pages.card_context(table(spark, sf_dir, "pages"), 100, 8)


@query
def listings_cards_path(spark, sf_dir):
    return pages.listings_cards_path(boards.cards_path(spark, sf_dir), BASE).drop("pos")


@query
def listings_batch_company(spark, sf_dir):
    return pages.listings_batch_company(boards.batch_company(spark, sf_dir)).drop("pos")


@query
def listings_concat_text(spark, sf_dir):
    return pages.listings_concat_text(boards.concat_text(spark, sf_dir), BASE).drop("pos")


@query
def listings_fallback(spark, sf_dir):
    return pages.listings_fallback(boards.fallback(spark, sf_dir), BASE).drop("pos")


@query
def listings_company_card(spark, sf_dir):
    return pages.listings_company_card(boards.company_card(spark, sf_dir), BASE).drop("pos")


@query
def listings_keyword_links(spark, sf_dir):
    return pages.listings_keyword_links(boards.keyword_links(spark, sf_dir), BASE).drop("pos")


@query
def search_api_listings(spark, sf_dir):
    out = search_api.parse_search_api(view(spark, sf_dir, "search_api"), "linkedin", "pref.test")
    return out.select("ord", "title", "company", "location", "url", "salary_min", "salary_max",
                      "date_posted")


@query
def search_api_listings_indeed(spark, sf_dir):
    out = search_api.parse_search_api(view(spark, sf_dir, "search_api"), "indeed", "b.test")
    return out.select("ord", "title", "company", "location", "url", "salary_min", "salary_max",
                      "date_posted")


@query
def choose_apply_url(spark, sf_dir):
    options = F.from_json(F.concat(
        F.lit('[{"link":"'), F.when(F.col("ord") % 2 == 0, F.col("url")).otherwise(F.lit("")),
        F.lit('"},{"link":"https://pref.test/'), F.col("ord").cast("string"), F.lit('"}]')),
        "array<struct<link string>>")
    options = F.when(F.col("ord") % 5 == 0, F.array().cast("array<struct<link string>>")).otherwise(options)
    domain = "pref.test/1"
    share = F.when(F.col("ord") % 10 == 0, F.col("url"))
    return _listings(spark, sf_dir).select(
        "ord", search_api.choose_apply_url(options, domain, share, F.lit("job")).alias("with_id"),
        search_api.choose_apply_url(options, domain, share).alias("without_id"))


@query
def union_sources(spark, sf_dir):
    base = _listings(spark, sf_dir).select(F.col("ord").alias("seq"), "source", "url")

    def part(n):
        def load():
            df = base.where(F.col("source") == n)
            return df.drop("url") if n == "src3" else df
        return load

    def broken():
        return spark.read.parquet(f"{sf_dir}/no-such-source")

    loaders = {n: broken if n == "src2" else part(n) for n in ("src4", "src2", "src0", "src3", "src1")}
    both, errors = union.union_sources(loaders)
    return both.select("source", "source_rank", "ord", "url", F.lit(len(errors)).cast("bigint").alias("errors"))


# Scalar functions

_scalar("normalize_company", "listings", lambda: [X.normalize_company(F.col("company")).alias("v")])
_scalar("normalize_title", "listings", lambda: [X.normalize_title(F.col("title")).alias("v")])
_scalar("normalize_location", "listings", lambda: [
    X.normalize_location(F.col("location")).alias("v"),
    X.normalize_location(F.col("location"), word_boundary=True).alias("whole_words")])
_scalar("fuzzy_key", "listings", lambda: [
    X.fuzzy_key(F.col("company"), F.col("title"), F.col("location")).alias("v")])
_scalar("completeness", "listings", lambda: [_long(X.completeness()).alias("points")])
_scalar("salary_card", "cards", lambda: _pair(S.salary_from_card(F.col("card_text"))))
_scalar("salary_api", "cards", lambda: [
    S.salary_from_api(F.col("api_salary_text"), f)[c].alias(f"{f}_{c[-3:]}")
    for f in ("linkedin", "indeed") for c in ("salary_min", "salary_max")])
_scalar("salary_dollar_k", "cards", lambda: _pair(S.salary_dollar_k(F.col("dollar_text"))))
_scalar("location_card", "cards", lambda: [C.location_from_card(F.col("card_text")).alias("v")])
_scalar("card_fields", "cards", lambda: [
    C.experience_level(F.col("card_text")).alias("level"),
    C.industry_tags(F.col("card_text")).alias("industry"),
    C.description_excerpt(F.array(F.col("title"), F.concat(F.lit("Top Skills "), F.col("context_text")),
                                  F.col("context_text")), F.col("card_text")).alias("excerpt")])
_scalar("company_batch", "cards", lambda: [C.company_batch(F.col("batch_text")).alias("v")])
_scalar("location_jobtype", "cards", lambda: [C.location_jobtype(F.col("jobtype_text")).alias("v")])
_scalar("split_link_text", "cards", lambda: [
    C.split_link_text(F.col("link_text"))[c].alias(c) for c in ("title", "company", "location")])
_scalar("context_fields", "cards", lambda: [
    C.context_fields(F.col("context_text"))[c].alias(c)
    for c in ("company", "location", "description")])
_scalar("min_years", "listings", lambda: [filters.min_years(F.concat_ws(
    " ", X.blank(F.col("experience_required")), X.blank(F.col("description")))).alias("years")])
_scalar("parse_posted_date", "listings", lambda: [
    F.unix_seconds(D.parse_posted_date(F.col("date_posted"), as_of())).alias("posted")])
_scalar("parse_relative_date", "listings", lambda: [
    F.unix_seconds(D.parse_relative_date(F.col("date_posted"), as_of())).alias("posted")])
_scalar("freshness", "listings", lambda: [
    D.freshness(D.parse_posted_date(F.col("date_posted"), as_of()), as_of()).alias("by_posted"),
    D.freshness(F.col("date_scraped"), as_of()).alias("by_scraped")])
_scalar("freshness_icon", "listings", lambda: [
    D.freshness_icon(D.freshness(F.col("date_scraped"), as_of())).alias("icon"),
    D.freshness_icon(F.col("title")).alias("other")])
_scalar("format_salary", "listings", lambda: [
    S.format_salary(F.col("salary_min"), F.col("salary_max")).alias("v"),
    S.format_salary(F.lit(0.0), (F.col("ord") * 500).cast("double")).alias("halves")])


@query
def indel_ratio(spark, sf_dir):
    """Consecutive titles and companies compared; one neighbour each, no pairing of groups."""
    df = _listings(spark, sf_dir).select("ord", F.concat_ws(" ", "title", "company").alias("a"))
    nxt = df.select((F.col("ord") - 1).alias("ord"), F.col("a").alias("b"))
    return df.join(nxt, "ord").select(
        "ord", F.round(M.indel_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query
def vc_display(spark, sf_dir):
    return _enriched(spark, sf_dir).select("ord", *[
        enrich.vc_display(F.col("investors"), F.col("vc_backed"), s).alias(s)
        for s in ("export", "prompt")])


@query
def json_list(spark, sf_dir):
    cases = F.get(F.array(F.lit('["a","b"]'), F.lit("not json"), F.lit('{"a":1}'), F.lit("[]"),
                          F.concat(F.lit('["'), F.col("title"), F.lit('"]'))),
                  (F.col("ord") % 5).cast("int"))
    return _listings(spark, sf_dir).select(
        "ord", F.array_join(X.json_list(cases), "/").alias("joined"),
        _long(F.size(X.json_list(cases))).alias("n"))


@query
def parse_llm_response(spark, sf_dir):
    r = scoring.parse_response(F.col("response_text"))
    return view(spark, sf_dir, "responses").select("listing_id", r.alias("r")).select(
        "listing_id", F.col("r.score").alias("score"), F.col("r.reasoning").alias("reasoning"),
        F.array_join("r.matching_skills", ",").alias("skills"),
        F.array_join("r.detected_vc_investors", ",").alias("detected"))


@query
def build_prompt(spark, sf_dir):
    return scoring.prompt_requests(_enriched(spark, sf_dir), TEMPLATE)


@query
def final_score(spark, sf_dir):
    return view(spark, sf_dir, "scored").select(
        "id", scoring.final_score(F.col("score"), F.col("vc_backed")).alias("v"))


@query
def seniority_cap(spark, sf_dir):
    title = F.concat(F.get(F.array(*[F.lit(x) for x in ("", "SVP ", "Director, ", "Head of ", "Senior Manager ")]),
                           (F.col("ord") % 5).cast("int")), F.col("title"))
    return _listings(spark, sf_dir).select("ord", _long(scoring.seniority_cap(title)).alias("cap"))


@query
def score_band(spark, sf_dir):
    return view(spark, sf_dir, "scored").select("id", scoring.score_band(F.col("score")).alias("band"))


@query
def notable_investors(spark, sf_dir):
    names = F.array(F.concat(F.lit("Linear "), F.col("company")), F.get(
        F.array(F.lit("Accel Partners"), F.lit("Index"), F.lit("Unknown Fund"), F.lit("")),
        (F.col("ord") % 4).cast("int")))
    some = F.when(F.col("ord") % 2 == 0, F.slice(names, 2, 1)).otherwise(F.slice(names, 1, 1))
    return _listings(spark, sf_dir).select("ord", enrich.notable_investors(some).alias("notable"))


@query
def vc_flag_code(spark, sf_dir):
    return view(spark, sf_dir, "scored").select(
        "id", _long(enrich.vc_flag_code(F.col("vc_backed"))).alias("code"))


@query
def generic_redirect(spark, sf_dir):
    made = F.concat("url", F.get(F.array(*[F.lit(x) for x in ("/careers", "/JOBS/", "/jobs/1", "/404", "")]),
                                 (F.col("page_id") % 5).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", health.is_generic_redirect(made).alias("generic"))


@query
def display_lists(spark, sf_dir):
    words = F.filter(F.split(F.col("title"), " "), lambda w: w != "&")
    some = F.when(F.col("ord") % 3 == 0, F.array().cast("array<string>")).otherwise(
        F.concat(words, words))
    return _listings(spark, sf_dir).select(
        "ord", X.join_first(some).alias("every"), X.join_first(some, 4, "—").alias("four"),
        X.join_first(some, 3, "—").alias("three"))


# Filters

_scalar("filter_location", "listings", lambda: [filters.location_ok().alias("ok")])
_scalar("filter_experience", "listings", lambda: [filters.experience_ok().alias("ok")])
_scalar("filter_salary", "listings", lambda: [filters.salary_ok().alias("ok")])
_scalar("filter_industry", "listings", lambda: [filters.industry_ok().alias("ok")])
_scalar("keyword_categories", "listings", lambda: [_long(filters.keyword_categories()).alias("n")])


@query
def hard_filters(spark, sf_dir):
    return filters.hard_filters(_listings(spark, sf_dir)).select("ord", "reject_reason")


@query
def keyword_prefilter(spark, sf_dir):
    return filters.keyword_prefilter(_listings(spark, sf_dir)).select("ord", "title")


@query
def expired_verdict(spark, sf_dir):
    return view(spark, sf_dir, "crawl_response").select("page_id", health.expired(
        F.col("status"), F.col("location"), F.col("body")).alias("expired"))


# Joins and stores

@query
def anti_seen_url(spark, sf_dir):
    return store.anti_seen_url(_batch(spark, sf_dir), _store(spark, sf_dir)).select("ord", "url")


@query
def enrich_investors(spark, sf_dir):
    return _enriched(spark, sf_dir).select(
        "ord", F.array_join("investors", ",").alias("investors"), "vc_backed", "vc_source")


@query
def merge_detected_investors(spark, sf_dir):
    answers = view(spark, sf_dir, "responses").select(
        F.col("listing_id").alias("ord"),
        scoring.parse_response(F.col("response_text"))["detected_vc_investors"].alias("detected"))
    merged = enrich.merge_detected(_enriched(spark, sf_dir).join(answers, "ord", "left"), "detected")
    return merged.select("ord", F.array_join("investors", ",").alias("investors"), "vc_backed", "vc_source")


@query
def score_listings(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "ord", "score", "reasoning", F.array_join("matching_skills", ",").alias("skills"),
        "vc_backed", "vc_source", "freshness")


@query
def resolve_listing_id(spark, sf_dir):
    first = store.insert_listings(_store(spark, sf_dir).limit(0), _listings(spark, sf_dir)).where(
        "ord % 3 = 0").withColumn("id", F.col("ord") + 1)
    return store.resolve_listing_id(_listings(spark, sf_dir).select("ord", "url"), first).select(
        "ord", "listing_id", "listing_found")


@query
def unsynced_scored(spark, sf_dir):
    return export.unsynced_scored(view(spark, sf_dir, "scored"), _stored_all(spark, sf_dir)).select(
        "id", "listing_id", "score", "title", "url")


@query
def expire_by_url(spark, sf_dir):
    urls = _listings(spark, sf_dir).where("ord % 4 = 0").select("url")
    changes = store.expire_by_url(view(spark, sf_dir, "scored"), _stored_all(spark, sf_dir), urls, 7)
    return changes.select("id", "seq", "status", "url_alive")


@query
def health_queue(spark, sf_dir):
    return health.health_queue(view(spark, sf_dir, "scored"), _stored_all(spark, sf_dir))


@query
def dead_urls(spark, sf_dir):
    return health.dead_urls(view(spark, sf_dir, "crawl_response"))


@query
def insert_listings(spark, sf_dir):
    batch = _batch(spark, sf_dir).withColumns({
        "url": F.when(F.col("ord") % 13 != 0, F.col("url")),
        "title": F.when(F.col("ord") % 11 != 0, F.col("title"))})
    return store.insert_listings(_store(spark, sf_dir), batch).select("ord", "url", "title")


@query
def assign_ids(spark, sf_dir):
    stored, batch = _store(spark, sf_dir), _batch(spark, sf_dir)
    return store.assign_ids(store.insert_listings(stored, batch), "ord", store.last_id(stored)).select(
        "ord", "id")


@query
def append_scored(spark, sf_dir):
    scored = view(spark, sf_dir, "scored")
    again = scored.where("score >= 5").withColumnRenamed("id", "was").drop("synced")
    return store.append_scored(scored, again, "was").select("id", "was", "listing_id", "score")


@query
def upsert_cache(spark, sf_dir):
    cache = view(spark, sf_dir, "vc_cache")
    updates = _listings(spark, sf_dir).where("ord % 4 = 0").select(
        "ord", enrich.company_cache_key(F.col("company")).alias("company_name"),
        F.concat(F.lit('["Fund '), F.col("ord").cast("string"), F.lit('"]')).alias("investors"),
        (F.col("ord") % 8 == 0).alias("backed_by_notable"))
    return store.upsert_cache(cache, updates, "ord")


def _changes(spark, sf_dir):
    scored = view(spark, sf_dir, "scored")
    base = scored.select("id", F.lit(0).cast("bigint").alias("seq"), "status", "synced", "url_alive")
    synced = store.change_rows(scored.where("score > 4"), 1, synced=True)
    applied = store.change_rows(scored.where("id % 5 = 1"), 2, status="applied")
    dead = store.expire_by_url(scored, _stored_all(spark, sf_dir),
                               _listings(spark, sf_dir).where("ord % 4 = 0").select("url"), 3)
    return base.unionByName(synced).unionByName(applied).unionByName(dead)


@query
def apply_changes(spark, sf_dir):
    return store.latest_state(_changes(spark, sf_dir))


@query
def latest_state(spark, sf_dir):
    """Latest order status, day and price per customer seen as a change log on real tables."""
    log = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") > 100000).alias("synced"),
        (F.col("o_orderpriority") < "3").alias("url_alive"))
    return store.latest_state(log)


@query
def key_index(spark, sf_dir):
    return store.key_index(_keyed(spark, sf_dir).withColumn("id", F.col("ord") + 1))


@query
def run_log(spark, sf_dir):
    """One log row per day and source out of the event stream's days."""
    return _run_log(spark, sf_dir)


def _run_log(spark, sf_dir):
    day = F.to_date("date_scraped")
    rows = filters.hard_filters(_listings(spark, sf_dir))
    return rows.groupBy(day.cast("string").alias("run_date"), "source").agg(
        F.count("*").alias("listings_scraped"),
        F.count_if(F.col("reject_reason").isNull()).alias("listings_passed_filter"),
        F.min("ord").alias("id"))


@query
def last_run(spark, sf_dir):
    return store.last_run(_run_log(spark, sf_dir))


def _export(spark, sf_dir):
    answers = view(spark, sf_dir, "responses").select(
        (F.col("listing_id") + 1).alias("listing_id"),
        scoring.parse_response(F.col("response_text")).alias("r"))
    scored = view(spark, sf_dir, "scored").join(answers, "listing_id", "left").select(
        "*", F.col("r.matching_skills").alias("matching_skills"),
        F.col("r.missing_requirements").alias("missing_requirements"),
        F.col("r.recommendation").alias("recommendation"),
        F.col("r.detected_vc_investors").alias("investors")).drop("r")
    return export.export_rows(export.unsynced_scored(scored, _stored_all(spark, sf_dir)))


@query
def export_rows(spark, sf_dir):
    return _export(spark, sf_dir)


@query
def published_exports(spark, sf_dir):
    """Two runs' exports, the first tried twice and a third one without rows; `newest` marks the new snapshot."""
    rows, folder = _export(spark, sf_dir).select("id", "title", "link"), scratch_root(spark)
    for run, part in ((1, "id % 4 <> 3"), (1, "id % 4 = 3"), (2, "id % 4 = 1"), (3, "false")):
        export.publish_export(rows.where(part), folder, run)
    new = export.published(spark, folder, rows.schema, "new").select("id", F.lit(True).alias("newest"))
    every = export.published(spark, folder, rows.schema)
    return every.join(new, "id", "left").select("id", "title", "link", "run", F.coalesce("newest", F.lit(False)).alias("newest"))


# Aggregations, ranking, digest

@query
def reject_stats(spark, sf_dir):
    return metrics.reject_stats(filters.hard_filters(_listings(spark, sf_dir)))


@query
def freshness_dist(spark, sf_dir):
    posted = D.parse_posted_date(F.col("date_posted"), as_of())
    return metrics.freshness_dist(_listings(spark, sf_dir).select(D.freshness(posted, as_of()).alias("freshness")))


@query
def source_counts(spark, sf_dir):
    return metrics.source_counts(_listings(spark, sf_dir))


@query
def funnel(spark, sf_dir):
    rows = filters.hard_filters(_listings(spark, sf_dir))
    passed = F.col("reject_reason").isNull()
    kept = passed & (filters.keyword_categories() >= 1)
    staged = rows.select(
        F.when(kept, 2).when(passed, 1).otherwise(0).alias("steps_passed"),
        F.array(F.lit("hard_filters"), F.lit("keyword_prefilter")).alias("steps"),
        (F.col("ord") % 7 == 0).alias("is_repost"))
    return metrics.funnel(staged).withColumn("step_no", _long("step_no"))


@query
def enrichment_stats(spark, sf_dir):
    return enrich.enrichment_stats(_enriched(spark, sf_dir))


@query
def scoring_stats(spark, sf_dir):
    return scoring.scoring_stats(_enriched(spark, sf_dir), view(spark, sf_dir, "responses"))


@query
def rank_by_score(spark, sf_dir):
    return export.rank_by_score(_scored(spark, sf_dir)).select("ord", "title", "score")


@query
def digest_top(spark, sf_dir):
    return export.digest_top(_scored(spark, sf_dir)).select(
        "ord", "score", "title", "line", "backed", "matches", "gaps")


@query
def digest_summary(spark, sf_dir):
    return export.digest_summary(_scored(spark, sf_dir))


@query
def digest_subject(spark, sf_dir):
    return export.digest_subject(export.digest_summary(_scored(spark, sf_dir)), F.lit(0))


# Streaming

def _arrivals(spark, sf_dir, root, parts=4):
    """The listings in arrival order, a part at a time: yields a stream of the folder after each part arrived."""
    rows = stage(_listings(spark, sf_dir), f"{root}/listings")
    top = rows.agg(F.max("ord")).first()[0] + 1
    cut = F.floor(F.col("ord") * parts / top)
    for n in range(parts):
        rows.where(cut == n).write.mode("append").parquet(f"{root}/in")
        yield incremental.file_stream(spark, rows.schema, f"{root}/in", files_per_run=10_000)


def _ingested(spark, sf_dir, names=False):
    """The store after four runs, each a start of the stream of its own."""
    root = scratch_root(spark)
    for stream in _arrivals(spark, sf_dir, root):
        out = incremental.stream_ingest(stream, f"{root}/store", f"{root}/progress", as_of(),
                                        names=f"{root}/names" if names else None)
    return out


@query
def stream_ingest(spark, sf_dir):
    return _ingested(spark, sf_dir).select("id", "ord", "url")


@query
def stream_reposts(spark, sf_dir):
    return _ingested(spark, sf_dir).select("ord", "is_repost", "original_listing_id")


@query
def stream_fuzzy_reposts(spark, sf_dir):
    return _ingested(spark, sf_dir, names=True).select("ord", "is_repost", "original_listing_id")


@query
def stream_dedup_url(spark, sf_dir):
    root = scratch_root(spark)
    for stream in _arrivals(spark, sf_dir, root):
        out = incremental.stream_dedup_url(stream, f"{root}/out", f"{root}/progress")
    return out.select("url")


@query
def stream_daily_counts(spark, sf_dir):
    root = scratch_root(spark)
    schema = table(spark, sf_dir, "events").schema
    stream = incremental.file_stream(spark, schema, sf_dir, "events.parquet").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    out = incremental.stream_daily_counts(stream, "ts", "event_type", f"{root}/out", f"{root}/progress")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


# Similarity, clustering and the whole run, last because they are the heaviest

@query
def fuzzy_pairs(spark, sf_dir):
    return clustering.fuzzy_pairs(_keyed(spark, sf_dir))


@query
def fuzzy_clusters(spark, sf_dir):
    return clustering.fuzzy_clusters(_keyed(spark, sf_dir))


@query
def dedup_batch(spark, sf_dir):
    return clustering.dedup_batch(_keyed(spark, sf_dir)).select("ord", "leader_ord")


@query
def anti_seen_fuzzy(spark, sf_dir):
    return linkage.anti_seen_fuzzy(_batch(spark, sf_dir), _store(spark, sf_dir)).select("ord")


@query
def detect_reposts(spark, sf_dir):
    return linkage.detect_reposts(_batch(spark, sf_dir), _store(spark, sf_dir), as_of()).select(
        "ord", "is_repost", "original_listing_id")


def run_pipeline(spark: SparkSession, sf_dir: str) -> pipeline.Run:
    listings = _listings(spark, sf_dir)
    return pipeline.pipeline_run(
        listings.where("ord % 9 <> 0"), _keyed(spark, sf_dir).where("ord % 9 = 0").withColumn(
            "id", F.col("ord") + 1),
        view(spark, sf_dir, "vc_cache"), view(spark, sf_dir, "responses"), as_of())


@query
def run_scored(spark, sf_dir):
    return run_pipeline(spark, sf_dir).scored.select(
        "ord", "title", "company", "score", "freshness", "vc_source", "is_repost",
        "original_listing_id", "leader_ord")


@query
def run_funnel(spark, sf_dir):
    return run_pipeline(spark, sf_dir).funnel.withColumn("step_no", _long("step_no"))


def _finished(spark: SparkSession, sf_dir: str) -> pipeline.Finished:
    """The run over the listings, its store a ninth of them, with the pages as crawl responses."""
    run = run_pipeline(spark, sf_dir)
    kept = _keyed(spark, sf_dir).where("ord % 9 = 0").withColumn("id", F.col("ord") + 1)
    crawl = view(spark, sf_dir, "crawl_response").select(
        F.concat(F.lit("https://ex.test/job/"), F.col("page_id")).alias("url"), "status", "location", "body")
    nothing = spark.createDataFrame(
        [], "id bigint, seq bigint, status string, synced boolean, url_alive boolean")
    return pipeline.finish_run(run, kept, None, nothing, crawl, as_of(), 1)


@query
def run_export(spark, sf_dir):
    return _finished(spark, sf_dir).export


@query
def run_digest(spark, sf_dir):
    return _finished(spark, sf_dir).digest.drop("recommendation")


@query
def run_entry(spark, sf_dir):
    """The run's own row of the run log."""
    return _finished(spark, sf_dir).run_log.withColumn("run_date", F.col("run_date").cast("string")).drop("errors")


@query
def run_changes(spark, sf_dir):
    return _finished(spark, sf_dir).changes
