"""Scoring through a response table: requests go out as rows, answers come back as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from listwright.functions.text import present, strip
from listwright.operators.enrich import merge_detected, vc_display
from listwright.operators.skew import first_per_key
from listwright.prefs import Prefs
from listwright.schemas import SCORE_RESPONSE

PROMPT_DESCRIPTION_CHARS = 3000

# Title words that cap a score, and the lower bound of each score band.
SENIORITY_CAPS = (
    (3, r"\b(senior manager|senior director|svp|evp|c-suite)\b"),
    (4, r"\b(vp|vice president|director|head of|principal|staff)\b"),
    (6, r"\bsenior\b"),
)
SCORE_BANDS = ((9, "perfect"), (6, "good"), (3, "weak"))

_FENCED = r"(?s)^```[^\n]*\n(.*?)(?:```)?$"


def build_prompt(template: str) -> Column:
    """Fill {title}, {company}, {location}, {date_posted}, {description}, {vc_info}.

    The template is the caller's; the field texts are inserted as they are.
    """
    def given(name, default):
        return F.when(present(F.col(name)), F.col(name)).otherwise(default)

    values = {
        "title": F.coalesce("title", F.lit("")),
        "company": F.coalesce("company", F.lit("")),
        "location": given("location", "Not specified"),
        "date_posted": given("date_posted", "Not specified"),
        "description": F.substring(given("description", "No description available"),
                                   1, PROMPT_DESCRIPTION_CHARS),
        "vc_info": vc_display(F.col("investors"), F.col("vc_backed"), "prompt"),
    }
    pieces, rest = [], template
    while rest:
        at = {n: rest.find("{" + n + "}") for n in values}
        found = [(i, n) for n, i in at.items() if i >= 0]
        if not found:
            pieces.append(F.lit(rest))
            break
        i, name = min(found)
        pieces += [F.lit(rest[:i]), values[name]]
        rest = rest[i + len(name) + 2:]
    return F.concat(*pieces)


def prompt_requests(enriched: DataFrame, template: str) -> DataFrame:
    return enriched.select(F.col("ord").alias("listing_id"), build_prompt(template).alias("prompt"))


def parse_response(text: Column) -> Column:
    """The answer as a struct, NULL when it is no JSON object with a score.

    Accepts a fenced block and a leading 'json' word. An explicit null score is rejected too.
    """
    body = strip(F.regexp_replace(strip(text), _FENCED, "$1"))
    parsed = F.from_json(strip(F.regexp_replace(body, "^json", "")), SCORE_RESPONSE)
    return F.when(parsed["score"].isNotNull(), parsed)


def final_score(score: Column, backed: Column, prefs: Prefs = Prefs()) -> Column:
    """Bonus for notable backing, never lifting a score above ten."""
    lifted = F.least(F.lit(10.0), score + prefs.investor_bonus)
    return F.when(F.coalesce(backed, F.lit(False)) & (score < 10), lifted).otherwise(score)


def seniority_cap(title: Column) -> Column:
    """Highest score a title allows, NULL without a cap. 'Chief of staff' is not 'staff'."""
    t = F.regexp_replace(F.lower(title), r"chief of staff", "")
    return F.least(*[F.when(t.rlike(p), cap) for cap, p in SENIORITY_CAPS])


def score_band(score: Column) -> Column:
    """Anchor band of a score; values between two bands fall to the lower one."""
    return reduce(lambda w, b: w.when(score >= b[0], b[1]), SCORE_BANDS[1:],
                  F.when(score >= SCORE_BANDS[0][0], SCORE_BANDS[0][1])) \
        .otherwise(F.when(score.isNotNull(), "none"))


def score_listings(enriched: DataFrame, responses: DataFrame,
                   prefs: Prefs = Prefs()) -> DataFrame:
    """Listings with a usable answer, scored; listings without one are dropped.

    `responses` should hold one row per listing_id (see `one_response` for raw logs); of several
    usable answers the smallest counts, so no listing is multiplied. Answers are parsed once.
    """
    answers = _usable(responses).groupBy("ord").agg(F.min("r").alias("r"))
    joined = merge_detected(
        enriched.join(answers, "ord").withColumn("_detected", F.col("r.detected_vc_investors")),
        "_detected", prefs)
    none = F.array().cast("array<string>")
    return joined.select(
        *[c for c in enriched.columns if c not in ("vc_backed", "investors", "vc_source")],
        final_score(F.col("r.score"), F.col("vc_backed"), prefs).alias("score"),
        F.coalesce("r.reasoning", F.lit("")).alias("reasoning"),
        F.coalesce("r.matching_skills", none).alias("matching_skills"),
        F.coalesce("r.missing_requirements", none).alias("missing_requirements"),
        F.coalesce("r.recommendation", F.lit("")).alias("recommendation"),
        "vc_backed", "investors", "vc_source",
    )


def _usable(responses: DataFrame) -> DataFrame:
    """(ord, r) of the answers that parse; the generator keeps the parse from being repeated."""
    parsed = F.explode_outer(F.array(parse_response(F.col("response_text"))))
    return responses.select(F.col("listing_id").alias("ord"), parsed.alias("r")).where(F.col("r").isNotNull())


def repeat_requests(enriched: DataFrame, responses: DataFrame, template: str, suffix: str) -> DataFrame:
    """Second requests, with the caller's stricter `suffix`, for listings whose answers do not parse."""
    asked = responses.select(F.col("listing_id").alias("ord")).distinct()
    unusable = asked.join(_usable(responses).select("ord"), "ord", "left_anti")
    return prompt_requests(enriched.join(unusable, "ord", "left_semi"), template).withColumn(
        "prompt", F.concat("prompt", F.lit(suffix)))


def one_response(responses: DataFrame, order: str) -> DataFrame:
    """First response per listing from a raw log ordered by a unique column."""
    return first_per_key(responses, "listing_id", order)


def scoring_stats(enriched: DataFrame, responses: DataFrame) -> DataFrame:
    """How many listings got a usable answer and how many did not; several answers count once."""
    usable = _usable(responses).groupBy("ord").agg(F.lit(True).alias("_ok"))
    ok = F.coalesce("_ok", F.lit(False))
    return enriched.select("ord").join(usable, "ord", "left").agg(
        F.count("*").alias("listings"), F.count_if(ok).alias("scored"),
        F.count_if(~ok).alias("errors"))
