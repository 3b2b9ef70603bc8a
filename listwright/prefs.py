"""Matching and filtering preferences; every list is a parameter with a default."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# The defaults below decide which rows pass and must stay as they are.

COMPANY_SUFFIXES = (
    "inc", "inc.", "llc", "llc.", "corp", "corp.", "corporation",
    "ltd", "ltd.", "limited", "co", "co.", "company",
    "technologies", "technology", "tech", "labs", "lab",
    "group", "holdings", "solutions", "services",
)
CITY_KEYWORDS = (
    ("los_angeles", ("los angeles", "la", "beverly hills", "santa monica", "culver city",
                     "playa vista", "venice", "el segundo")),
    ("san_francisco", ("san francisco", "sf", "bay area", "palo alto", "mountain view",
                       "menlo park", "sunnyvale", "oakland", "san jose")),
    ("new_york", ("new york", "nyc", "manhattan", "brooklyn")),
)
LOCATION_ALIASES = (
    "los angeles", "la", "beverly hills", "santa monica", "west hollywood", "culver city",
    "venice", "playa vista", "el segundo", "marina del rey",
    "san francisco", "sf", "bay area", "oakland", "san jose", "palo alto", "mountain view",
    "menlo park", "sunnyvale", "south bay", "east bay", "redwood city", "berkeley", "fremont",
    "new york", "nyc", "manhattan", "brooklyn", "new york city", "new york, ny",
)
EXCLUDED_INDUSTRIES = (
    "healthcare", "healthtech", "health tech", "biotech", "biotechnology", "medical",
    "pharmaceutical", "pharma", "clinical", "hospital", "patient", "hipaa",
)
INDUSTRY_TITLE_KEYWORDS = (
    "healthcare", "healthtech", "biotech", "biotechnology",
    "pharmaceutical", "pharma", "clinical", "hospital", "nursing",
)
INDUSTRY_COMPANY_KEYWORDS = (
    "hospital", "pharmaceutical", "pharma", "biotech", "biotechnology", "clinic ", "clinical ",
)
INDUSTRY_DESCRIPTION_PHRASES = (
    "healthcare industry", "healthtech", "health tech", "biotech company",
    "biotechnology", "pharmaceutical", "hospital system", "clinical trials",
    "clinical research", "hipaa", "patient care", "patient outcomes",
)
TITLE_KEYWORDS = (
    "operations", "ops", "strategy", "chief of staff", "business associate", "gtm", "growth",
    "revenue", "biz ops", "revops", "finance & operations", "finance and operations",
    "startup operations", "associate", "analyst", "coordinator",
)
SIGNAL_TOOLS = (
    "excel", "google sheets", "notion", "python", "zapier", "n8n", "automation",
    "financial model", "forecasting", "sql", "tableau", "looker",
)
SIGNAL_THEMES = (
    "cross-functional", "data-driven", "fast-paced", "early-stage", "high-growth", "startup",
    "founder", "series a", "series b", "seed",
)
SIGNAL_RESPONSIBILITIES = (
    "financial modeling", "process improvement", "automation", "kpi", "metrics",
    "working with founders", "working directly with", "board", "investor", "pitch", "gtm",
    "go-to-market",
)
NOTABLE_INVESTORS = (
    "sequoia", "andreessen horowitz", "a16z", "benchmark", "accel", "greylock",
    "founders fund", "kleiner perkins", "index ventures", "lightspeed", "general catalyst",
    "bessemer", "nea", "insight partners", "tiger global", "coatue", "thrive capital",
    "ribbit capital", "craft ventures", "first round capital", "union square ventures",
    "y combinator", "yc",
)


@dataclass(frozen=True)
class Prefs:
    """All tunables of a run. Keyword tuples are compared in lower case."""

    company_suffixes: tuple = COMPANY_SUFFIXES
    city_keywords: tuple = CITY_KEYWORDS
    location_aliases: tuple = LOCATION_ALIASES
    max_years: int = 3
    min_salary: float = 70000.0
    excluded_industries: tuple = EXCLUDED_INDUSTRIES
    industry_title_keywords: tuple = INDUSTRY_TITLE_KEYWORDS
    industry_company_keywords: tuple = INDUSTRY_COMPANY_KEYWORDS
    industry_description_phrases: tuple = INDUSTRY_DESCRIPTION_PHRASES
    title_keywords: tuple = TITLE_KEYWORDS
    signal_tools: tuple = SIGNAL_TOOLS
    signal_themes: tuple = SIGNAL_THEMES
    signal_responsibilities: tuple = SIGNAL_RESPONSIBILITIES
    min_categories: int = 1
    notable_investors: tuple = NOTABLE_INVESTORS
    investor_bonus: float = 0.5
    green_days: int = 7
    yellow_days: int = 14
    red_days: int = 21
    match_ratio: int = 85
    repost_company_ratio: int = 90
    repost_title_ratio: int = 85
    repost_days: int = 30
    max_checks: int = 50

    @classmethod
    def from_yaml(cls, path: str) -> "Prefs":
        """Read overrides from a YAML mapping of field name to value."""
        import yaml

        with open(path, encoding="utf-8") as f:
            given = yaml.safe_load(f) or {}
        known = {f.name for f in fields(cls)}
        unknown = set(given) - known
        if unknown:
            raise ValueError(f"unknown preference fields: {sorted(unknown)}")
        return replace(cls(), **{k: _tupled(v) for k, v in given.items()})


def _tupled(value):
    if isinstance(value, dict):
        return tuple((k, _tupled(v)) for k, v in value.items())
    if isinstance(value, list):
        return tuple(_tupled(v) for v in value)
    return value.lower() if isinstance(value, str) else value
