"""Fixed values and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: states, statuses and word lists that results depend on
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO",
    "connecticut": "CT", "delaware": "DE", "district of columbia": "DC", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI",
    "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV",
    "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC",
    "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA",
    "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX",
    "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV",
    "wisconsin": "WI", "wyoming": "WY",
}
INVALID_WEBSITES = (
    "", "+", "-", "--", "na", "n/a", "none", "null", "nan", "not available", "not reported", "unavailable",
    "missing", "no website", "†", "‡", "â€ ", "â€¡", "–", "—",
)
SEARCH_METHODS = (
    "crawler", "brave", "hybrid", "district_search", "district_search_hybrid", "district_search_browser",
    "district_search_browser_hybrid",
)
RUN_STATUSES = ("queued", "running", "completed", "cancelled", "failed")
PROFILE_STATUSES = (
    "working", "requires_javascript", "manual_review", "search_found_but_failed", "no_search_found",
    "blocked_by_robots", "blocked_by_challenge", "external_search_only", "error",
)
NEVER_TESTED = "__never__"
STATUS_RANK = {
    "working": 60, "requires_javascript": 50, "manual_review": 40, "blocked_by_challenge": 30,
    "blocked_by_robots": 25, "search_found_but_failed": 10, "no_search_found": 5,
}
QUERY_PARAMS = (
    "q", "query", "search", "searchterm", "searchTerm", "keyword", "keywords", "terms", "text", "s",
    "SearchString", "searchString", "search_query",
)
URL_TEMPLATES = (
    "/search?q={query}", "/search/?q={query}", "/search?query={query}", "/search/?query={query}",
    "/search?search={query}", "/search-results?q={query}", "/search-results?query={query}",
    "/site-search?q={query}", "/site-search?query={query}", "/apps/search/?q={query}",
    "/apps/search?term={query}", "/Search?search={query}", "/Search?query={query}",
    "/search/default.aspx?search={query}", "/site/default.aspx?PageType=6&SearchString={query}", "/?s={query}",
)
SEARCH_WORDS = ("search", "site search", "search our site", "find")
EXCLUDED_CONTEXT = (
    "login", "staff", "portal", "student", "parent", "payment", "calendar event search", "directory search",
    "employee search", "nutrition search", "athletics search", "registration",
)
NON_CONTENT = (
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".css", ".js", ".ico", ".zip", ".doc", ".docx", ".xls",
    ".xlsx", ".ppt", ".pptx",
)
SEARCH_LOOPS = ("/search", "search?", "query=", "searchstring=", "searchterm=")
PLATFORM_HOST = "search.edlio.com"
#: Provider and its markers, first match wins.
PROVIDERS = (
    ("Finalsite", ("finalsite", "fsresource")),
    ("Blackboard / Schoolwires", ("schoolwires", "blackboard")),
    ("Edlio", ("edlio",)),
    ("Apptegy", ("apptegy", "thrillshare")),
    ("ParentSquare", ("parentsquare",)),
    ("Campus Suite", ("campussuite",)),
    ("SchoolMessenger", ("schoolmessenger",)),
    ("WordPress", ("wp-content", "wordpress")),
    ("Drupal", ("drupal",)),
    ("Google Programmable Search", ("cse.google.com", "google custom search")),
    ("Algolia", ("algolia",)),
    ("SearchStax / Solr", ("searchstax", "solr")),
    ("SharePoint", ("sharepoint",)),
)
CUSTOM = "Custom"
CHALLENGE_STATUS_MARKS = ("cloudflare", "cf-chl", "captcha", "checking your browser", "forbidden")
CHALLENGE_HOST_MARKS = ("captcha", "challenge", "cf-chl")
JAVASCRIPT_MARKS = ("search-results", "site search", "fssearch", "data-search")
#: Headers of an import by field, as patterns of their words; the first column that matches is the field's.
HEADERS = {
    "agency_name": r"(^| )agency name$",
    "agency_id_nces": r"^(?=.*agency id)(?=.*(nces|assigned))",
    "state": r"^((location|mailing) )?state abbr$",
    "agency_type": r"agency type",
    "enrollment": r"^(?=.*total (students|enrollment))(?=.*excludes? ae)",
    "website": r"^(?=.*web site)(?=.*url)|^(?=.*website)(?=.*(url|address))|^(website|web address)$",
}
#: Where no column matches the first pattern.
OTHER_HEADERS = {"state": r"^state name$|(^| )state$"}
REQUIRED_FIELDS = ("agency_name", "state", "agency_type", "website")
EXPORT_COLUMNS = (
    "run_id", "run_query", "district_id", "district_name", "state", "agency_type", "enrollment", "website",
    "result_rank", "url", "title", "content_type", "score", "snippet", "created_at",
)
# ---- end of fixed values

_s, _l, _i, _b, _d, _t = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType(), T.TimestampType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


DISTRICTS = _schema(
    id=_l, source_file=_s, source_row_number=_i, agency_id_nces=_s, agency_name=_s, state=_s, agency_type=_s,
    total_enrollment_excludes_ae=_i, website=_s, website_normalized=_s, has_searchable_website=_b,
    raw=T.MapType(_s, _s), created_at=_t, updated_at=_t,
)
RESULTS = _schema(
    search_run_id=_l, district_id=_l, district_name=_s, state=_s, agency_type=_s, total_enrollment_excludes_ae=_i,
    website=_s, result_rank=_i, url=_s, title=_s, content_type=_s, status_code=_i, search_source=_s, score=_d,
    snippet=_s, matched_terms=T.ArrayType(_s), created_at=_t,
)
RUNS = _schema(
    id=_l, query_text=_s, states=T.ArrayType(_s), agency_types=T.ArrayType(_s), min_enrollment=_i, max_enrollment=_i,
    max_districts=_i, max_pages_per_district=_i, search_method=_s, search_provider=_s, api_results_per_district=_i,
    follow_depth=_i, debug_logging=_b, debug_log_path=_s, status=_s, cancel_requested=_b,
    districts_matched=_l, districts_searched=_l, districts_failed=_l, started_at=_t, finished_at=_t, error_message=_s,
)
#: Of columns that came later, what they are in rows that are older.
RUN_DEFAULTS = {"search_method": "crawler", "follow_depth": 0, "cancel_requested": False, "debug_logging": False}
DISCOVERY_DEFAULTS = {"cancel_requested": False, "profiles_requires_javascript": 0}
PROFILES = _schema(
    id=_l, district_id=_l, website_normalized=_s, profile_status=_s, profile_type=_s, provider_guess=_s,
    search_url_template=_s, search_method=_s, query_param=_s, extra_params=T.MapType(_s, _s), same_domain_only=_b,
    requires_javascript=_b, uses_external_provider=_b, external_provider_host=_s, confidence=_d, test_query=_s,
    test_result_count=_i, test_success=_b, last_tested_at=_t, last_discovered_at=_t, error_message=_s,
)
PROFILE_TESTS = _schema(
    profile_id=_l, district_id=_l, test_query=_s, attempted_url=_s, status_code=_i, content_type=_s, result_count=_i,
    success=_b, confidence=_d, error_message=_s, created_at=_t,
)
EVENTS = _schema(ts=_t, run_id=_l, event=_s, fields=T.MapType(_s, _s))
