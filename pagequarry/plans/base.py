"""Registration of queries, and the search domain seen in the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagequarry.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function under its name, with the SQL of the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- organisations, profiles, runs, results
def districts(spark: SparkSession, d: str) -> DataFrame:
    """customer x nation as organisations."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("agency_name"),
        F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("agency_id_nces"),
        F.col("n_name").alias("state"),
        F.col("c_mktsegment").alias("agency_type"),
        F.col("c_acctbal").cast("int").alias("enrollment"),
        F.concat(F.lit("www.d"), F.col("c_custkey").cast("string"), F.lit(".example.org")).alias("website"),
        F.concat(F.lit("https://www.d"), F.col("c_custkey").cast("string"), F.lit(".example.org")).alias("website_normalized"),
        (F.col("c_acctbal") >= 0).alias("searchable"),
    )


DISTRICTS = """d AS (SELECT c_custkey AS id, c_name AS agency_name, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS agency_id_nces,
  n_name AS state, c_mktsegment AS agency_type, CAST(trunc(c_acctbal) AS INT) AS enrollment,
  'www.d' || c_custkey || '.example.org' AS website, 'https://www.d' || c_custkey || '.example.org' AS website_normalized,
  c_acctbal >= 0 AS searchable FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

_STATUS = {"purchase": "working", "signup": "manual_review", "click": "requires_javascript", "view": "no_search_found"}


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """events as the history of search profiles."""
    status = F.lit("error")
    for event, name in _STATUS.items():
        status = F.when(F.col("event_type") == event, name).otherwise(status)
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("district_id"),
        status.alias("profile_status"),
        F.concat(F.lit("P"), F.get_json_object("props", "$.k")).alias("provider_guess"),
        F.col("value").alias("confidence"),
        F.col("ts").alias("last_tested_at"),
        F.when(F.col("event_id") % 7 == 0, "POST").otherwise("GET").alias("search_method"),
        F.when(F.col("event_id") % 11 != 0, F.lit("https://x.example.org/search?q={query}")).alias("search_url_template"),
    )


PROFILES = """p AS (SELECT event_id AS id, user_id AS district_id,
  CASE event_type WHEN 'purchase' THEN 'working' WHEN 'signup' THEN 'manual_review' WHEN 'click' THEN 'requires_javascript'
    WHEN 'view' THEN 'no_search_found' ELSE 'error' END AS profile_status,
  'P' || json_extract_string(props, '$.k') AS provider_guess, value AS confidence, ts AS last_tested_at,
  CASE WHEN event_id % 7 = 0 THEN 'POST' ELSE 'GET' END AS search_method,
  CASE WHEN event_id % 11 <> 0 THEN 'https://x.example.org/search?q={query}' END AS search_url_template FROM events)"""

LATEST = """l AS (SELECT p.* FROM p JOIN (SELECT district_id, max(id) AS id FROM p GROUP BY district_id) m ON m.id = p.id)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("queued").alias("status"),
        F.col("o_orderpriority").alias("query_text"),
        F.col("o_orderdate").alias("started_at"),
        (F.col("o_custkey") % 40).alias("matched"),
        F.when(F.col("o_orderkey") % 3 != 0, F.lit(25)).alias("cap"),
    )


RUNS = """r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'queued' END AS status,
  o_orderpriority AS query_text, o_orderdate AS started_at, o_custkey % 40 AS matched, CASE WHEN o_orderkey % 3 <> 0 THEN 25 END AS cap
  FROM orders)"""


def results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("search_run_id"),
        F.col("l_linenumber").alias("result_rank"),
        F.col("l_suppkey").alias("district_id"),
        F.col("l_partkey").alias("page_id"),
        F.col("l_extendedprice").alias("score"),
    )


RESULTS = """h AS (SELECT l_orderkey AS search_run_id, l_linenumber AS result_rank, l_suppkey AS district_id, l_partkey AS page_id,
  l_extendedprice AS score FROM lineitem)"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


# ---------------------------------------------------------------- the same expressions in DuckDB's SQL
URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def sql_part(x: str, n: int) -> str:
    return f"regexp_extract({x}, '{URL_RE}', {n})"


def sql_host(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({sql_part(x, 2)}), '^.*@', ''), ':[0-9]*$', '')"


def sql_core(x: str) -> str:
    return rf"regexp_replace(regexp_replace({sql_host(x)}, '^\.+|\.+$', '', 'g'), '^www\.', '')"


def sql_canonical(x: str) -> str:
    path = f"regexp_replace(regexp_replace({sql_part(x, 3)}, ';[^/]*$', ''), '/+$', '')"
    scheme, place, q = sql_part(x, 1), sql_part(x, 2), sql_part(x, 4)
    return f"""concat(CASE WHEN {scheme} <> '' THEN lower({scheme}) || ':' ELSE '' END,
      CASE WHEN {place} <> '' THEN '//' || lower({place}) ELSE '' END, {path}, CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"""


def sql_same_org(u: str, b: str) -> str:
    h, c = sql_core(u), sql_core(b)
    return f"({h} <> '' AND {c} <> '' AND ({h} = {c} OR ends_with({h}, '.' || {c})))"


def sql_decode(x: str) -> str:
    return f"""replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"""


def sql_collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x0B\x85\xA0]+', ' ', 'g'))"


def sql_fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def sql_runs(x: str) -> str:
    """Text runs between tags, trimmed, empty ones dropped, joined by a space."""
    return rf"array_to_string(list_filter(list_transform(string_split_regex({x}, '<[^>]*>'), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: y <> ''), ' ')"


_VISIBLE = "html"
for _tag in ("script", "style", "noscript", "svg"):
    _VISIBLE = rf"regexp_replace({_VISIBLE}, '<{_tag}\b[^>]*>.*?</{_tag}\s*>', '', 'gis')"
VISIBLE = rf"regexp_replace({_VISIBLE}, '<!--.*?-->', '', 'gs')"

#: Pages with their visible markup, title, headings and body.
PARSED = rf"""v AS (SELECT page_id, url, html, {VISIBLE} AS vis FROM pages),
b AS (SELECT page_id, url, html, vis,
  {sql_collapse(sql_decode(r"regexp_replace(regexp_extract(html, '<title\b[^>]*>(.*?)</title\s*>', 1, 'is'), '<[^>]*>', '', 'g')"))} AS title,
  list_transform(regexp_extract_all(vis, '<h[123]\b[^>]*>(.*?)</h[123]\s*>', 1, 'is'),
    lambda x: {sql_decode(sql_runs('x'))}) AS headings,
  {sql_decode(sql_runs('vis'))} AS body
  FROM v)"""

#: Links of each page: page_id, url, seq (from 0), href as written.
LINKS = r"""k AS (SELECT page_id, url, unnest(range(0, len(hs))) AS seq, unnest(hs) AS href FROM (SELECT page_id, url, list_filter(
  list_transform(regexp_extract_all(vis, '<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1, 'is'), lambda x: trim(x)),
  lambda x: x <> '' AND NOT regexp_matches(x, '^(#|mailto:|tel:|javascript:)')) AS hs FROM v))"""
#: All links of the corpus begin with one slash.
LINK_URL = rf"concat({sql_part('url', 1)}, '://', {sql_part('url', 2)}, {sql_decode('href')})"


def sql_score(phrase: str) -> str:
    """Score over PARSED's columns, null where nothing matches."""
    q = phrase.lower().replace("ß", "ss").replace("'", "''")
    t, h, b = sql_fold("title"), sql_fold("array_to_string(headings, ' ')"), sql_fold("body")
    path = sql_part("url", 3)
    occ = f"((length({b}) - length(replace({b}, '{q}', ''))) // {len(q)})"
    return f"""CASE WHEN contains({t}, '{q}') OR contains({h}, '{q}') OR contains({b}, '{q}') THEN
    (CASE WHEN contains({t}, '{q}') THEN 50.0 ELSE 0.0 END + CASE WHEN contains({h}, '{q}') THEN 25.0 ELSE 0.0 END
    + 10.0 * least({occ}, 10)
    + CASE WHEN len(list_filter(string_split({path}, '/'), lambda x: x <> '')) <= 1 THEN 5.0 ELSE 0.0 END
    + CASE WHEN {path} IN ('', '/') THEN 5.0 ELSE 0.0 END)::DOUBLE END"""


def sql_snippet(x: str, phrase: str, around: int = 200) -> str:
    q = phrase.lower().replace("ß", "ss").replace("'", "''")
    at = f"(strpos({sql_fold(x)}, '{q}') - 1)"
    start, end = f"greatest({at} - {around}, 0)", f"least({at} + {len(phrase) + around}, length({x}))"
    cut = sql_collapse(f"""concat(CASE WHEN {start} > 0 THEN '...' ELSE '' END, substring({x}, {start} + 1, {end} - {start}),
    CASE WHEN {end} < length({x}) THEN '...' ELSE '' END)""")
    return f"""CASE WHEN {at} < 0 THEN {sql_collapse(f"substring({x}, 1, 400)")} ELSE {cut} END"""
