"""Queries over search-endpoint discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagequarry.operators import discovery as D
from pagequarry.plans.base import pages, query, sql_canonical, sql_host
from pagequarry.schemas import PROVIDERS, URL_TEMPLATES
from pagequarry.sources.tables import spread, table

#: Pages with a provider's marker in the page or in the host, which the corpus lacks.
_MARKED = """CASE page_id % 9 WHEN 0 THEN concat(html, '<script src="/WP-Content/a.js"></script>') WHEN 1 THEN concat(html, 'FSResource solr')
  WHEN 2 THEN concat(html, 'powered by thrillshare and edlio') ELSE html END"""
_AT = "CASE WHEN page_id % 9 = 3 THEN replace(url, 'example', 'algolia') ELSE url END"
_HOST = sql_host("u")
_M = "WITH m AS (SELECT page_id, lower(h) AS h, u FROM (SELECT page_id, {m} AS h, {a} AS u FROM pages))".format(m=_MARKED, a=_AT)


def _found(mark: str) -> str:
    return f"(contains(h, '{mark}') OR contains({_HOST}, '{mark}'))"


_CASES = " ".join(f"WHEN {' OR '.join(map(_found, marks))} THEN '{name}'" for name, marks in PROVIDERS)
_HITS = ", ".join(f"CASE WHEN {_found(m)} THEN '{name}:{m}' END" for name, marks in PROVIDERS for m in marks)


@query(f"{_M} SELECT page_id, CASE {_CASES} ELSE 'Custom' END AS provider FROM m")
def provider_guess(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", D.provider(F.expr(_MARKED), F.expr(_AT)).alias("provider"))


@query(f"{_M} SELECT page_id, array_to_string(list_filter([{_HITS}], lambda x: x IS NOT NULL), ',') AS marks FROM m")
def provider_hits(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", F.array_join(D.provider_marks(F.expr(_MARKED), F.expr(_AT)), ",").alias("marks"))


_STATUS = "CASE page_id % 4 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 200 END"
_PAGE = """CASE page_id % 5 WHEN 0 THEN concat(html, 'Checking your browser') WHEN 1 THEN concat(html, 'FSSearch') WHEN 2 THEN concat(html, 'page not found')
  WHEN 3 THEN concat(html, ' edlio ') ELSE html END"""
_ON = "CASE WHEN page_id % 7 = 0 THEN 'https://cloudflare.example.com/captcha' WHEN page_id % 7 = 1 THEN 'http://localhost/' ELSE url END"
_ANY = "(" + " OR ".join(_found(m) for _, marks in PROVIDERS for m in marks) + ")"


@query(
    f"""WITH m AS (SELECT page_id, replace(lower(p), 'ß', 'ss') AS h, u, s, strlen(p) AS size FROM (SELECT page_id, {_PAGE} AS p, {_ON} AS u, {_STATUS} AS s FROM pages))
    SELECT page_id, (coalesce(s IN (403, 429), false) AND (contains(h, 'cloudflare') OR contains(h, 'cf-chl') OR contains(h, 'captcha') OR contains(h, 'checking your browser')
      OR contains(h, 'forbidden'))) OR (contains({_HOST}, 'cloudflare') AND (contains(h, 'captcha') OR contains(h, 'challenge') OR contains(h, 'cf-chl'))) AS challenge,
    contains(h, 'search-results') OR contains(h, 'site search') OR contains(h, 'fssearch') OR contains(h, 'data-search') AS javascript,
    NOT {_ANY} AND {_HOST} NOT IN ('localhost', '127.0.0.1') AND (size < 8000 OR (size < 30000 AND (contains(h, '404') OR contains(h, 'not found')))) AS tiny FROM m"""
)
def page_classify(spark: SparkSession, d: str) -> DataFrame:
    html, url = F.expr(_PAGE), F.expr(_ON)
    return pages(spark, d).select(
        "page_id",
        D.is_challenge(F.expr(_STATUS), html, url).alias("challenge"),
        D.suggests_javascript(html, F.lit("Custom")).alias("javascript"),
        D.is_tiny(html, url).alias("tiny"),
    )


_TEST = {
    "hint": "element_at(array(45, 30, 5, 15, 0), CAST(l_partkey % 5 AS INT) + 1)",
    "status": "element_at(array(200, 301, 404, 500), CAST(l_suppkey % 4 AS INT) + 1)",
    "challenge": "l_orderkey % 13 = 0",
    "redirect": "l_orderkey % 7 = 0",
    "platform": "l_partkey % 5 = 0",
    "links": "CAST(l_partkey % 4 AS INT)",
    "same_org": "l_partkey % 4 > 0 AND l_orderkey % 3 > 0",
    "search_title": "l_suppkey % 3 = 0",
    "confirmed": "CASE WHEN l_partkey % 4 > 0 THEN l_linenumber % 3 ELSE 0 END",
    "blocked": "l_orderkey % 17 = 0",
}
_TEST_SQL = _TEST | {
    "hint": "[45, 30, 5, 15, 0][l_partkey % 5 + 1]",
    "status": "[200, 301, 404, 500][l_suppkey % 4 + 1]",
}
_POINTS = """hint + CASE WHEN ok THEN 30 ELSE 0 END - CASE WHEN challenge THEN 50 ELSE 0 END - CASE WHEN ok AND redirect AND NOT platform THEN 50 ELSE 0 END
  + CASE WHEN ok AND links > 0 THEN 20 ELSE 0 END + CASE WHEN ok AND links > 1 THEN 10 ELSE 0 END + CASE WHEN ok AND same_org THEN 20 ELSE 0 END
  + CASE WHEN ok AND NOT platform AND NOT challenge AND search_title THEN 10 ELSE 0 END + CASE WHEN ok AND confirmed > 0 THEN 30 ELSE 0 END
  - CASE WHEN NOT blocked AND status >= 400 THEN 50 ELSE 0 END - CASE WHEN links = 0 THEN 30 ELSE 0 END"""


@query(
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, {", ".join(f"{v} AS {k}" for k, v in _TEST_SQL.items())} FROM lineitem),
    p AS (SELECT *, status < 400 AND NOT blocked AS ok FROM t), c AS (SELECT *, greatest(0.0, least(100.0, ({_POINTS})::DOUBLE))::DOUBLE AS confidence FROM p)
    SELECT l_orderkey, l_linenumber, confidence, CASE WHEN blocked THEN 'blocked_by_robots' WHEN challenge THEN 'blocked_by_challenge'
    WHEN links = 0 AND redirect THEN 'requires_javascript' WHEN confirmed > 0 AND confidence >= 70 THEN 'working' WHEN confidence >= 40 THEN 'manual_review'
    ELSE 'search_found_but_failed' END AS profile_status FROM c"""
)
def confidence(spark: SparkSession, d: str) -> DataFrame:
    c = {k: F.expr(v) for k, v in _TEST.items()}
    points = D.confidence(c)
    javascript = (c["links"] == 0) & c["redirect"]
    status = D.status(points, c["confirmed"], c["blocked"], c["challenge"], javascript)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", points.alias("confidence"), status.alias("profile_status"))


_SCRIPT = """concat('<script>window.edlio.websiteId = "W', c_custkey, '"; var x = {"DistrictWebsiteId": "', CASE c_custkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '' ELSE concat('D', c_custkey) END,
  '"};', CASE WHEN c_custkey % 4 = 0 THEN ' window.edlio.searchDomain = ''https://s.example.org/'';' ELSE '' END, '</script>')"""


@query(
    """WITH i AS (SELECT c_custkey, CASE WHEN c_custkey % 3 IN (0, 1) THEN 'W' || c_custkey ELSE 'D' || c_custkey END AS identifier,
    CASE WHEN c_custkey % 4 = 0 THEN 'https://s.example.org/' ELSE 'https://search.edlio.com/' END AS domain FROM customer)
    SELECT c_custkey, identifier, domain || identifier || '/search?offset=0&boostWebsiteId=W' || c_custkey || '&q={query}' AS template FROM i"""
)
def regex_config(spark: SparkSession, d: str) -> DataFrame:
    config = D.platform_config(F.expr(_SCRIPT))
    return table(spark, d, "customer").select("c_custkey", config["identifier"].alias("identifier"), D.platform_template(config).alias("template"))


_FORM = """concat('<form action="', CASE c_custkey % 5 WHEN 0 THEN '/find' WHEN 1 THEN 'https://other.net/s' ELSE '' END, '"', CASE WHEN c_custkey % 3 = 0 THEN ' method=post' ELSE '' END,
  CASE WHEN c_custkey % 7 = 0 THEN ' id="staff-portal"' ELSE '' END, '><input type=hidden name=site value="', c_custkey, '"><input name=other><input type=search name=',
  CASE WHEN c_custkey % 2 = 0 THEN 'q' ELSE '"" placeholder="Search our site"' END, '><button>Go</button></form>')"""


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'html_post_form' ELSE 'html_get_form' END AS profile_type, 'q' AS query_param,
    'https://d' || c_custkey || '.org/' || CASE WHEN c_custkey % 5 = 0 THEN 'find' ELSE 'home' END || '?site=' || c_custkey || '&q={query}' AS search_url_template,
    CAST(CASE WHEN c_custkey % 3 = 0 THEN 5 ELSE 30 END AS INT) AS score_hint FROM customer WHERE c_custkey % 5 <> 1 AND c_custkey % 7 <> 0"""
)
def form_candidates(spark: SparkSession, d: str) -> DataFrame:
    base = F.concat(F.lit("https://d"), F.col("c_custkey").cast("string"), F.lit(".org/"))
    site = spread(table(spark, d, "customer").select("c_custkey")).select("c_custkey", base.alias("base"), F.concat(base, F.lit("home")).alias("url"), F.expr(_FORM).alias("html"))
    found = D.form_candidates(site)
    key = F.regexp_extract("base", "d([0-9]+)", 1).cast("long").alias("c_custkey")
    return found.select(key, "profile_type", "query_param", "search_url_template", "score_hint")


_ANCHORS = """concat('<p><a href="/search?q=1&x=2">Search</a> <a href="/find-us">find us</a> <a href="/staff-search">Staff search</a> <a href="mailto:search@x.org">search</a>',
  '<a title="Site Search" href="https://other.net/search">x</a><a href="/plain', c_custkey, '">plain</a></p>')"""


@query(
    """SELECT c_custkey, CAST(seq AS INT) AS seq, 'https://d' || c_custkey || '.org' || path AS url, kind AS profile_type, param AS query_param, CAST(hint AS INT) AS score_hint
    FROM customer, (VALUES (0, '/search?q=1&x=2', 'url_template', 'q', 15), (1, '/find-us', 'search_page_link', NULL, 5)) v(seq, path, kind, param, hint)"""
)
def link_candidates(spark: SparkSession, d: str) -> DataFrame:
    base = F.concat(F.lit("https://d"), F.col("c_custkey").cast("string"), F.lit(".org/"))
    site = spread(table(spark, d, "customer").select("c_custkey")).select(base.alias("base"), base.alias("url"), F.expr(_ANCHORS).alias("html"))
    key = F.regexp_extract("base", "d([0-9]+)", 1).cast("long").alias("c_custkey")
    return D.link_candidates(site).select(key, "seq", "url", "profile_type", "query_param", "score_hint")


_VALUES = ", ".join(f"({i}, '{t}', '{t.rsplit('{query}', 1)[0].rstrip('=').rpartition('?')[2].rpartition('&')[2]}')" for i, t in enumerate(URL_TEMPLATES))


@query(
    f"""SELECT s_suppkey, CAST(seq AS INT) AS seq, param AS query_param, 'https://s' || s_suppkey || '.org' || t AS search_url_template
    FROM supplier, (VALUES {_VALUES}) v(seq, t, param)"""
)
def common_templates(spark: SparkSession, d: str) -> DataFrame:
    base = F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".org"))
    found = D.common_templates(spark, table(spark, d, "supplier").select(base.alias("base")))
    key = F.regexp_extract("base", "s([0-9]+)[.]org", 1).cast("long").alias("s_suppkey")
    return found.select(key, "seq", "query_param", "search_url_template")


_TEMPLATE = "CASE WHEN page_id % 2 = 0 THEN 'https://Search.Edlio.com/x/search?q={query}' ELSE url END"


@query(
    f"""SELECT page_id, (page_id % 3 = 0 AND page_id % 2 = 0) OR page_id % 5 = 0 AS platform, {sql_canonical('url')} AS url FROM pages"""
)
def platform_route(spark: SparkSession, d: str) -> DataFrame:
    from pagequarry.functions.urls import canonical

    name = F.when(F.col("page_id") % 3 == 0, "Edlio").otherwise("Custom")
    format_ = F.when(F.col("page_id") % 5 == 0, "edlio_json")
    return pages(spark, d).select("page_id", D.is_platform(name, F.expr(_TEMPLATE), format_).alias("platform"), canonical(F.col("url")).alias("url"))
