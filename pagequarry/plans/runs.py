"""Queries that run whole operators: runs by method, a crawl over the pages' links, discovery, API answers, sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagequarry.functions import urls as U
from pagequarry.operators import profiles as P
from pagequarry.operators import ranking as R
from pagequarry.operators import runs as RUN
from pagequarry.operators import search as S
from pagequarry.plans.base import PARSED, pages, query, sql_canonical, sql_core, sql_score
from pagequarry.plans.reports import db_statistics
from pagequarry.sources import crawl_rules
from pagequarry.sources.tables import spread, stored, table

PHRASE = "the"

#: Pages with their host, their place in it by page_id, and their score.
_PAGES = f"""{PARSED}, s AS (SELECT page_id, url, title, {sql_core('url')} AS host, {sql_score(PHRASE)} AS score,
  row_number() OVER (PARTITION BY {sql_core('url')} ORDER BY page_id) AS place FROM b)"""


def _hosts(p: DataFrame) -> DataFrame:
    """The hosts of the pages as organisations; an id is the least page_id."""
    h = p.groupBy(U.core_host(F.col("url")).alias("host")).agg(F.min("page_id").alias("id"))
    return h.select(
        "id", F.col("host").alias("agency_name"), F.lit("OR").alias("state"), F.lit("Regular").alias("agency_type"), F.lit(1).alias("enrollment"),
        F.concat(F.lit("https://"), "host").alias("website"), F.lit(True).alias("searchable"),
    )


def _answers(p: DataFrame) -> DataFrame:
    """What a web-search API might say: a host's pages in order, if most of its pages are under https; else no JSON."""
    host = U.core_host(F.col("url"))
    item = F.struct(F.col("page_id").alias("n"), F.struct("url", F.concat(F.lit("<b>Page</b> "), F.col("page_id").cast("string")).alias("title")).alias("r"))
    each = p.groupBy(host.alias("host")).agg(F.min("page_id").alias("id"), F.array_sort(F.collect_list(item)).alias("items"), F.count_if(F.col("url").startswith("https:")).alias("secure"))
    said = F.to_json(F.struct(F.struct(F.transform("items", lambda x: x["r"]).alias("results")).alias("web")))
    return each.select("id", F.when(F.col("secure") > F.size("items") / 2, said).otherwise("[broken").alias("json"))


_RANKED = "row_number() OVER (PARTITION BY host ORDER BY score DESC, {}) AS result_rank"


@query(
    f"""WITH {_PAGES}, o AS (SELECT host, count(*) FILTER (url LIKE 'https:%') > count(*) / 2 AS answered FROM s GROUP BY 1),
    c AS (SELECT 'crawler' AS method, host, url, score, 'crawler' AS search_source, {_RANKED.format('page_id')} FROM s WHERE score IS NOT NULL),
    u AS (SELECT host, {sql_canonical('url')} AS url, min(place) AS place, max(score) AS score FROM s GROUP BY ALL),
    a AS (SELECT 'brave' AS method, host, url, CASE WHEN score IS NULL THEN greatest(5.0, 55.0 - place) ELSE score + 20 END AS score,
      CASE WHEN score IS NULL THEN 'brave' ELSE 'brave+fetch' END AS search_source, place FROM u JOIN o USING (host) WHERE answered AND place <= 10),
    b2 AS (SELECT method, host, url, score, search_source, {_RANKED.format('place')} FROM a),
    x AS (SELECT * FROM c UNION ALL SELECT * FROM b2 UNION ALL SELECT 'hybrid', host, url, score, search_source, result_rank FROM b2
      UNION ALL SELECT 'hybrid', host, url, score, search_source, result_rank FROM c WHERE host NOT IN (SELECT host FROM b2))
    SELECT method, host, url, score::DOUBLE AS score, search_source, result_rank::INT AS result_rank FROM x WHERE result_rank <= 5"""
)
def run_methods(spark: SparkSession, d: str) -> DataFrame:
    """The hits of a run by each method that needs no profile, for all hosts."""
    p = pages(spark, d).select("page_id", "url", "html", F.col("page_id").alias("seq"))
    sites, sources = stored(_hosts(p), "sites"), RUN.Sources(answers=stored(_answers(p), "answers"))
    corpus = S.Corpus(stored(spread(p, S.SCORED, "page_id").drop("page_id"), "corpus"))
    found = RUN.found_by_each(("crawler", "brave", "hybrid"), sites, corpus, PHRASE, S.SearchSettings(), sources)
    return found.select("method", F.col("agency_name").alias("host"), "url", "score", "search_source", "result_rank")


@query(
    f"""WITH {_PAGES}, o AS (SELECT host, min(page_id) AS id, count(*) FILTER (url LIKE 'https:%') > count(*) / 2 AS answered, count(DISTINCT {sql_canonical('url')}) FILTER (place <= 10) AS n
      FROM s GROUP BY 1)
    SELECT id AS district_id, host AS district, CASE WHEN answered THEN least(n, 5) ELSE 0 END::BIGINT AS stored, NOT answered AS failed,
    CASE WHEN NOT answered THEN 'The API''s answer is no JSON.' END AS error FROM o"""
)
def run_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Each organisation of a run under the API method: how many hits it has stored, or why it failed."""
    p = pages(spark, d).select("page_id", "url", "html", F.col("page_id").alias("seq"))
    sites, sources = stored(_hosts(p), "sites"), RUN.Sources(answers=stored(_answers(p), "answers"))
    run = RUN.Run(1, PHRASE, search_method="brave", max_districts=None)
    results = stored(RUN.results_of(run, sites, p.drop("page_id"), sources=sources), "results")
    return RUN.outcomes(run, sites, results, sources).drop("page_errors")


# ---------------------------------------------------------------- a crawl over links that pages hold
#: The corpus's links lead nowhere in it and would take the crawl's page cap. Under one scheme, each page gets links, in their place, to the next three pages of its host: relative, absolute, and with dots.
_LINKED = """concat(replace(html, 'href=', 'data-to='), '<p><a href="', coalesce(p1, '#'), '">a</a> <a href=''', coalesce(p2, 'mailto:x'), '''>b</a> <a href=', coalesce(p3, '#'), '>c</a></p>')"""


def _linked(p: DataFrame) -> DataFrame:
    n = R.numbered(p.withColumn("host", U.core_host(F.col("url"))), ["host"], [F.col("page_id")], "place")
    n = n.withColumn("path", F.concat(U.path(F.col("url")), F.lit("?p="), F.col("page_id").cast("string"))).withColumn("url", F.concat(F.lit("https://"), "host", "path"))
    after = n
    for k, form in ((1, "path"), (2, "concat('./../..', path)"), (3, "url")):
        nxt = n.select("host", (F.col("place") - k).alias("place"), F.expr(form).alias(f"p{k}"))
        after = after.join(nxt, ["host", "place"], "left")
    return after.select("page_id", "url", F.expr(_LINKED).alias("html"), "host", "place")


@query(
    f"""WITH {_PAGES}, t AS (SELECT host, page_id, score::DOUBLE AS score, (row_number() OVER (PARTITION BY host ORDER BY score DESC, place))::INT AS result_rank
    FROM s WHERE place <= 100 AND score IS NOT NULL) SELECT * FROM t WHERE result_rank <= 5"""
)
def crawl_search(spark: SparkSession, d: str) -> DataFrame:
    """The five best pages that a crawl from each host's first page reaches by the links in the pages, up to 100 pages a host."""
    p = stored(_linked(pages(spark, d)), "linked")
    first = p.where("place = 1").select(F.col("page_id").alias("id"), F.col("url").alias("website"), F.col("host").alias("agency_name"))
    names = p.select("page_id", U.canonical(F.col("url")).alias("url"))
    found = S.crawl_corpus(first, p.select("url", "html"), PHRASE)
    return found.join(names, "url").select(F.col("agency_name").alias("host"), "page_id", "score", "result_rank")


# ---------------------------------------------------------------- discovery
_FORM = """<title>Home</title><form action="/zz/find"><input type="hidden" name="site" value="1"><input type="search" name="needle"></form>"""
_PAD = "<!-- " + "x" * 9000 + " -->"


@query(
    f"""WITH {_PAGES} SELECT min(page_id) AS district_id, CASE WHEN bool_or(place = 1 AND score IS NOT NULL) THEN 'working' ELSE 'manual_review' END AS profile_status,
    'html_get_form' AS profile_type, 'needle' AS query_param, 'https://' || host || '/zz/find?site=1&needle={{query}}' AS search_url_template,
    100.0::DOUBLE AS confidence, 1 AS test_result_count, bool_or(place = 1 AND score IS NOT NULL) AS test_success FROM s GROUP BY host"""
)
def discover_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Search profiles of all hosts, each given a homepage with a form and a results page that links the host's first page."""
    p = R.numbered(pages(spark, d).withColumn("host", U.core_host(F.col("url"))), ["host"], [F.col("page_id")], "place")
    sites = stored(_hosts(p), "sites")
    homes = sites.select(F.col("website").alias("url"), F.lit(_FORM + _PAD).alias("html"))
    shown = p.where("place = 1").select(
        F.concat(F.lit("https://"), "host", F.lit(f"/zz/find?site=1&needle={PHRASE}")).alias("url"),
        F.concat(F.lit("<h1>Search results</h1><ul class=results><li><a href='"), U.path(F.col("url")), F.lit("'>first</a></ul>")).alias("html"),
    )
    first = p.where("place = 1").select(F.concat(F.lit("https://"), "host", U.path(F.col("url"))).alias("url"), "html")
    corpus = stored(homes.unionByName(shown).unionByName(first), "corpus")
    found = P.discover(sites, corpus, PHRASE)
    return found.select("district_id", "profile_status", "profile_type", "query_param", "search_url_template", "confidence", "test_result_count", "test_success")


# ---------------------------------------------------------------- API answers, sitemaps, states
@query(
    f"""WITH {_PAGES}, o AS (SELECT host, min(page_id) AS id, count(*) FILTER (url LIKE 'https:%') > count(*) / 2 AS answered FROM s GROUP BY 1)
    SELECT id, {sql_canonical('url')} AS url, 'Page ' || page_id AS title, place::INT AS rank, greatest(5.0, 55.0 - place)::DOUBLE AS score FROM s JOIN o USING (host) WHERE answered AND place <= 10"""
)
def api_results(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    asked = _answers(p).join(_hosts(p).select("id", F.col("website").alias("base")), "id")
    return S.api_hits(asked, 10).select("id", "url", "title", "rank", "score")


@query(
    f"""WITH s AS (SELECT min(page_id) AS page_id, {sql_core('url')} AS host, {sql_canonical('url')} AS url FROM pages GROUP BY ALL),
    r AS (SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY page_id) AS seq FROM s)
    SELECT 'https://' || host AS base, url, seq::INT AS seq FROM r WHERE seq <= 20"""
)
def sitemap_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 URLs of each host's sitemap, found through an index; one file of each host is broken and one link leads away."""
    p = pages(spark, d).withColumn("host", U.core_host(F.col("url")))
    base = F.concat(F.lit("https://"), "host")
    locs = F.array_sort(F.collect_list(F.struct("page_id", F.replace("url", F.lit("&"), F.lit("&amp;")).alias("u"))))
    entries = F.array_join(F.transform(locs, lambda x: F.concat(F.lit("<url><loc> "), x["u"], F.lit(" </loc></url>"))), "")
    leaf = F.concat(F.lit('<urlset xmlns="n"><url><loc>https://elsewhere.invalid/x</loc></url>'), entries, F.lit("</urlset>"))
    sites = p.groupBy("host").agg(leaf.alias("leaf")).select("*", base.alias("base"))
    index = F.concat(F.lit('<sitemapindex xmlns="n"><sitemap><loc>'), "base", F.lit("/broken.xml</loc></sitemap><sitemap><loc>"), "base", F.lit("/1.xml</loc></sitemap></sitemapindex>"))
    file = F.explode(F.array(*[F.struct(F.concat("base", F.lit(name)).alias("url"), body.alias("body")) for name, body in (("/sitemap.xml", index), ("/1.xml", F.col("leaf")), ("/broken.xml", F.lit("<a>")))]))
    files = stored(sites.select(file.alias("f")).select("f.*"), "sitemaps")
    seeds = sites.select("base", F.concat("base", F.lit("/sitemap.xml")).alias("url"))
    return crawl_rules.sitemap_urls(seeds, files, 20).select("base", "url", F.col("seq").cast("int").alias("seq"))


_STATE = "CASE WHEN c_custkey % 51 = 0 THEN 'DC' ELSE 'S' || c_custkey % 51 END"


@query(
    f"""WITH s AS (SELECT DISTINCT c_mktsegment, {_STATE} AS state FROM customer), n AS (SELECT c_mktsegment, count(*) AS states, bool_or(state = 'DC') AS dc FROM s GROUP BY 1)
    SELECT c_mktsegment AS segment, states, CASE WHEN states = 51 AND dc THEN '50 + DC' ELSE states::VARCHAR END AS state_label FROM n"""
)
def state_labels(spark: SparkSession, d: str) -> DataFrame:
    """The number of states of each segment, as the report shows it: 51 with DC among them is 50 + DC."""
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.expr(_STATE.replace("'S' || c_custkey % 51", "concat('S', c_custkey % 51)")).alias("state"), F.lit("x").alias("agency_type"), F.lit(True).alias("searchable"))
    return db_statistics(rows, "segment").select("segment", "states", "state_label")
