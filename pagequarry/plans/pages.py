"""Queries over pages, texts and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagequarry.functions import html as H
from pagequarry.functions import text as X
from pagequarry.functions import urls as U
from pagequarry.operators import crawl as C
from pagequarry.operators import ranking as R
from pagequarry.operators import search as S
from pagequarry.plans.base import (
    LINK_URL,
    LINKS,
    PARSED,
    VISIBLE,
    pages,
    query,
    results,
    sql_canonical,
    sql_collapse,
    sql_core,
    sql_decode,
    sql_host,
    sql_fold,
    sql_part,
    sql_same_org,
    sql_score,
    sql_snippet,
)
from pagequarry.sources.tables import stored
from pagequarry.sources import crawl_rules, fetch
from pagequarry.sources.tables import table

PHRASE = "the"


@query(f"WITH {PARSED} SELECT page_id, title, array_to_string(headings, '|') AS headings, body FROM b")
def page_parse(spark: SparkSession, d: str) -> DataFrame:
    p = S.parsed(pages(spark, d))
    return p.select("page_id", "title", F.array_join("headings", "|").alias("headings"), "body")


@query(f"WITH {PARSED}, s AS (SELECT page_id, {sql_core('url')} AS host, {sql_score(PHRASE)} AS score FROM b) SELECT * FROM s WHERE score IS NOT NULL")
def page_score(spark: SparkSession, d: str) -> DataFrame:
    found = S.hits(pages(spark, d), PHRASE)
    return found.select("page_id", U.core_host(F.col("url")).alias("host"), "score")


@query(
    f"""WITH {PARSED}, s AS (SELECT page_id, {sql_core('url')} AS host, {sql_score(PHRASE)} AS score, {sql_snippet('body', PHRASE)} AS snippet FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) AS result_rank FROM s WHERE score IS NOT NULL)
    SELECT page_id, host, score, result_rank::INT AS result_rank, snippet FROM r WHERE result_rank <= 5"""
)
def topk_pages(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the five best pages of each site, with a snippet."""
    found = S.hits(pages(spark, d), PHRASE).withColumn("host", U.core_host(F.col("url")))
    return S.best_hits(found, ["host"], 5, "page_id").select("page_id", "host", "score", "result_rank", "snippet")


@query(
    """SELECT district_id, search_run_id, line, score, result_rank FROM (SELECT l_suppkey AS district_id, l_orderkey AS search_run_id,
    l_linenumber AS line, l_extendedprice AS score,
    CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INT) AS result_rank
    FROM lineitem) WHERE result_rank <= 5"""
)
def topk_hits(spark: SparkSession, d: str) -> DataFrame:
    h = results(spark, d).withColumnRenamed("result_rank", "line")
    best = R.top_k(h, ["district_id"], [F.desc("score"), F.col("search_run_id"), F.col("line")], 5)
    return best.select("district_id", "search_run_id", "line", "score", "result_rank")


@query(f"SELECT doc_id, {sql_snippet('text', 'in der')} AS snippet FROM documents")
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.snippet(F.col("text"), "in der").alias("snippet"))


@query(f"SELECT doc_id, CAST((length({sql_fold('text')}) - length(replace({sql_fold('text')}, 'ss', ''))) // 2 AS INT) AS n FROM documents")
def casefold_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.occurrences(X.fold(F.col("text")), "ß").alias("n"))


@query(f"WITH v AS (SELECT page_id, url, {VISIBLE} AS vis FROM pages), {LINKS} SELECT page_id, CAST(seq AS INT) AS seq, {LINK_URL} AS link FROM k")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", F.posexplode(H.links(F.col("html"), F.col("url"))).alias("seq", "link"))


@query(
    """SELECT p_partkey, regexp_replace(replace(replace(replace(replace(replace(p_name || ' <a> & "b"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'),
    '''', '&#39;'), '(AR)', '<mark>\\1</mark>', 'gi') AS marked FROM part"""
)
def highlight(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("p_name", F.lit(' <a> & "b"'))
    return table(spark, d, "part").select("p_partkey", X.highlight(text, "AR").alias("marked"))


#: URLs with what the corpus lacks: ports, upper case, parameters, fragments, slashes at the end.
_ODD = """CASE page_id % 6 WHEN 0 THEN upper(substring(url, 1, 12)) || substring(url, 13) || '/' WHEN 1 THEN url || ';v=1#top'
  WHEN 2 THEN url || '?q=A&b=#x' WHEN 3 THEN url || '//' ELSE url END"""


def _odd(c: str = "url"):
    return F.expr(_ODD.replace("url", c))


@query(f"WITH o AS (SELECT page_id, {_ODD} AS u FROM pages) SELECT page_id, {sql_canonical('u')} AS canonical FROM o")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.canonical(_odd()).alias("canonical"))


_BASE = """CASE page_id % 4 WHEN 0 THEN 'https://www.example.com/' WHEN 1 THEN concat('https://', regexp_extract(url, '//([^/]*)', 1))
  WHEN 2 THEN 'https://example.org' ELSE '' END"""


@query(f"WITH o AS (SELECT page_id, url, {_BASE} AS base FROM pages) SELECT page_id, {sql_same_org('url', 'base')} AS same FROM o")
def same_org(spark: SparkSession, d: str) -> DataFrame:
    o = pages(spark, d).select("page_id", "url", F.expr(_BASE).alias("base"))
    return o.select("page_id", U.same_org(F.col("url"), F.col("base")).alias("same"))


_LINK = """CASE page_id % 7 WHEN 0 THEN url || '.PDF' WHEN 1 THEN url || '.docx' WHEN 2 THEN concat(regexp_extract(url, '^[a-z]+://[^/]*', 0), '/Search?q=a')
  WHEN 3 THEN 'ftp://example.com/a' WHEN 4 THEN url || '/' WHEN 5 THEN '' ELSE url || '/more' END"""
_FOLDED = sql_fold("u")


@query(
    f"""WITH o AS (SELECT page_id, url, {_LINK} AS u FROM pages) SELECT page_id, (u <> '' AND lower({sql_part('u', 1)}) IN ('http', 'https')
    AND NOT regexp_matches(lower({sql_part('u', 3)}), '\\.(jpg|jpeg|png|gif|webp|svg|css|js|ico|zip|doc|docx|xls|xlsx|ppt|pptx)$')
    AND {sql_canonical('u')} <> {sql_canonical('url')}
    AND NOT (contains({_FOLDED}, '/search') OR contains({_FOLDED}, 'search?') OR contains({_FOLDED}, 'query=') OR contains({_FOLDED}, 'searchstring=')
      OR contains({_FOLDED}, 'searchterm=')) AND {sql_same_org('u', 'url')}) AS valid FROM o"""
)
def valid_result_url(spark: SparkSession, d: str) -> DataFrame:
    o = pages(spark, d).select("page_id", "url", F.expr(_LINK).alias("u"))
    return o.select("page_id", U.valid_result(F.col("u"), F.col("url"), F.col("url")).alias("valid"))


_PLAIN = "CASE page_id % 5 WHEN 0 THEN 'http://127.0.0.1:5000/a' WHEN 1 THEN 'HTTP://localhost/' ELSE url END"


@query(
    f"""WITH o AS (SELECT page_id, {_PLAIN} AS u FROM pages) SELECT page_id, CASE WHEN lower({sql_part('u', 1)}) = 'http'
    AND {sql_host('u')} NOT IN ('localhost', '127.0.0.1', '::1') THEN 'https:' || substring(u, 6) ELSE u END AS secure FROM o"""
)
def prefer_https(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.prefer_https(F.expr(_PLAIN)).alias("secure"))


_NAMED = "CASE page_id % 4 WHEN 0 THEN url || '/a-b_c.pdf' WHEN 1 THEN regexp_extract(url, '^[a-z]+://[^/]*', 0) WHEN 2 THEN 'x_y-z' ELSE url || '/' END"


@query(
    f"""WITH o AS (SELECT page_id, {_NAMED} AS u FROM pages), t AS (SELECT page_id, u,
    regexp_extract({sql_part('u', 3)}, '([^/]*)$', 1) AS last FROM o)
    SELECT page_id, translate(CASE WHEN last <> '' THEN last WHEN {sql_host('u')} <> '' THEN {sql_host('u')} ELSE u END, '-_', '  ') AS title FROM t"""
)
def filename_title(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.filename_title(F.expr(_NAMED)).alias("title"))


_ASKED = "CASE c_custkey % 3 WHEN 0 THEN concat(c_name, ' *~ & é') WHEN 1 THEN concat('  ', c_mktsegment, '/x ') ELSE c_name END"


@query(f"SELECT c_custkey, replace('https://x.org/search?q={{query}}', '{{query}}', replace(url_encode(trim({_ASKED})), '%20', '+')) AS url FROM customer")
def search_url(spark: SparkSession, d: str) -> DataFrame:
    template = F.lit("https://x.org/search?q={query}")
    return table(spark, d, "customer").select("c_custkey", U.search_url(template, F.expr(_ASKED)).alias("url"))


@query(
    """SELECT page_id, concat(split_part(url, '#', 1), CASE WHEN contains(split_part(url, '#', 1), '?') THEN '&' ELSE '?' END, '_probe=', page_id,
    CASE WHEN contains(url, '#') THEN substring(url, strpos(url, '#')) ELSE '' END) AS url FROM pages"""
)
def cache_bust(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.cache_busted(F.col("url"), F.col("page_id")).alias("url"))


@query(
    f"""SELECT page_id, concat(CASE WHEN page_id % 3 = 0 THEN '"bus routes' ELSE '"bus routes"' END, ' site:', {sql_core('url')}) AS q FROM pages"""
)
def site_query(spark: SparkSession, d: str) -> DataFrame:
    asked = F.expr("CASE WHEN page_id % 3 = 0 THEN ' \"bus routes' ELSE 'bus routes ' END")
    return pages(spark, d).select("page_id", U.site_query(asked, F.col("url")).alias("q"))


_TYPE = "concat(' ', p_type, ' & ', p_brand, CASE WHEN p_partkey % 2 = 0 THEN ' (%)' ELSE '' END)"


@query(
    f"""SELECT p_partkey, CASE WHEN s = '' THEN 'unnamed' ELSE s END AS name FROM (SELECT p_partkey,
    regexp_replace(regexp_replace(replace(lower(trim({_TYPE})), '&', 'and'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s
    FROM (SELECT *, CASE WHEN p_partkey % 50 = 0 THEN '' ELSE {_TYPE} END AS x FROM part))"""
)
def snake_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.snake_case(F.expr(_TYPE)).alias("name"))


_LOC = """concat('<urlset xmlns="x">', CASE WHEN page_id % 9 = 0 THEN '' ELSE concat('<url><loc> ', url, ' </loc></url>') END,
  '<url><loc>https://b.org/', CAST(page_id AS STRING), '</loc></url></urlset>')"""


@query(
    """SELECT page_id, 'https://b.org/' || page_id AS loc FROM pages UNION ALL SELECT page_id, url FROM pages WHERE page_id % 9 <> 0"""
)
def xml_loc_extract(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", F.explode(crawl_rules.loc_values(F.expr(_LOC))).alias("loc"))


_KIND = "CASE page_id % 6 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/png' WHEN 3 THEN 'Text/Plain' WHEN 4 THEN NULL ELSE 'application/json' END"
_KIND_URL = "CASE WHEN page_id % 5 = 0 THEN concat(url, '.pdf') ELSE url END"
_IS_PDF = f"ends_with(lower({sql_part(_KIND_URL, 3)}), '.pdf')"


@query(
    f"""SELECT page_id, CASE WHEN coalesce(contains(lower({_KIND}), 'pdf'), false) OR {_IS_PDF} THEN 'application/pdf'
    WHEN coalesce({_KIND}, '') = '' OR contains(lower({_KIND}), 'html') OR contains(lower({_KIND}), 'text/plain') THEN 'text/html' END AS kind FROM pages"""
)
def content_type_gate(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", fetch.kind(F.expr(_KIND), F.expr(_KIND_URL)).alias("kind"))


@query(f"SELECT page_id, CAST(strlen(html) AS INT) AS bytes FROM pages WHERE strlen(html) <= CASE WHEN {_IS_PDF} THEN 4000 ELSE 2500 END")
def fetch_size_guard(spark: SparkSession, d: str) -> DataFrame:
    fits = fetch.within_cap(F.col("html"), F.lit("text/html"), F.expr(_KIND_URL), 2500, 4000)
    return pages(spark, d).where(fits).select("page_id", F.octet_length("html").alias("bytes"))


@query("SELECT o_orderkey, greatest(5.0, 55.0 - (o_orderkey % 70))::DOUBLE AS score FROM orders")
def api_rank_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", S.api_score(F.col("o_orderkey") % 70).alias("score"))


_SOURCE = """CASE l_orderkey % 5 WHEN 0 THEN 'brave+fetch' WHEN 1 THEN 'brave-follow' WHEN 2 THEN 'district_search+fetch' WHEN 3 THEN 'brave' ELSE 'crawler' END"""


@query(
    f"""SELECT l_orderkey, l_linenumber, CASE {_SOURCE} WHEN 'brave+fetch' THEN 20.0 WHEN 'brave-follow' THEN 8.0
    WHEN 'district_search+fetch' THEN greatest(0.0, 20.0 - (l_partkey % 30)) ELSE 0.0 END::DOUBLE AS bonus FROM lineitem"""
)
def source_bonus(spark: SparkSession, d: str) -> DataFrame:
    rank = F.col("l_partkey") % 30
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.bonus(F.expr(_SOURCE), rank).alias("bonus"))


@query(
    """SELECT l_suppkey AS district_id, l_partkey AS page_id, arg_min(l_extendedprice, (l_orderkey * 10 + l_linenumber)) AS score,
    min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY ALL"""
)
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    h = results(spark, d).withColumn("seq", F.col("search_run_id") * 10 + F.col("result_rank"))
    return R.first_per_key(h, ["district_id", "page_id"], [F.col("seq")]).select("district_id", "page_id", "score", "seq")


_FIRST = "SELECT page_id, 'brave' AS search_source, greatest(5.0, 55.0 - page_id % 20)::DOUBLE AS score FROM pages"


@query(
    f"""WITH {PARSED}, f AS (SELECT page_id, {sql_score(PHRASE)} + 20 AS score FROM b),
    a AS ({_FIRST}) SELECT a.page_id, CASE WHEN f.score IS NOT NULL THEN 'brave+fetch' ELSE a.search_source END AS search_source,
    coalesce(f.score, a.score) AS score FROM a LEFT JOIN f ON a.page_id = f.page_id AND f.score IS NOT NULL"""
)
def overwrite_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every page as an API hit, replaced where the page itself matches."""
    p = pages(spark, d)
    api = p.select("page_id", F.lit("brave").alias("search_source"), S.api_score(F.col("page_id") % 20).alias("score"))
    source = F.lit("brave+fetch")
    fetched = S.hits(p, PHRASE).select("page_id", source.alias("search_source"), (F.col("score") + S.bonus(source, F.lit(1))).alias("score"))
    return S.with_confirmed(api, fetched, ["page_id"])


@query(
    f"""WITH {PARSED}, a AS (SELECT page_id, {sql_core('url')} AS host, url, {sql_score(PHRASE)} AS score, page_id % 15 + 1 AS rank FROM b)
    SELECT page_id, host, score + greatest(0.0, 20.0 - rank) AS score FROM a WHERE score IS NOT NULL"""
)
def confirm_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a site's own search, kept only where the page itself matches."""
    p = pages(spark, d).withColumn("rank", F.col("page_id") % 15 + 1)
    found = S.hits(p, PHRASE)
    total = F.col("score") + S.bonus(F.lit("district_search+fetch"), F.col("rank"))
    return found.select("page_id", U.core_host(F.col("url")).alias("host"), total.alias("score"))


@query(
    f"""WITH {PARSED}, s AS (SELECT page_id, url, {sql_core('url')} AS host, {sql_score(PHRASE)} AS score FROM b),
    one AS (SELECT host, page_id, score, 'district_search+fetch' AS search_source FROM s WHERE score IS NOT NULL AND url LIKE 'https:%' AND url LIKE '%=%')
    SELECT * FROM one UNION ALL SELECT host, page_id, score, 'district_search+fallback_crawler' FROM s
    WHERE score IS NOT NULL AND host NOT IN (SELECT host FROM one)"""
)
def hybrid_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Pages under https with a query as the hits of each site's own search; all pages for sites without one."""
    found = stored(S.hits(pages(spark, d), PHRASE).select(U.core_host(F.col("url")).alias("host"), "page_id", "score", "url"), "hits")
    own = F.col("url").startswith("https:") & (U.query(F.col("url")) != "")
    first = found.where(own).drop("url").withColumn("search_source", F.lit("district_search+fetch"))
    rest = found.drop("url").withColumn("search_source", F.lit("crawler"))
    return S.with_fallback(first, rest, "host", "district_search+fallback_crawler")


# ---------------------------------------------------------------- link graph
#: The corpus's links lead nowhere in it: pages of a host are numbered and each points to the next three.
_GRAPH = f"""n AS (SELECT page_id, {sql_core('url')} AS host, row_number() OVER (PARTITION BY {sql_core('url')} ORDER BY page_id) AS rn FROM pages),
e AS (SELECT a.host, a.page_id AS src, b.page_id AS dst, b.rn - a.rn AS pos FROM n a JOIN n b ON a.host = b.host AND b.rn BETWEEN a.rn + 1 AND a.rn + 3)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = R.numbered(pages(spark, d).select("page_id", U.core_host(F.col("url")).alias("host")), ["host"], [F.col("page_id")], "rn")
    steps = n.select("host", F.col("page_id").cast("string").alias("src"), F.explode(F.sequence(F.col("rn") + 1, F.col("rn") + 3)).alias("to"), "rn")
    ends = n.select(F.col("host").alias("h2"), F.col("rn").alias("to2"), F.col("page_id").cast("string").alias("dst"))
    e = steps.join(ends, (F.col("host") == F.col("h2")) & (F.col("to") == F.col("to2"))).select("src", "dst", (F.col("to") - F.col("rn")).alias("pos"))
    return n.where("rn = 1").select(F.col("host").alias("key"), F.col("page_id").cast("string").alias("url")), e


_WALK = f"""WITH RECURSIVE {_GRAPH}, w(host, page_id, depth) AS (SELECT host, page_id, 0 FROM n WHERE rn = 1
  UNION ALL SELECT w.host, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.page_id WHERE w.depth < {{}}),
m AS (SELECT host AS key, CAST(page_id AS VARCHAR) AS url, CAST(min(depth) AS INT) AS depth FROM w GROUP BY ALL)"""


_WHOLE = f"WITH {_GRAPH} SELECT host AS key, CAST(page_id AS VARCHAR) AS url, CAST((rn + 1) // 3 AS INT) AS depth FROM n WHERE rn <= {{}}"


@query(_WHOLE.format(100))
def bfs_frontier(spark: SparkSession, d: str) -> DataFrame:
    """A crawl to the page cap: a level visits the next three pages of a host."""
    seeds, edges = _graph(spark, d)
    return C.crawl(seeds, stored(edges, "edges"), max_pages=100).select("key", "url", "depth")


@query(_WHOLE.format(500))
def bfs_whole(spark: SparkSession, d: str) -> DataFrame:
    """As bfs_frontier, with the largest page cap that a run may have."""
    seeds, edges = _graph(spark, d)
    return C.crawl(seeds, stored(edges, "edges"), max_pages=500).select("key", "url", "depth")


@query(f"{_WALK.format(1)} SELECT key, url, depth FROM m")
def follow_depth(spark: SparkSession, d: str) -> DataFrame:
    seeds, edges = _graph(spark, d)
    return C.crawl(seeds, edges, max_pages=100, depth=1).select("key", "url", "depth")
