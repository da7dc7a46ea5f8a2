"""Queries over operators that the other queries use in passing or not at all: files, writes, gates, caps, overrides."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagequarry.functions import normalize as N
from pagequarry.functions import urls as U
from pagequarry.operators import discovery as D
from pagequarry.operators import filters as L
from pagequarry.operators import ranking as R
from pagequarry.operators import runs as RUN
from pagequarry.operators import upsert as W
from pagequarry.plans.base import districts, pages, query, sql_canonical, sql_core, sql_host, sql_part
from pagequarry.sources import crawl_rules, fetch, files
from pagequarry.sources.tables import folder, stored, table


# ---------------------------------------------------------------- files
_HEAD = ["Agency Name", "State Name [District] Latest", "Agency Type [District]", "Web Site URL", "Agency ID - NCES Assigned", "Total Students (Excludes AE)"]
#: A nation as a row of an export in an 8-bit encoding: a comma and quotes in the name, a number with its commas, sites of each kind.
_CELLS = [
    "concat('École \"', n_name, '\", ', n_nationkey)",
    "CASE n_regionkey WHEN 0 THEN 'oregon' WHEN 1 THEN 'tx' ELSE 'Maine' END",
    "CASE WHEN n_nationkey % 6 = 5 THEN '' ELSE concat('Type  ', n_regionkey) END",
    "CASE WHEN n_nationkey % 4 = 0 THEN 'none' ELSE concat('d', n_nationkey, '.org') END",
    "lpad(n_nationkey, 7, '0')",
    "concat(n_nationkey + 1, ',', '200')",
]


@query(
    """SELECT (n_nationkey + 3)::INT AS source_row_number, 'École "' || n_name || '", ' || n_nationkey AS agency_name, CASE n_regionkey WHEN 0 THEN 'OR' WHEN 1 THEN 'TX' ELSE 'ME' END AS state,
    'Type ' || n_regionkey AS agency_type, lpad(n_nationkey::VARCHAR, 7, '0') AS agency_id_nces, ((n_nationkey + 1) * 1000 + 200)::INT AS enrollment,
    CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'https://d' || n_nationkey || '.org' END AS website_normalized, n_nationkey % 4 <> 0 AS searchable,
    'id:' || lpad(n_nationkey::VARCHAR, 7, '0') AS key, (n_nationkey + 1) || ',200' AS raw_students FROM nation WHERE n_nationkey % 6 <> 5"""
)
def import_csv(spark: SparkSession, d: str) -> DataFrame:
    """All nations through an export file: notes above the header, bytes that are no UTF-8, the newest file of a folder, notes without a type left out."""
    rows = table(spark, d, "nation").select((F.col("n_nationkey") + 2).alias("n"), *[F.expr(c).alias(f"c{i}") for i, c in enumerate(_CELLS)])
    top = spark.createDataFrame([(0, "Élan export", *[""] * 5), (1, *_HEAD)], rows.schema)
    path = folder(spark, "export")
    whole = top.unionByName(rows).coalesce(1).sortWithinPartitions("n").drop("n")  # an export is one file
    whole.write.option("encoding", "iso-8859-1").option("escape", '"').option("header", False).csv(path)
    raw = stored(files.raw_rows_remote(spark, files.newest_source(spark, path)), "raw-rows")
    kept = W.complete(W.organisations(raw))
    return kept.select(
        F.col("source_row_number").cast("int").alias("source_row_number"), "agency_name", "state", "agency_type", "agency_id_nces", "enrollment", "website_normalized", "searchable",
        W.match_key().alias("key"), F.element_at("raw", _HEAD[5]).alias("raw_students"),
    )


@query("""SELECT p_partkey, 'a "' || p_name || '", ' || p_brand AS name, CASE WHEN p_size > 25 THEN p_type ELSE 'x,' || chr(10) || 'y' END AS kind, p_retailprice AS price FROM part""")
def export_file(spark: SparkSession, d: str) -> DataFrame:
    """All parts through a CSV export: quotes, commas and line ends within values."""
    rows = table(spark, d, "part").select(
        "p_partkey", F.expr("""concat('a "', p_name, '", ', p_brand)""").alias("name"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("x,\ny").alias("kind"), F.col("p_retailprice").alias("price")
    )
    path = folder(spark, "csv")
    W.export_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@query(
    """SELECT l_linenumber::INT AS search_run_id, l_orderkey, l_extendedprice AS score FROM lineitem WHERE l_linenumber <> 3 UNION ALL
    SELECT 3, l_orderkey, l_discount FROM lineitem WHERE l_linenumber = 3 AND l_returnflag = 'R'"""
)
def run_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """The results of seven runs, of which one is written again: only its own partition is replaced."""
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("search_run_id"), "l_orderkey", F.col("l_extendedprice").alias("score"), "l_discount", "l_returnflag")
    path = folder(spark, "runs")
    W.write_run(rows.select("search_run_id", "l_orderkey", "score"), path)
    again = rows.where("search_run_id = 3 AND l_returnflag = 'R'").select("search_run_id", "l_orderkey", F.col("l_discount").alias("score"))
    W.write_run(again, path)
    return spark.read.parquet(path).select("search_run_id", "l_orderkey", "score")


_AT = "2024-05-06T07:08:09"


@query(
    f"""WITH e AS (SELECT c_name AS name, c_acctbal < 0 AS failed, c_nationkey AS stored FROM customer)
    SELECT CASE WHEN failed THEN '{_AT} district_error district={{"v":"' || name || '"}} error={{"v":"no answer"}}'
      ELSE '{_AT} district_results_stored district={{"v":"' || name || '"}} stored_results={{"v":"' || stored || '"}}' END AS line FROM e UNION ALL
    SELECT '{_AT} run_start districts={{"v":"' || count(*) || '"}} method={{"v":"crawler"}} query={{"v":"some text"}}' FROM e UNION ALL
    SELECT '{_AT} run_finish failed={{"v":"' || count(*) FILTER (failed) || '"}} searched={{"v":"' || count(*) || '"}} status={{"v":"completed"}}' FROM e"""
)
def run_events(spark: SparkSession, d: str) -> DataFrame:
    """The log of a run over all organisations, as lines."""
    each = table(spark, d, "customer").select(
        F.col("c_custkey").alias("district_id"), F.col("c_name").alias("district"), F.col("c_nationkey").alias("stored"), (F.col("c_acctbal") < 0).alias("failed"),
        F.when(F.col("c_acctbal") < 0, "no answer").alias("error"),
    )
    n, failed = each.agg(F.count("*"), F.count_if("failed")).first()
    at, path = datetime.fromisoformat(_AT), folder(spark, "events")
    RUN.log_run(RUN.Run(1, "some text", status="completed", districts_searched=n, districts_failed=failed, started_at=at, finished_at=at), each, path)
    return RUN.log_lines(spark.read.parquet(path)).select("line")


@query("""SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'queued' END AS status FROM orders""")
def runs_recovered(spark: SparkSession, d: str) -> DataFrame:
    """All runs as a restart finds them."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("queued")
    return RUN.recovered(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status")))


# ---------------------------------------------------------------- gates
_RULED = f"""SELECT {sql_host('url')} AS host, count(*) FILTER (url LIKE 'https:%') > count(*) / 2 AS ruled FROM pages GROUP BY 1"""


@query(
    f"""WITH r AS ({_RULED}) SELECT page_id, url FROM pages JOIN r ON r.host = {sql_host('url')}
    WHERE NOT (ruled AND (starts_with({sql_part('url', 3)}, '/en/') OR {sql_part('url', 3)} LIKE '/de/%'))"""
)
def robots_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages that their host's robots.txt lets a crawl read; hosts with mostly plain http have none (404)."""
    p = pages(spark, d).select("page_id", "url")
    secure = F.count_if(F.col("url").startswith("https:")) > F.count("*") / 2
    robots = p.groupBy(U.host(F.col("url")).alias("host")).agg(F.when(secure, 200).otherwise(404).alias("status_code"))
    body = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/\nDisallow: /de/\n"
    return crawl_rules.can_fetch(p, robots.withColumn("body", F.lit(body)))


_STATUS = "element_at(array(200, 301, 404, 503), CAST(length(url) % 4 AS INT) + 1)"


@query(
    f"""WITH u AS (SELECT page_id, {sql_canonical('url')} AS url, [200, 301, 404, 503][length(url) % 4 + 1] AS status, strlen(html) AS size FROM pages)
    SELECT f.page_id, c.url AS final_url, c.status::INT AS status_code FROM u f JOIN u c USING (url) WHERE c.status < 400 AND c.size <= 3000"""
)
def fetch_gates(spark: SparkSession, d: str) -> DataFrame:
    """All URLs fetched from the corpus, with statuses and a size cap."""
    p = pages(spark, d)
    frontier = p.select("page_id", U.canonical(F.col("url")).alias("url"))
    corpus = p.select("url", "html", F.expr(_STATUS).alias("status_code"))
    return fetch.from_corpus(frontier, corpus, fetch.FetchSettings(html_cap=3000)).select("page_id", "final_url", "status_code")


# ---------------------------------------------------------------- search pages
_PAGE_OF_RESULTS = """concat('<nav><a href="/start.html">start</a></nav><div class="x Search-Results"><ul><li><a href="', way, '"><b>Page</b> ', page_id, '</a> about ', page_id, '</li>',
  '<li><a href=../n/y', page_id, '.html></a></li><li><a href="https://other.invalid/z">Z</a></li><li><a href="', way, '#again">again</a></li></ul></div>')"""


@query(
    f"""WITH p AS (SELECT page_id, 'https://' || {sql_core('url')} AS base, {sql_part('url', 3)} AS way FROM pages)
    SELECT page_id, base || rtrim(way, '/') AS url, 'Page ' || page_id AS title, 'Page ' || page_id || ' about ' || page_id AS snippet, 1::INT AS rank FROM p UNION ALL
    SELECT page_id, base || '/n/y' || page_id || '.html', 'y' || page_id || '.html', '', 2::INT FROM p"""
)
def result_links(spark: SparkSession, d: str) -> DataFrame:
    """The hits of a results page made of each page's path: a link in a container, one without a text, one to elsewhere, one twice."""
    p = pages(spark, d).select("page_id", F.concat(F.lit("https://"), U.core_host(F.col("url"))).alias("base"), U.path(F.col("url")).alias("way"))
    searched = F.concat("base", F.lit("/zz/find?needle=the"))
    each = p.select("page_id", F.explode(D.result_links(F.expr(_PAGE_OF_RESULTS), searched, F.col("base"), searched, F.lit(10))).alias("l"))
    return each.select("page_id", "l.*")


@query(
    """SELECT page_id, 'https://h' || page_id || '.org/find?' || CASE page_id % 2 WHEN 0 THEN 'q={query}&page=' || page_id ELSE 'page=' || page_id || '&q={query}' END || '&site=a+b' AS template
    FROM pages"""
)
def url_template(spark: SparkSession, d: str) -> DataFrame:
    """A search template of a URL that has the parameter, or lacks it."""
    n = F.col("page_id").cast("string")
    at = F.concat(F.lit("https://h"), n, F.lit(".org/find?"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("q=old&page="), n)).otherwise(F.concat(F.lit("page="), n, F.lit("&q=x%20y"))))
    extra = F.array(F.struct(F.lit("page").alias("k"), F.lit("9").alias("v")), F.struct(F.lit("site").alias("k"), F.lit("a b").alias("v")))
    return pages(spark, d).select("page_id", U.template(at, F.lit("q"), extra).alias("template"))


# ---------------------------------------------------------------- caps, stops and overrides
@query(
    """WITH c AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'POST' ELSE 'GET' END AS method, event_type || floor(value)::BIGINT % 20 AS template FROM events),
    o AS (SELECT key, method, template, min(seq) AS seq FROM c GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS place FROM o WHERE method = 'GET')
    SELECT key, seq, template AS search_url_template, place::INT AS place FROM t WHERE place <= 10"""
)
def candidate_cap(spark: SparkSession, d: str) -> DataFrame:
    """The first ten candidates of each site that are asked by GET, each once."""
    c = table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "POST").otherwise("GET").alias("search_method"),
        F.concat("event_type", (F.floor("value") % 20).cast("string")).alias("search_url_template"),
    )
    return D.unique_candidates(c).select("key", "seq", "search_url_template", "place")


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, min(CASE WHEN l_discount >= 0.08 THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS stop FROM lineitem)
    SELECT l_orderkey, l_linenumber FROM s WHERE stop IS NULL OR l_linenumber <= stop"""
)
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    """The tests of each site up to the first that is sure."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return R.until(rows, ["l_orderkey"], "l_linenumber", F.col("l_discount") >= 0.08).select("l_orderkey", "l_linenumber")


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_linenumber IN (1, 2) AS script, CASE l_returnflag WHEN 'R' THEN 'working' WHEN 'A' THEN 'manual_review' ELSE 'search_found_but_failed' END AS s,
      l_quantity::DOUBLE AS c, l_discount < 0.02 AS tiny FROM lineitem), o AS (SELECT *, script AND s <> 'working' AS forced FROM c)
    SELECT l_orderkey, l_linenumber, CASE WHEN forced OR tiny THEN 'requires_javascript' ELSE s END AS status,
    CASE WHEN tiny THEN 0.0 WHEN forced THEN greatest(40.0, c) ELSE c END::DOUBLE AS confidence, CASE WHEN forced OR tiny THEN '' ELSE 't' END AS template FROM o"""
)
def forced_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of tests after the overrides for platforms that need a script engine, and for tiny pages."""
    name = F.when(F.col("l_linenumber") == 1, "Apptegy").when(F.col("l_linenumber") == 2, "ParentSquare").otherwise("Custom")
    state = F.when(F.col("l_returnflag") == "R", "working").when(F.col("l_returnflag") == "A", "manual_review").otherwise("search_found_but_failed")
    end = D.forced_outcome(name, state, F.col("l_quantity").cast("double"), F.lit("t"), F.col("l_discount") < 0.02)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", end.alias("end")).select("l_orderkey", "l_linenumber", "end.*")


@query("SELECT c_custkey, greatest(1, least(500, coalesce(CASE WHEN c_acctbal >= 0 THEN trunc(c_acctbal)::INT END, 100)))::INT AS pages FROM customer")
def clamped(spark: SparkSession, d: str) -> DataFrame:
    """A setting held within its bounds, with its default where there is none."""
    given = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("int"))
    return table(spark, d, "customer").select("c_custkey", N.clamp(given, 1, 500, 100).alias("pages"))


@query(
    """SELECT c_custkey AS id, c_name AS agency_name FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE c_acctbal >= 0 AND n_name IN ('NATION_3', 'NATION_7', 'NATION_20') AND c_mktsegment IN ('FURNITURE', 'BUILDING')"""
)
def value_lists(spark: SparkSession, d: str) -> DataFrame:
    """Organisations by value lists as forms send them: blanks around values, empty and repeated ones."""
    found = L.matching(districts(spark, d), states=[" NATION_3 ", "", None, "NATION_7", "NATION_3", "NATION_20"], agency_types=["FURNITURE", "  ", " BUILDING"])
    return found.select("id", "agency_name")
