"""Reporting queries: counts, coverage, latest rows, browsing, runs and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagequarry.functions import text as X
from pagequarry.operators import discovery as D
from pagequarry.operators import filters as P
from pagequarry.operators import ranking as R
from pagequarry.operators import runs as RUN
from pagequarry.operators import upsert as W
from pagequarry.operators.profiles import outcome_counts
from pagequarry.plans.base import DISTRICTS, LATEST, PROFILES, RESULTS, RUNS, districts, profiles, query, results, runs
from pagequarry.schemas import NEVER_TESTED
from pagequarry.sources.tables import table

WANTED = {"states": ["NATION_3", "NATION_7", " NATION_3 ", ""], "agency_types": ["BUILDING", "MACHINERY"], "min_enrollment": 100, "max_enrollment": 9000}
_WHERE = "searchable AND state IN ('NATION_3', 'NATION_7') AND agency_type IN ('BUILDING', 'MACHINERY') AND enrollment >= 100 AND enrollment <= 9000"
_COLUMNS = ("id", "agency_name", "state", "agency_type", "enrollment")


@query(f"WITH {DISTRICTS} SELECT id, agency_name, state, agency_type, enrollment FROM d WHERE {_WHERE}")
def district_filter(spark: SparkSession, d: str) -> DataFrame:
    return P.matching(districts(spark, d), **WANTED).select(*_COLUMNS)


@query(f"WITH {DISTRICTS} SELECT count(*) AS count FROM d WHERE {_WHERE}")
def district_count(spark: SparkSession, d: str) -> DataFrame:
    return P.matching(districts(spark, d), **WANTED).agg(F.count("*").alias("count"))


@query(f"WITH {DISTRICTS} SELECT id, agency_name, state FROM d WHERE searchable ORDER BY state, agency_name, id LIMIT 25")
def district_list(spark: SparkSession, d: str) -> DataFrame:
    return P.listed(districts(spark, d), 25).select("id", "agency_name", "state")


@query(
    f"""WITH {DISTRICTS} SELECT id, agency_name, state, enrollment FROM d WHERE agency_name ILIKE '%r#_00%' OR agency_id_nces ILIKE '%r#_00%'
    OR website ILIKE '%r#_00%' ORDER BY lower(agency_name) NULLS FIRST, lower(agency_name) NULLS FIRST, id LIMIT 100 OFFSET 100"""
)
def district_browse(spark: SparkSession, d: str) -> DataFrame:
    rows, order = P.browse(districts(spark, d), text="R#_00", sort="agency_name")
    return R.page_of(rows, order, 2, 100).select("id", "agency_name", "state", "enrollment")


def db_statistics(rows: DataFrame, *by: str) -> DataFrame:
    some = lambda c: F.count_distinct(F.nullif(F.col(c), F.lit("")))
    counts = rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if("searchable").alias("searchable"),
        some("state").alias("states"),
        some("agency_type").alias("types"),
        F.coalesce(F.bool_or(F.col("state") == "DC"), F.lit(False)).alias("has_dc"),
    )
    return counts.withColumn("state_label", state_label(F.col("states"), F.col("has_dc"))).drop("has_dc")


def state_label(states: Column, has_dc: Column) -> Column:
    return F.when((states == 51) & has_dc, "50 + DC").otherwise(states.cast("string"))


@query(
    f"""WITH {DISTRICTS} SELECT count(*) AS total, CAST(coalesce(sum(CASE WHEN searchable THEN 1 ELSE 0 END), 0) AS BIGINT) AS searchable,
    count(DISTINCT nullif(state, '')) AS states, count(DISTINCT nullif(agency_type, '')) AS types,
    CAST(count(DISTINCT nullif(state, '')) AS VARCHAR) AS state_label FROM d"""
)
def db_stats(spark: SparkSession, d: str) -> DataFrame:
    return db_statistics(districts(spark, d))


@query(
    f"""WITH {DISTRICTS} SELECT DISTINCT 'state' AS kind, state AS value FROM d WHERE state <> ''
    UNION ALL SELECT DISTINCT 'agency_type', agency_type FROM d WHERE agency_type <> ''"""
)
def filter_options(spark: SparkSession, d: str) -> DataFrame:
    rows = districts(spark, d)
    options = [rows.where(F.col(c) != "").select(F.lit(c).alias("kind"), F.col(c).alias("value")).distinct() for c in ("state", "agency_type")]
    return options[0].unionByName(options[1])


@query(f"WITH {PROFILES}, {LATEST} SELECT district_id, id, profile_status, provider_guess FROM l")
def latest_profile(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(profiles(spark, d)).select("district_id", "id", "profile_status", "provider_guess")


def coverage_of(rows: DataFrame, history: DataFrame, **wanted) -> DataFrame:
    both = P.with_latest_profile(P.matching(rows, **wanted), history)
    status = F.col("p_profile_status")
    return both.agg(
        F.count("*").alias("matching"),
        F.count_if(status == "working").alias("working"),
        F.count_if(status == "requires_javascript").alias("javascript"),
        F.count_if(F.col("p_id").isNull()).alias("missing"),
    )


@query(
    f"""WITH {DISTRICTS}, {PROFILES}, {LATEST} SELECT count(*) AS matching, count(*) FILTER (profile_status = 'working') AS working,
    count(*) FILTER (profile_status = 'requires_javascript') AS javascript, count(*) FILTER (l.id IS NULL) AS missing
    FROM d LEFT JOIN l ON l.district_id = d.id WHERE searchable"""
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage_of(districts(spark, d), profiles(spark, d))


_CHOSEN = [NEVER_TESTED, "working", "nonsense"]
_PROFILED = f"""WITH {DISTRICTS}, {PROFILES}, {LATEST} SELECT d.id, d.state, d.agency_name, l.profile_status FROM d
  LEFT JOIN l ON l.district_id = d.id WHERE searchable AND (l.id IS NULL OR l.profile_status IN ('working'))"""


@query(_PROFILED)
def profile_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = P.profile_filtered(districts(spark, d), profiles(spark, d), _CHOSEN)
    return rows.select("id", "state", "agency_name", F.col("p_profile_status").alias("profile_status"))


@query(f"SELECT count(*) AS count FROM ({_PROFILED} AND l.provider_guess = 'P3')")
def profile_filter_count(spark: SparkSession, d: str) -> DataFrame:
    return P.profile_filtered(districts(spark, d), profiles(spark, d), _CHOSEN, "P3").agg(F.count("*").alias("count"))


def summary_of(rows: DataFrame, history: DataFrame) -> DataFrame:
    """One row: searchable, profiled, never_tested, errors and the newest test. never_tested is searchable less all profiled."""
    last = R.latest(history)
    failed = ("error", "search_found_but_failed", "blocked_by_robots", "blocked_by_challenge")
    a = rows.agg(F.count_if("searchable").alias("searchable"))
    b = last.agg(F.count("*").alias("profiled"), F.count_if(F.col("profile_status").isin(*failed)).alias("errors"))
    both = a.join(b)  # two single rows
    return both.select("searchable", "profiled", F.greatest(F.lit(0), F.col("searchable") - F.col("profiled")).alias("never_tested"), "errors")


@query(
    f"""WITH {DISTRICTS}, {PROFILES}, {LATEST} SELECT (SELECT count(*) FROM d WHERE searchable) AS searchable, count(*) AS profiled,
    greatest(0, (SELECT count(*) FROM d WHERE searchable) - count(*)) AS never_tested,
    count(*) FILTER (profile_status IN ('error', 'search_found_but_failed', 'blocked_by_robots', 'blocked_by_challenge')) AS errors FROM l"""
)
def profile_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary_of(districts(spark, d), profiles(spark, d))


@query(
    f"""WITH {PROFILES}, {LATEST} SELECT profile_status, count(*) AS count, strftime(max(last_tested_at), '%Y-%m-%d %H:%M:%S') AS last_tested
    FROM l GROUP BY profile_status"""
)
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    last = R.latest(profiles(spark, d))
    return last.groupBy("profile_status").agg(F.count("*").alias("count"), F.date_format(F.max("last_tested_at"), "yyyy-MM-dd HH:mm:ss").alias("last_tested"))


@query(f"WITH {PROFILES} SELECT DISTINCT provider_guess FROM p WHERE provider_guess <> ''")
def provider_options(spark: SparkSession, d: str) -> DataFrame:
    return profiles(spark, d).where("provider_guess <> ''").select("provider_guess").distinct().orderBy("provider_guess")


@query(
    f"""WITH {DISTRICTS}, {PROFILES} SELECT p.id, d.agency_name, d.state, p.profile_status FROM p JOIN d ON d.id = p.district_id
    WHERE p.last_tested_at >= TIMESTAMP '2024-01-20 00:00:00' ORDER BY p.id DESC LIMIT 50"""
)
def recent_profiles(spark: SparkSession, d: str) -> DataFrame:
    recent = profiles(spark, d).where(F.col("last_tested_at") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    names = districts(spark, d).select(F.col("id").alias("district_id"), "agency_name", "state")
    return recent.join(names, "district_id").orderBy(F.desc("id")).limit(50).select("id", "agency_name", "state", "profile_status")


@query(
    f"""WITH {PROFILES} SELECT district_id, id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY district_id
    ORDER BY confidence DESC NULLS LAST, last_tested_at DESC NULLS LAST, id DESC) AS n FROM p WHERE profile_status IN ('working', 'manual_review')
    AND search_method = 'GET' AND search_url_template <> '') WHERE n = 1"""
)
def best_profile(spark: SparkSession, d: str) -> DataFrame:
    usable = P.usable_profiles(profiles(spark, d), ("working", "manual_review"))
    return P.best_profile(usable).select("district_id", "id", "confidence")


@query(
    f"""WITH {PROFILES} SELECT district_id, id, profile_status FROM (SELECT *, row_number() OVER (PARTITION BY district_id
    ORDER BY (confidence > 50) DESC, CASE profile_status WHEN 'working' THEN 60 WHEN 'requires_javascript' THEN 50 WHEN 'manual_review' THEN 40
    WHEN 'no_search_found' THEN 5 ELSE 0 END DESC, confidence DESC, id) AS n FROM p) WHERE n = 1"""
)
def best_test(spark: SparkSession, d: str) -> DataFrame:
    tests = profiles(spark, d).withColumn("test_success", F.col("confidence") > 50)
    return D.best_test(tests, "district_id", "id").select("district_id", "id", "profile_status")


@query(f"WITH {RUNS} SELECT id, status, query_text FROM r ORDER BY id DESC LIMIT 10")
def recent_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).orderBy(F.desc("id")).limit(10).select("id", "status", "query_text")


@query(
    f"""WITH {RESULTS}, {DISTRICTS} SELECT search_run_id, district_id, count(*) AS n, string_agg(CAST(result_rank AS VARCHAR) || ':' || page_id, ',' ORDER BY result_rank, page_id) AS hits
    FROM h GROUP BY search_run_id, district_id"""
)
def run_groups(spark: SparkSession, d: str) -> DataFrame:
    """Hits of each run by organisation, in rank order. A group holds one run's hits of one organisation (max_results at most)."""
    rows = results(spark, d)
    g = rows.groupBy("search_run_id", "district_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("result_rank", "page_id"))).alias("h"))
    hits = F.transform("h", lambda x: F.concat(x["result_rank"].cast("string"), F.lit(":"), x["page_id"].cast("string")))
    return g.select("search_run_id", "district_id", "n", F.array_join(hits, ",").alias("hits"))


@query(
    f"""WITH {RESULTS}, {RUNS}, {DISTRICTS} SELECT r.id AS run_id, r.query_text AS run_query, d.id AS district_id, d.agency_name AS district_name, d.state, d.agency_type,
    d.enrollment, d.website, h.result_rank, 'https://www.d' || d.id || '.example.org/p' || h.page_id AS url, 'Page ' || h.page_id AS title, 'text/html' AS content_type,
    h.score, 'x' AS snippet, r.started_at AS created_at FROM h JOIN r ON r.id = h.search_run_id JOIN d ON d.id = h.district_id WHERE r.status = 'completed'"""
)
def run_export(spark: SparkSession, d: str) -> DataFrame:
    """The 15 columns of an export, of all completed runs; the writer of one run's file orders it."""
    done = runs(spark, d).where("status = 'completed'")
    named = districts(spark, d).select(F.col("id").alias("district_id"), F.col("agency_name").alias("district_name"), "state", "agency_type", F.col("enrollment").alias("total_enrollment_excludes_ae"), "website")
    page = F.col("page_id").cast("string")
    rows = results(spark, d).join(named, "district_id").join(done.select(F.col("id").alias("search_run_id"), F.col("started_at").alias("created_at")), "search_run_id")
    rows = rows.withColumns({"url": F.concat(F.lit("https://"), "website", F.lit("/p"), page), "title": F.concat(F.lit("Page "), page), "content_type": F.lit("text/html"), "snippet": F.lit("x")})
    return RUN.exported(rows, done)


def progress(rows: DataFrame) -> DataFrame:
    """rows: status, matched, cap, searched, groups -> planned, in_progress, left_over, no_result."""
    planned = F.least(F.col("matched"), F.coalesce(F.col("cap"), F.col("matched")))
    busy = F.when((F.col("status") == "running") & (F.col("searched") < planned), 1).otherwise(0)
    return rows.select(
        "id",
        planned.alias("planned"),
        "searched",
        busy.alias("in_progress"),
        F.greatest(F.lit(0), planned - F.col("searched") - busy).alias("left_over"),
        F.greatest(F.lit(0), F.col("searched") - F.col("groups")).alias("no_result"),
    )


@query(
    f"""WITH {RUNS}, {RESULTS}, g AS (SELECT search_run_id, count(*) AS searched, count(DISTINCT district_id) AS groups FROM h GROUP BY 1),
    x AS (SELECT r.id, r.status, least(matched, coalesce(cap, matched)) AS planned, coalesce(searched, 0) AS searched, coalesce(groups, 0) AS groups
    FROM r LEFT JOIN g ON g.search_run_id = r.id),
    y AS (SELECT *, CASE WHEN status = 'running' AND searched < planned THEN 1 ELSE 0 END AS in_progress FROM x)
    SELECT id, planned, searched, in_progress, greatest(0, planned - searched - in_progress) AS left_over, greatest(0, searched - groups) AS no_result FROM y"""
)
def run_progress(spark: SparkSession, d: str) -> DataFrame:
    g = results(spark, d).groupBy("search_run_id").agg(F.count("*").alias("searched"), F.count_distinct("district_id").alias("groups"))
    both = runs(spark, d).join(g, F.col("id") == F.col("search_run_id"), "left")
    return progress(both.fillna(0, ["searched", "groups"]))


@query(
    f"""WITH {PROFILES} SELECT district_id % 10 AS run, count(*) AS processed, count(*) FILTER (profile_status = 'working') AS working,
    count(*) FILTER (profile_status = 'manual_review') AS manual_review, count(*) FILTER (profile_status = 'requires_javascript') AS requires_javascript,
    count(*) FILTER (profile_status NOT IN ('working', 'manual_review', 'requires_javascript')) AS failed,
    count(*) FILTER (profile_status = 'no_search_found') AS no_search_found, count(*) FILTER (coalesce(provider_guess, '') = '') AS unknown_provider
    FROM p GROUP BY 1"""
)
def discovery_counters(spark: SparkSession, d: str) -> DataFrame:
    return outcome_counts(profiles(spark, d).groupBy((F.col("district_id") % 10).alias("run")))


@query(
    f"""WITH {RUNS} SELECT id, CASE WHEN query_text LIKE '1%' OR query_text LIKE '2%' THEN round(least(matched, 25) * 0.005, 3) ELSE 0 END::DOUBLE AS cost FROM r"""
)
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    method = F.when(F.col("query_text").rlike("^[12]"), "brave").otherwise("crawler")
    return runs(spark, d).select("id", RUN.cost_of(F.col("matched"), F.lit(25), method).alias("cost"))


@query(
    """SELECT event_id, CASE WHEN s IS NULL THEN '' WHEN s < 60 THEN s || 's' ELSE (s // 60) || 'm ' || (s % 60) || 's' END AS elapsed
    FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE greatest(0, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 00:00:00')) // 1000000) END AS s FROM events)"""
)
def elapsed(spark: SparkSession, d: str) -> DataFrame:
    start = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    end = F.when(F.col("event_id") % 9 != 0, F.col("ts"))
    return table(spark, d, "events").select("event_id", X.elapsed(start, end).alias("elapsed"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE format('{:,}', o_custkey * 1000) END AS number,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day FROM orders"""
)
def report_format(spark: SparkSession, d: str) -> DataFrame:
    n = F.when(F.col("o_orderkey") % 8 != 0, F.col("o_custkey") * 1000)
    return table(spark, d, "orders").select("o_orderkey", X.report_number(n).alias("number"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"))


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 0 END::INT AS n,
    CASE c_custkey % 4 WHEN 1 THEN c_mktsegment || '|' || c_name ELSE '' END AS joined FROM customer"""
)
def json_list(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE c_custkey % 4 WHEN 0 THEN '[broken' WHEN 1 THEN to_json(array(c_mktsegment, c_name)) WHEN 2 THEN '{\"a\":1}' END")
    values = X.json_strings(raw)
    return table(spark, d, "customer").select("c_custkey", F.size(values).alias("n"), F.array_join(values, "|").alias("joined"))


@query(
    f"""WITH {PROFILES}, o AS (SELECT * FROM p WHERE profile_status <> 'working'), n AS (SELECT district_id, max(id) AS id FROM p WHERE profile_status = 'working' GROUP BY 1)
    SELECT district_id, id, profile_status FROM o WHERE district_id NOT IN (SELECT district_id FROM n)
    UNION ALL SELECT p.district_id, p.id, p.profile_status FROM p JOIN n ON n.id = p.id"""
)
def profile_replace(spark: SparkSession, d: str) -> DataFrame:
    """The latest working profile of each organisation in place of all that it had before."""
    p = profiles(spark, d).select("district_id", "id", "profile_status")
    new = R.latest(p.where("profile_status = 'working'"))
    return W.replace_keyed(p.where("profile_status <> 'working'"), new, "district_id")


_KEPT = """CASE user_id % 5 WHEN 0 THEN concat('["', event_type, '","working","__never__"]') WHEN 1 THEN 'manual_review' WHEN 2 THEN '"error"' WHEN 3 THEN concat('[', event_type) ELSE event_type END"""


@query(
    f"""SELECT event_id, CASE user_id % 5 WHEN 0 THEN CASE event_type WHEN 'error' THEN 'error,' ELSE '' END || 'working,__never__' WHEN 1 THEN 'manual_review'
    WHEN 2 THEN 'error' WHEN 3 THEN '' ELSE CASE event_type WHEN 'error' THEN 'error' ELSE '' END END AS statuses FROM events"""
)
def status_filter(spark: SparkSession, d: str) -> DataFrame:
    """A stored status filter, as a JSON list or one word; what is no status goes."""
    return table(spark, d, "events").select("event_id", F.array_join(P.stored_statuses(F.expr(_KEPT)), ",").alias("statuses"))


@query(f"WITH {DISTRICTS} SELECT id, agency_name, enrollment FROM d WHERE state = 'NATION_3' AND (agency_name ILIKE '%1%' OR agency_id_nces ILIKE '%1%' OR website ILIKE '%1%')")
def browse_state(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = P.browse(districts(spark, d), text="1", state="NATION_3")
    return rows.select("id", "agency_name", "enrollment")
