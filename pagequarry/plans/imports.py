"""Queries over cleaning and import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagequarry.functions import normalize as N
from pagequarry.operators import upsert as W
from pagequarry.plans.base import query
from pagequarry.sources.tables import table

_STATE = "CASE c_custkey % 7 WHEN 0 THEN 'or' WHEN 1 THEN ' Oregon ' WHEN 2 THEN ' new   york ' WHEN 3 THEN 'District of Columbia' WHEN 4 THEN c_mktsegment WHEN 5 THEN '' END"


@query(
    """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'OR' WHEN 1 THEN 'OR' WHEN 2 THEN 'NY' WHEN 3 THEN 'DC' WHEN 4 THEN c_mktsegment ELSE '' END AS state
    FROM customer"""
)
def normalize_state(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", N.state(F.expr(_STATE)).alias("state"))


_NUMBER = """CASE c_custkey % 9 WHEN 0 THEN '1,234' WHEN 1 THEN CAST(c_acctbal AS STRING) WHEN 2 THEN '1e5' WHEN 3 THEN '1-2' WHEN 4 THEN ' n/a '
  WHEN 5 THEN concat('about ', c_nationkey) WHEN 6 THEN '†' WHEN 7 THEN '-12.9' END"""


@query(
    f"""WITH s AS (SELECT c_custkey, trim(coalesce({_NUMBER}, '')) AS s FROM customer),
    n AS (SELECT c_custkey, s, try_cast(regexp_replace(s, '[^0-9.-]', '', 'g') AS DOUBLE) AS n FROM s)
    SELECT c_custkey, CASE WHEN lower(s) NOT IN ('', '-', '--', 'na', 'n/a', '†') THEN try_cast(trunc(n) AS INT) END AS number FROM n"""
)
def normalize_int(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", N.integer(F.expr(_NUMBER)).alias("number"))


@query(
    f"""SELECT c_custkey, CASE WHEN regexp_matches(s, '^[+-]?[0-9]+$') THEN try_cast(s AS INT) END AS number
    FROM (SELECT c_custkey, replace(trim(coalesce({_NUMBER}, '')), ',', '') AS s FROM customer)"""
)
def int_or_null(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", N.optional_integer(F.expr(_NUMBER)).alias("number"))


_SITE = """CASE c_custkey % 11 WHEN 0 THEN '//host.org' WHEN 1 THEN 'HTTP://Host.ORG/' WHEN 2 THEN concat(' "d', c_custkey, '.k12.or.us., " ') WHEN 3 THEN 'localhost'
  WHEN 4 THEN '10.0.0.1' WHEN 5 THEN '†' WHEN 6 THEN 'info@foo.org' WHEN 7 THEN 'N/A' WHEN 8 THEN 'a..b.org' WHEN 9 THEN 'example.org:8080/x?y=1' END"""


@query(
    """SELECT c_custkey, CASE c_custkey % 11 WHEN 0 THEN 'https://host.org' WHEN 1 THEN 'HTTP://Host.ORG/' WHEN 2 THEN 'https://d' || c_custkey || '.k12.or.us'
    WHEN 6 THEN 'https://info@foo.org' WHEN 9 THEN 'https://example.org:8080/x?y=1' ELSE '' END AS url, c_custkey % 11 IN (0, 1, 2, 6, 9) AS searchable FROM customer"""
)
def normalize_website(spark: SparkSession, d: str) -> DataFrame:
    site = N.website(F.expr(_SITE))
    return table(spark, d, "customer").select("c_custkey", site["url"].alias("url"), site["searchable"].alias("searchable"))


@query(
    """SELECT r_name AS path, CAST(CASE r_regionkey % 2 WHEN 0 THEN 2 ELSE 1 END AS INT) AS row_no,
    CAST(CASE r_regionkey % 2 WHEN 0 THEN 12 ELSE 6 END AS INT) AS points FROM region"""
)
def header_detect(spark: SparkSession, d: str) -> DataFrame:
    """Two layouts of an export: a full header below two notes, and a short one whose copy further down must not win."""
    full = ["Agency Name", "State Name [District] Latest", "Agency Type [District] 2024-25", "Web Site URL", "Agency ID - NCES Assigned", "Total Students (Excludes AE)"]
    layouts = {0: [["ELSI export"], ["State notes"], full, ["x", "y"]], 1: [["note"], ["Agency Name", "Agency Type", "State"], ["Agency Name", "Agency Type", "State"]]}
    layouts[0][2][3] = "Web Site URL"
    cells = lambda rows: F.array(*[F.array(*map(F.lit, r)) for r in rows])
    chosen = F.when(F.col("r_regionkey") % 2 == 0, cells(layouts[0])).otherwise(cells(layouts[1]))
    rows = table(spark, d, "region").select(F.col("r_name").alias("path"), F.posexplode(chosen).alias("row_no", "cells"))
    return W.header_rows(rows)


#: customer as an export: blank rows, notes without a type, several rows of one id.
_RAW = """CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_name END AS agency_name, CASE c_custkey % 5 WHEN 0 THEN 'ohio' WHEN 1 THEN 'tx' ELSE 'Maine' END AS raw_state,
  CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_mktsegment END AS agency_type, CASE WHEN c_custkey % 4 = 0 THEN 'none' ELSE concat('d', c_custkey, '.org') END AS raw_site"""


@query(
    f"""WITH x AS (SELECT {_RAW.replace("raw_state", "s").replace("raw_site", "w")} FROM customer),
    y AS (SELECT *, CASE s WHEN 'ohio' THEN 'OH' WHEN 'tx' THEN 'TX' ELSE 'ME' END AS state, agency_name <> '' AND agency_type <> '' AS ok, w <> 'none' AS site FROM x)
    SELECT count(*) AS rows_read, count(*) FILTER (ok) AS kept, count(*) FILTER (ok AND site) AS searchable, count(*) FILTER (ok AND NOT site) AS missing_websites,
    string_agg(DISTINCT CASE WHEN ok THEN state END, '|' ORDER BY CASE WHEN ok THEN state END) AS states,
    string_agg(DISTINCT CASE WHEN ok THEN agency_type END, '|' ORDER BY CASE WHEN ok THEN agency_type END) AS types FROM y"""
)
def import_summary(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "customer").selectExpr(*[f"{x.strip()}" for x in _split(_RAW)])
    clean = raw.select("agency_name", N.state(F.col("raw_state")).alias("state"), "agency_type", N.website(F.col("raw_site"))["searchable"].alias("searchable"))
    return W.import_summary(clean)


def _split(columns: str) -> list[str]:
    """Top-level commas only."""
    out, depth, held = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(held)
            held = ""
        else:
            held += ch
    return [*out, held]


#: Events before it are the old snapshot, the others the import.
_IMPORTED = "2024-01-20 00:00:00"
_UPSERT = """WITH old AS (SELECT user_id AS k, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS kind, max(event_id) AS created
      FROM events WHERE {old} GROUP BY 1),
    new AS (SELECT user_id AS k, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS kind, max(event_id) AS created
      FROM events WHERE NOT ({old}) GROUP BY 1)
    SELECT CAST(coalesce(old.k, new.k) AS VARCHAR) AS k, CASE WHEN new.k IS NULL THEN old.value ELSE new.value END AS value,
    CASE WHEN new.k IS NULL THEN old.kind ELSE new.kind END AS kind, coalesce(old.created, new.created) AS created FROM old FULL JOIN new ON old.k = new.k"""


def _upserted(spark: SparkSession, d: str, before: str) -> DataFrame:
    from pagequarry.operators.ranking import first_per_key

    e = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("k"), "value", F.col("event_type").alias("kind"), F.col("event_id").alias("created"), F.col("event_id").alias("seq"), "ts", "event_id"
    )
    kept = ["k", "value", "kind", "created", "seq"]
    old = first_per_key(e.where(before).select(*kept), ["k"], [F.desc("seq")]).drop("seq")
    return W.upsert(old, e.where(f"NOT ({before})").select(*kept), "k", "seq")


@query(_UPSERT.format(old=f"ts < TIMESTAMP '{_IMPORTED}'"))
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """The later events as an import into the snapshot of the earlier ones, every user its own key."""
    return _upserted(spark, d, f"ts < TIMESTAMP_NTZ '{_IMPORTED}'")


@query(_UPSERT.format(old="event_id % 5 <> 0"))
def upsert_users(spark: SparkSession, d: str) -> DataFrame:
    """As upsert_latest, with old and new events mixed in time; each event is on one of the two sides."""
    return _upserted(spark, d, "event_id % 5 <> 0")
