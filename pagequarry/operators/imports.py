"""An import as an upsert into the stored organisations.

Rows of a file are taken in order. A row is the organisation that has its id, or else the one that this file's row of
the same number made; it replaces all of it but its number and the time it was made. Since it then has the row's id
and number, later rows of the file find it by these. A row that is none of the known organisations is a new one, with
the next free number.
"""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pagequarry.operators import upsert as W
from pagequarry.operators.runs import now
from pagequarry.schemas import DISTRICTS
from pagequarry.sources.snapshots import Snapshots
from pagequarry.sources.tables import conform, stored

_WINNERS = "row_no int, id long, first int"
#: Rows of a file that one task takes together, and row numbers that are counted together.
ROWS = 50_000


class Imported(NamedTuple):
    version: int
    inserted: int
    updated: int


def _matched(rows: pd.DataFrame) -> pd.DataFrame:
    """For each organisation that a file's rows make or change, the last of these rows: its number, and the organisation's id or, of a new one, the row that made it."""
    by_id, by_row, keys, last = defaultdict(set), defaultdict(set), {}, {}

    def hold(who, own, row):
        keys[who] = own, row
        by_id[own].add(who)
        by_row[row].add(who)

    known = rows[~rows["new"]].sort_values("id")
    for who, own, row in zip(known["id"], known["own"], known["row_no"]):
        hold((0, int(who)), own, row)
    new = rows[rows["new"]].sort_values("row_no")
    for own, row in zip(new["own"], new["row_no"]):
        found = (by_id[own] if own else set()) or by_row[row]
        if found:
            who = min(found)
            old_own, old_row = keys[who]
            by_id[old_own].discard(who)
            by_row[old_row].discard(who)
        else:
            who = (1, int(row))
        hold(who, own, row)
        last[who] = int(row)
    out = [(row, who[1] if who[0] == 0 else None, who[1] if who[0] else None) for who, row in last.items()]
    frame = pd.DataFrame(out, columns=["row_no", "id", "first"])
    return frame.astype({"row_no": "int32", "id": "Int64", "first": "Int32"})


def winners(old: DataFrame, new: DataFrame, file: str) -> DataFrame:
    """row_no, id, place of the rows of `new` that count, of one file; only organisations that may be meant are looked at.

    Rows and organisations meet by their id, and without one by their row; those that share it are one task's. A row
    also meets the organisations of its number that have another id, and may give them its own: what such rows could
    reach, and nothing else, depends on the order of the whole file and is one task's together.
    """
    own = F.coalesce(F.col("agency_id_nces"), F.lit(""))
    rows = new.select(own.alias("own"), F.col("source_row_number").cast("int").alias("row_no"), F.lit(None).cast("long").alias("id"), F.lit(True).alias("new"))
    here = F.col("source_file") == file
    named = old.select("id", own.alias("own"), F.when(here, F.col("source_row_number")).otherwise(-1).cast("int").alias("row_no"), F.coalesce(here, F.lit(False)).alias("here"))
    ids = rows.where("own <> ''").select(F.col("own").alias("wanted")).distinct()
    meant = named.join(ids, F.col("own") == F.col("wanted"), "left").where("here OR wanted IS NOT NULL")
    both = rows.unionByName(meant.select("own", "row_no", "id", F.lit(False).alias("new")))
    node = F.when(F.col("own") != "", F.concat(F.lit("id:"), "own")).otherwise(F.concat(F.lit("row:"), F.col("row_no").cast("string")))
    both = stored(both.withColumn("node", node), "matching")
    at = lambda flag, name: both.where(flag).where("row_no >= 0").select("row_no", F.col("node").alias(name))
    met = at("new", "one").join(at("NOT new", "two"), "row_no").where("one <> two")
    tied = met.select(F.explode(F.array("one", "two")).alias("node")).distinct().withColumn("tied", F.lit(True))
    tasks = max(1, -(-both.count() // ROWS))
    part = F.when(F.col("tied"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("node"), F.lit(tasks)))
    dealt = both.join(tied, "node", "left").select("own", "row_no", "id", "new", part.alias("part"))
    won = stored(dealt.groupBy("part").applyInPandas(_matched, _WINNERS), "won")
    # new organisations are numbered in the order of the rows that made them
    made = won.withColumn("range", F.floor(F.col("first") / ROWS))
    counts = made.where("first IS NOT NULL").groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    fresh = made.where("first IS NOT NULL").join(before, "range")
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("first")) - 1
    known = won.where("first IS NULL").select("row_no", "id", F.lit(None).cast("long").alias("place"))
    return known.unionByName(fresh.select("row_no", "id", place.alias("place")))


def upserted(old: DataFrame, rows: DataFrame, at: datetime) -> tuple[DataFrame, int, int]:
    """The next snapshot of DISTRICTS, and how many rows of the file were inserted and updated. rows: complete, cleaned rows of one file."""
    first = rows.select("source_file").first()
    if first is None:
        return old, 0, 0
    fields = {"enrollment": "total_enrollment_excludes_ae", "searchable": "has_searchable_website"}
    new = stored(rows.withColumnsRenamed(fields), "imported")
    won = stored(winners(old, new, first[0]), "winners")
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    placed = won.select(F.col("row_no").alias("source_row_number"), F.coalesce("id", F.col("place") + top + 1).alias("id"))
    made = old.select("id", F.col("created_at").alias("made"))
    fresh = new.join(placed, "source_row_number").join(made, "id", "left")
    fresh = conform(fresh.withColumns({"created_at": F.coalesce("made", F.lit(at)), "updated_at": F.lit(at)}), DISTRICTS)
    rest = old.join(placed.select("id"), "id", "left_anti").select(DISTRICTS.names)
    n, inserted = new.count(), won.where("place IS NOT NULL").count()
    return rest.unionByName(fresh), inserted, n - inserted


def organisations_at(spark: SparkSession, folder: str) -> Snapshots:
    return Snapshots(spark, folder, DISTRICTS)


def import_file(spark: SparkSession, raw: DataFrame, folder: str, at: datetime | None = None) -> Imported:
    """Clean a file's raw rows and upsert them into the organisations in `folder`, as their next version."""
    store = organisations_at(spark, folder)
    version = store.version()
    after, inserted, updated = upserted(store.read(version), W.complete(W.organisations(raw)), at or now())
    return Imported(store.commit(after, version), inserted, updated)


def searchable_organisations(df: DataFrame) -> DataFrame:
    """Stored organisations as runs and discovery take them."""
    return df.select(
        "id", "agency_name", "state", "agency_type", F.col("total_enrollment_excludes_ae").alias("enrollment"),
        F.coalesce(F.nullif("website_normalized", F.lit("")), "website").alias("website"), F.col("has_searchable_website").alias("searchable"),
    )
