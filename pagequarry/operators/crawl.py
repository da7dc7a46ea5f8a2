"""Breadth-first crawl of a link graph, one job per level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from pagequarry.functions import urls as U
from pagequarry.operators.ranking import first_per_key
from pagequarry.sources.tables import counted, stored

#: Levels after which what is visited is stored as one table, so that its plan stays small.
_JOINED = 8
#: A queue's length in visits.
QUEUE = 4

_ROW = ["key", "url", "depth", "seq", "final", "opened", "scope"]


def below(core: Column, scope: Column) -> Column:
    """A host is that of the scope or lies below it; a null scope takes all."""
    return scope.isNull() | (core == scope) | F.endswith(core, F.concat(F.lit("."), scope))


def crawl(
    seeds: DataFrame,
    edges: DataFrame,
    max_pages: int,
    depth: int | None = None,
    allowed: Callable[[DataFrame], DataFrame] | None = None,
    fetched: DataFrame | None = None,
    moves: bool = True,
) -> DataFrame:
    """key, url, depth, seq, final, opened, scope of the pages visited, in the order seq of a first-in-first-out queue.

    seeds: key, url, their order as place, and base if links out of it are not followed. edges: src, dst, pos.
    allowed takes the rows (url, ...) that would be visited and gives back those that may be. fetched: at, final,
    ok, host of a URL, where it leads, whether its page can be read, and where that lies; without it each URL leads to
    itself.

    A URL is queued once, in the order of the pages that link it and then of their links, and never when it was
    visited. Queue and visits together hold QUEUE x max_pages URLs at most; what comes when they are full is lost.
    What allowed denies takes its place in the queue and is no visit. A page is opened if it can be read and no
    page visited before it led to the same place; only an opened page's links are followed. Where the first page
    of a key leads to another host, that host is the scope of the rest of the crawl, unless moves is false.

    Every page of a level is queued before any of the next, so a level is one job: a join with the edges and
    windows by key, over a key's visits and the links of one level. It is stored before the next. The loop ends
    with an empty level, at the latest when all have max_pages, or at `depth` if it is given.
    """
    place = F.col("place") if "place" in seeds.columns else F.lit(0)
    base = F.col("base") if "base" in seeds.columns else F.lit(None).cast("string")
    first = seeds.where("url <> ''").select("key", "url", place.alias("place"), F.nullif(U.core_host(base), F.lit("")).alias("scope"), F.lit(0).alias("pos"))
    first = _led(first_per_key(first, ["key", "url"], [F.col("place")]), fetched, "url")
    ends = _led(edges, fetched, "dst") if "final" not in edges.columns else edges
    none = seeds.where("false").select("key", "url", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("seq"), F.col("url").alias("final"), F.lit(True).alias("opened"), F.col("url").alias("scope"))
    visited, level, n, d = None, None, 1, 0
    while n and (depth is None or d <= depth):
        if d == 0:
            queued = first.select("key", "url", F.col("place").cast("long").alias("from"), "pos", "scope", "final", "ok", "host")
            queued = _home_scope(queued, allowed) if moves else queued.where(below(U.core_host(F.col("url")), F.col("scope")))
        else:
            out = level.where("opened").join(ends, F.col("url") == F.col("src"))
            out = out.select("key", F.col("dst").alias("url"), F.col("seq").alias("from"), "pos", "scope", ends["final"].alias("final"), "ok", "host").where("url <> ''")
            queued = out.where(below(U.core_host(F.col("url")), F.col("scope")))
        level, n = counted(_visited(queued, none if visited is None else visited, max_pages, allowed).withColumn("depth", F.lit(d)).select(_ROW), "crawl")
        visited = level if visited is None else visited.unionByName(level)
        d += 1
        if d % _JOINED == 0:
            visited = stored(visited, "crawl")
    return visited


def _led(rows: DataFrame, fetched: DataFrame | None, url: str) -> DataFrame:
    """rows with final, ok and host of their URL."""
    if fetched is None:
        return rows.withColumn("final", F.col(url)).withColumn("ok", F.lit(True)).withColumn("host", F.lit(""))
    known = fetched.select(F.col("at").alias("__at"), "final", "ok", "host")
    both = rows.join(known, F.col(url) == F.col("__at"), "left").drop("__at")
    return both.withColumns({"final": F.coalesce("final", F.col(url)), "ok": F.coalesce("ok", F.lit(False)), "host": F.coalesce("host", F.lit(""))})


def _home_scope(queued: DataFrame, allowed) -> DataFrame:
    """Seeds in scope: after the first of a key that may be visited, by the scope that its redirect gives."""
    may = allowed(queued) if allowed else queued
    home = first_per_key(may.where(below(U.core_host(F.col("url")), F.col("scope"))), ["key"], [F.col("from"), F.col("url")])
    moved = F.when(F.col("ok") & (F.col("host") != "") & (F.col("host") != U.host(F.col("url"))), U.core_host(F.col("final")))
    home = stored(home.select("key", F.col("url").alias("home"), F.when(F.col("scope").isNotNull(), F.coalesce(moved, "scope")).alias("new")), "homes")
    both = queued.join(home, "key").withColumn("own", F.col("url") == F.col("home"))
    kept = both.where(F.col("own") | below(U.core_host(F.col("url")), F.col("new")))
    return kept.withColumn("scope", F.col("new")).withColumn("from", F.when(F.col("own"), F.lit(-1)).otherwise(F.col("from"))).drop("home", "new", "own")


def _visited(queued: DataFrame, visited: DataFrame, max_pages: int, allowed) -> DataFrame:
    """The visits among the rows that are queued by links of one level.

    Shuffled by key once; a key has max_pages visits and what as many pages link.
    """
    old = visited.select("key", "url", F.col("seq").alias("from"), F.lit(0).alias("pos"), "scope", "final", F.col("opened").alias("ok"), F.lit(0).alias("new"))
    both = queued.select("key", "url", F.col("from").cast("long").alias("from"), F.col("pos").cast("int").alias("pos"), "scope", "final", "ok", F.lit(1).alias("new")).unionByName(old)
    both = both.repartition("key")
    once = F.row_number().over(W.partitionBy("key", "url").orderBy("new", "from", "pos"))
    both = both.withColumn("once", once).where("once = 1")
    place = F.row_number().over(W.partitionBy("key", "new").orderBy("from", "pos", "url"))
    done = F.coalesce(F.max(F.when(F.col("new") == 0, F.col("from"))).over(W.partitionBy("key")), F.lit(0))
    both = both.withColumn("place", place).withColumn("done", done)
    both = both.where((F.col("new") == 0) | (F.col("done") + F.col("place") <= QUEUE * max_pages))
    if allowed:
        both = both.where("new = 0").unionByName(allowed(both.where("new = 1")))
        both = both.repartition("key").withColumn("place", place)
    both = both.withColumn("seq", F.when(F.col("new") == 0, F.col("from")).otherwise(F.col("done") + F.col("place"))).where(F.col("seq") <= max_pages)
    first = F.row_number().over(W.partitionBy("key", "final", "ok").orderBy("seq")) == 1
    both = both.withColumn("opened", F.col("ok") & first)
    return both.where("new = 1").select("key", "url", F.col("seq").cast("long").alias("seq"), "final", "opened", "scope")
