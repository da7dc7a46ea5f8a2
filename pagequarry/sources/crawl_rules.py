"""robots.txt and sitemaps."""

from __future__ import annotations

import zlib
from urllib.robotparser import RobotFileParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from pagequarry.functions import urls


def robots_sitemaps(body: Column) -> Column:
    """The URLs of Sitemap: lines."""
    return F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))


@F.pandas_udf(T.BooleanType())
def _allowed(robots: pd.Series, url: pd.Series, agent: pd.Series) -> pd.Series:
    parsers: dict[str, RobotFileParser | None] = {}

    def one(body, u, a):
        if not body:
            return True
        if body not in parsers:
            p = RobotFileParser()
            try:
                p.parse(body.splitlines())
            except Exception:
                p = None
            parsers[body] = p
        try:
            return parsers[body] is None or parsers[body].can_fetch(a, u)
        except Exception:
            return True

    return pd.Series([one(*x) for x in zip(robots, url, agent)])


def can_fetch(frontier: DataFrame, robots: DataFrame, agent: str = "*", respect: bool = True) -> DataFrame:
    """frontier (url, ...) without what the host's robots.txt denies; robots: host, status_code, body.

    Not respecting robots is the default of a run; a file that failed or had status 400 or more denies nothing.
    """
    if not respect:
        return frontier
    known = robots.where("status_code < 400").select(F.col("host").alias("__host"), F.col("body").alias("__robots"))
    both = frontier.join(known, urls.host(F.col("url")) == F.col("__host"), "left")
    return both.where(_allowed("__robots", "url", F.lit(agent))).drop("__host", "__robots")


#: Bytes of a sitemap, unpacked.
SITEMAP_CAP = 50 << 20


def xml_locs(raw: bytes | None) -> tuple[bool, list[str]]:
    """Whether it is an index, and the loc values.

    There are none in malformed XML, in an encoding that the parser lacks, in a broken archive, and in a file that is
    larger than SITEMAP_CAP.
    """
    if not raw or len(raw) > SITEMAP_CAP:
        return False, []
    try:
        if raw[:2] == b"\x1f\x8b":
            unpacked = zlib.decompressobj(zlib.MAX_WBITS | 16)
            raw = unpacked.decompress(raw, SITEMAP_CAP + 1)
            if len(raw) > SITEMAP_CAP or not unpacked.eof:
                return False, []
        root = ElementTree.fromstring(raw)
    except (ElementTree.ParseError, zlib.error, LookupError, ValueError):
        return False, []
    locs = [(e.text or "").strip() for e in root.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == "loc"]
    return root.tag.rpartition("}")[2] == "sitemapindex", [x for x in locs if x]


_LOCS = T.StructType([T.StructField("is_index", T.BooleanType()), T.StructField("locs", T.ArrayType(T.StringType()))])


@F.pandas_udf(_LOCS)
def xml_locs_udf(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([xml_locs(bytes(x) if x is not None else None) for x in raw], columns=["is_index", "locs"])


def loc_values(xml: Column) -> Column:
    """loc values of an XML text by built-ins: well-formed or not, namespaces or not."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"<(?:\w+:)?loc>\s*([^<]*?)\s*</(?:\w+:)?loc>"), F.lit(1)), lambda x: F.trim(x))


def sitemap_urls(seeds: DataFrame, files: DataFrame, cap: int, depth: int = 2) -> DataFrame:
    """URLs of sitemaps, indexes followed to `depth`: one join per level, never more than depth levels.

    seeds: base, url. files: url, body (binary). Result: base, url, seq; at most cap per base.
    """
    bodies = files.select(urls.canonical(F.col("url")).alias("__at"), xml_locs_udf(F.col("body").cast("binary")).alias("x"))
    from pagequarry.operators.ranking import first_per_key, numbered

    level = seeds.select("base", urls.canonical(F.col("url")).alias("url"), F.lit("").alias("order"))
    found, seen = None, None
    for _ in range(depth + 1):
        same = first_per_key(level.where(urls.same_org(F.col("url"), F.col("base"))), ["base", "url"], [F.col("order")])
        if seen is not None:
            same = same.join(seen, ["base", "url"], "left_anti")
        seen = same.select("base", "url") if seen is None else seen.unionByName(same.select("base", "url"))
        opened = same.join(bodies, same["url"] == bodies["__at"]).select(
            "base", "order", F.col("x.is_index").alias("is_index"), F.posexplode("x.locs").alias("pos", "loc")
        )
        opened = opened.select("base", "is_index", urls.canonical(F.col("loc")).alias("url"), F.concat("order", F.lit("/"), F.format_string("%08d", "pos")).alias("order"))
        here = opened.where("NOT is_index AND url <> ''").where(urls.same_org(F.col("url"), F.col("base"))).select("base", "url", "order")
        found = here if found is None else found.unionByName(here)
        level = opened.where("is_index").select("base", "url", "order")
    firsts = first_per_key(found, ["base", "url"], [F.col("order")])
    return numbered(firsts, ["base"], [F.col("order")], "seq").where(F.col("seq") <= cap).select("base", "url", "seq")
