"""Phrase search over a page corpus: score, bonuses, merging, top-k per organisation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from pagequarry.functions import html as H
from pagequarry.functions import text as X
from pagequarry.functions import urls as U
from pagequarry.operators.ranking import first_per_key, overwrite, top_k
from pagequarry.sources import crawl_rules as R
from pagequarry.sources import fetch
from pagequarry.sources.pdf import pdf_text
from pagequarry.sources.tables import bucketed, stored


@dataclass(frozen=True)
class SearchSettings:
    search_method: str = "crawler"
    max_results: int = 5
    max_pages: int = 100
    max_districts: int = 25
    api_results: int = 10
    follow_depth: int = 0
    respect_robots: bool = False
    html_cap: int = 5 << 20
    pdf_cap: int = 10 << 20

    @property
    def frontier_cap(self) -> int:
        return 4 * self.max_pages


def score(title: Column, headings: Column, body: Column, url: Column, phrase: str, content_type: Column | None = None, folded: Column | None = None) -> Column:
    """Score of a page, null where the phrase is in neither text, title nor headings; folded: the body folded, where it is known."""
    q = X.fold_text(phrase)
    place = U.path(url)

    def total(x: Column) -> Column:
        points = (
            F.when(x["t"].contains(q), 50.0).otherwise(0.0)
            + F.when(x["h"].contains(q), 25.0).otherwise(0.0)
            + 10.0 * F.least(X.occurrences(x["b"], phrase), F.lit(10))
            + F.when(U.path_segments(url) <= 1, 5.0).otherwise(0.0)
            + F.when(place.isin("", "/"), 5.0).otherwise(0.0)
        )
        if content_type is not None:
            points = points - F.when(content_type == "application/pdf", 2.0).otherwise(0.0)
        return F.when(x["t"].contains(q) | x["h"].contains(q) | x["b"].contains(q), points)

    folded = F.struct(X.fold(title).alias("t"), X.fold(F.array_join(headings, " ")).alias("h"), (X.fold(body) if folded is None else folded).alias("b"))
    return X.let(folded, total)


def parsed(pages: DataFrame) -> DataFrame:
    """pages (url, html, ...) with title, headings and body, of a markup that is cleaned once."""
    own = [c for c in pages.columns if c not in ("html", "title", "headings", "body")]
    clean = X.held(pages, own, title=H.title(F.col("html")), __shown=H.visible(F.col("html")))
    return X.held(clean, [*own, "title"], headings=H.shown_headings(F.col("__shown")), body=H.shown_text(F.col("__shown")))


def hits(pages: DataFrame, phrase: str) -> DataFrame:
    """Pages that match: url, title, score, snippet, matched_terms and the columns that came along."""
    page = parsed(pages)
    own = [c for c in page.columns if c != "score"]
    page = X.held(page, own, __folded=X.fold(F.col("body")))
    scored = X.held(page, [*own, "__folded"], score=score(F.col("title"), F.col("headings"), F.col("body"), F.col("url"), phrase, folded=F.col("__folded")))
    found = scored.where(F.col("score").isNotNull())
    found = found.withColumn("snippet", X.snippet(F.col("body"), phrase, folded=F.col("__folded"))).withColumn("matched_terms", F.array(F.lit(phrase)))
    return found.withColumn("title", F.substring("title", 1, 500)).drop("body", "headings", "__folded")


def best_hits(found: DataFrame, keys: list[str], k: int, seq: str = "seq") -> DataFrame:
    """The k best of each key, score first, then the order of discovery."""
    return top_k(found, keys, [F.desc("score"), F.col(seq)], k)


def api_hits(payload: DataFrame, limit: int, base: str = "base") -> DataFrame:
    """Ranked hits of a web-search response: columns key, base, json (web.results). Rank counts raw items."""
    variant = F.try_parse_json("json")
    items = F.try_variant_get(variant, "$.web.results", "array<struct<url string, title string, description string>>")
    each = payload.select(*[c for c in payload.columns if c != "json"], F.posexplode(F.slice(items, 1, limit)).alias("pos", "item"))
    url = U.canonical(F.col("item.url"))
    rows = each.where(U.same_org(url, F.col(base)) & url.rlike("^https?:"))
    title = F.coalesce(F.nullif(X.strip_tags(F.col("item.title")), F.lit("")), U.filename_title(url))
    return rows.select(
        *[c for c in payload.columns if c != "json"],
        url.alias("url"),
        F.substring(title, 1, 500).alias("title"),
        F.substring(X.strip_tags(F.coalesce("item.description", F.lit(""))), 1, 1000).alias("snippet"),
        (F.col("pos") + 1).alias("rank"),
        api_score(F.col("pos") + 1).alias("score"),
    )


def api_score(rank: Column) -> Column:
    return F.greatest(F.lit(5.0), F.lit(55.0) - rank)


def bonus(source: Column, rank: Column) -> Column:
    """What a hit's source adds to its score."""
    return (
        F.when(source == "brave+fetch", 20.0)
        .when(source == "brave-follow", 8.0)
        .when(source == "district_search+fetch", F.greatest(F.lit(0.0), F.lit(20.0) - rank))
        .otherwise(0.0)
    )


def with_confirmed(api: DataFrame, fetched: DataFrame, keys: list[str]) -> DataFrame:
    """API hits in which those that were fetched and match are replaced; the others stay."""
    return overwrite(api, fetched, keys)


def with_fallback(first: DataFrame, fallback: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """first, and for keys without a hit there the fallback's rows, relabelled if a label is given."""
    rest = fallback.join(first.select(key).distinct(), key, "left_anti")
    if label:
        rest = rest.withColumn("search_source", F.lit(label))
    return first.unionByName(rest)


class Corpus:
    """Stored pages as the network of a run: narrow tables that are made on the scan, each when it is first asked for.

    pages: url, html and, as far as there are, final_url (where redirects led), status_code, content_type, error (of
    the fetch), content (bytes, of a PDF), seq (order of discovery), attempt (from 1; only homepages are asked for again).
    A page that could not be fetched or read is
    a value of its row. Markup is parsed and scored where it is read and crosses no shuffle.
    """

    def __init__(self, pages: DataFrame, settings: SearchSettings = SearchSettings()):
        have = set(pages.columns)
        other = {"final_url": F.col("url"), "status_code": F.lit(200), "content_type": F.lit("text/html"), "error": F.lit(None).cast("string"), "seq": F.col("url"), "content": F.lit(None).cast("binary"), "attempt": F.lit(1)}
        given = {c: F.coalesce(F.col(c), v) if c in ("final_url", "status_code") and c in have else F.col(c) if c in have else v for c, v in other.items()}
        page = pages.select("url", "html", *[v.alias(c) for c, v in given.items()])
        self.settings, self.binary = settings, "content" in have
        at, kind = U.canonical(F.col("url")), fetch.kind(F.col("content_type"), F.col("final_url"))
        fits = fetch.within_cap(F.coalesce(F.col("content"), F.col("html").cast("binary")), F.col("content_type"), F.col("final_url"), settings.html_cap, settings.pdf_cap)
        error = F.coalesce(F.col("error"), F.when(~fits, "The page is larger than its cap."))
        self.every = page.withColumns({"at": at, "kind": kind, "error": error, "final_url": F.coalesce("final_url", "url")})
        self.read = self.every.where("attempt = 1") if "attempt" in have else self.every
        self._matches: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, pages: DataFrame | Corpus, settings: SearchSettings = SearchSettings()) -> Corpus:
        return pages if isinstance(pages, Corpus) else cls(pages, settings)

    @property
    def pages(self) -> DataFrame:
        """The pages of a readable type that came whole, with status below 400."""
        return self.read.where("error IS NULL AND status_code < 400 AND kind = 'text/html' AND html IS NOT NULL")

    @cached_property
    def documents(self) -> DataFrame:
        """PDFs that came whole: at, final_url, status_code, seq, text, error."""
        some = self.read.where("error IS NULL AND status_code < 400 AND kind = 'application/pdf' AND content IS NOT NULL")
        return stored(some.select("at", "final_url", "status_code", "seq", F.inline(F.array(pdf_text(F.col("content"))))), "documents")

    @cached_property
    def fetched(self) -> DataFrame:
        """at, final, host, status, ok, error of each URL; of rows with the same URL the least final one."""
        ok = F.col("error").isNull() & (F.col("status_code") < 400) & F.col("kind").isNotNull()
        one = self.read.select("at", F.struct(U.canonical(F.col("final_url")).alias("final"), U.host(F.col("final_url")).alias("host"), F.col("status_code").alias("status"), ok.alias("ok"), "error").alias("x"))
        one = one.groupBy("at").agg(F.min("x").alias("x")).select("at", "x.*")
        if not self.binary:
            return stored(one, "fetched")
        one = one.join(self.documents.where("error IS NOT NULL").select("at", F.col("error").alias("broken")), "at", "left")
        return stored(one.select("at", "final", "host", "status", (F.col("ok") & F.col("broken").isNull()).alias("ok"), F.coalesce("error", "broken").alias("error")), "fetched")

    @cached_property
    def edges(self) -> DataFrame:
        """src, dst, pos of all links, with final, ok and host of where they lead, in buckets by src."""
        known = self.pages.select(F.col("at").alias("src"), F.posexplode(H.links(F.col("html"), F.col("final_url"))).alias("pos", "dst"))
        known = known.select("src", U.canonical(F.col("dst")).alias("dst"), "pos").where("dst <> ''")
        ends = known.join(self.fetched.select(F.col("at").alias("dst"), "final", "ok", "host"), "dst", "left")
        ends = ends.select("src", "dst", "pos", F.coalesce("final", "dst").alias("final"), F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("host", F.lit("")).alias("host"))
        return bucketed(ends, "edges", "src", int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def matches(self, phrase: str) -> DataFrame:
        """at, url (where it led), title, score, snippet, matched_terms, status_code, content_type, seq of the pages that match."""
        if phrase not in self._matches:
            self._matches[phrase] = self._matching(self.pages, phrase)
        return self._matches[phrase]

    def matches_at(self, phrase: str, asked: DataFrame) -> DataFrame:
        """The same, at least of the pages at these URLs (at): only they are scored, in even tasks, unless all are already."""
        if phrase in self._matches:
            return self._matches[phrase]
        asked = stored(asked.select("at").distinct(), "opened")
        n = asked.count()
        few = F.broadcast(asked) if n <= ASKED else asked
        tasks = max(asked.sparkSession.sparkContext.defaultParallelism, -(-n // SCORED))
        return self._matching(self.pages.join(few, "at", "left_semi").repartition(tasks, "at"), phrase)

    def _matching(self, pages: DataFrame, phrase: str) -> DataFrame:
        found = hits(pages.select("at", F.col("final_url").alias("url"), "html", "status_code", "seq", F.lit("text/html").alias("content_type")), phrase)
        columns = ["at", "url", "title", "score", "snippet", "matched_terms", "status_code", "content_type", "seq"]
        if not self.binary:
            return stored(found.select(columns), "matches")
        pdfs = self.documents.where("error IS NULL").select("at", F.col("final_url").alias("url"), "status_code", "seq", F.lit("application/pdf").alias("content_type"), F.col("text").alias("body"))
        return stored(found.select(columns).unionByName(document_hits(pdfs, phrase).select(columns)), "matches")

    def answering(self, asked: DataFrame, url: str) -> DataFrame:
        """asked with html, status_code, final_url, error of the page at its column url (canonical), nulls where there is none.

        asked must be a stored table. Up to ASKED rows it goes to where the pages are read; beyond that both are shuffled.
        """
        own = self.read.select("at", "html", "status_code", "final_url", "error")
        few = F.broadcast(asked) if asked.count() <= ASKED else asked
        found = own.join(few, F.col("at") == F.col(url)).select(*asked.columns, "html", "status_code", "final_url", "error")
        return found


#: Rows that are sent to the scan of the pages instead of the pages to them.
ASKED = 100_000
#: Pages that one task scores.
SCORED = 2_000


def document_hits(documents: DataFrame, phrase: str) -> DataFrame:
    """As hits, for rows (url, body, content_type) without markup: the title is the file's name, there are no headings."""
    page = documents.withColumn("title", U.filename_title(F.col("url")))
    none = F.array().cast("array<string>")
    scored = X.held(page, page.columns, score=score(F.col("title"), none, F.col("body"), F.col("url"), phrase, F.col("content_type")))
    found = scored.where(F.col("score").isNotNull())
    return found.withColumn("snippet", X.snippet(F.col("body"), phrase)).withColumn("matched_terms", F.array(F.lit(phrase))).drop("body")


class Found(NamedTuple):
    """Ranked hits of each organisation, and what was read for them: id, url, error."""

    hits: DataFrame
    read: DataFrame


_HIT = ["url", "title", "score", "snippet", "matched_terms", "status_code", "content_type"]


def found_in_corpus(districts: DataFrame, pages: DataFrame | Corpus, phrase: str, settings: SearchSettings = SearchSettings()) -> Found:
    """Hits of each organisation among the pages of its host and of hosts below it.

    districts: id, agency_name, state, agency_type, enrollment, website. Hosts, not pages, are exploded into the
    hosts they lie below, so both joins are on equal keys.
    """
    corpus = Corpus.of(pages, settings)
    d = districts.withColumn("__base", U.core_host(F.col("website"))).where("__base <> ''")

    def of_each(p: DataFrame) -> DataFrame:
        hosts = p.select("__host").where("__host <> ''").distinct()
        parts = F.split("__host", "[.]")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
        scope = hosts.select("__host", F.explode(above).alias("__base"))
        return d.join(scope, "__base").drop("__base").join(p, "__host").drop("__host")

    found = of_each(corpus.matches(phrase).withColumn("__host", U.core_host(F.col("url"))))
    unique = first_per_key(found, ["id", "url"], [F.col("seq")])
    ranked = best_hits(unique, ["id"], settings.max_results).withColumn("search_source", F.lit("crawler"))
    read = of_each(corpus.fetched.select(F.col("at").alias("url"), "error", U.core_host(F.col("final")).alias("__host")))
    return Found(ranked.drop("at"), read.select("id", "url", "error"))


def search_corpus(districts: DataFrame, pages: DataFrame | Corpus, phrase: str, settings: SearchSettings = SearchSettings()) -> DataFrame:
    return found_in_corpus(districts, pages, phrase, settings).hits


def link_graph(pages: DataFrame | Corpus) -> DataFrame:
    """src, dst, pos: the links of all pages, stored."""
    return Corpus.of(pages).edges


def found_by_crawl(
    districts: DataFrame,
    pages: DataFrame | Corpus,
    phrase: str,
    settings: SearchSettings = SearchSettings(),
    depth: int | None = None,
    sitemaps: DataFrame | None = None,
    robots: DataFrame | None = None,
) -> Found:
    """As found_in_corpus, for the pages that a crawl from each organisation's website reaches; depth None is as far as max_pages goes.

    sitemaps: url, body. Those that robots.txt names, and /sitemap.xml of each site, give seeds after the homepage,
    three times max_pages at most. robots: host, status_code, body; it denies pages only if the settings respect it.
    A page counts under the URL that it led to.
    """
    from pagequarry.operators.crawl import crawl

    corpus = Corpus.of(pages, settings)
    d = districts.where(U.core_host(F.col("website")) != "")
    homes = d.select(F.col("id").alias("key"), U.canonical(F.col("website")).alias("url"), F.col("website").alias("base"), F.lit(0).alias("place"))
    seeds = homes
    if sitemaps is not None:
        bases = homes.select("base").distinct()
        files = bases.select("base", U.join(F.col("base"), F.lit("/sitemap.xml")).alias("url"))
        if robots is not None:
            named = robots.where("status_code < 400").select(F.col("host").alias("__host"), F.explode(R.robots_sitemaps(F.col("body"))).alias("url"))
            files = bases.join(named, U.host(F.col("base")) == F.col("__host")).select("base", "url").unionByName(files)
        listed = R.sitemap_urls(files, sitemaps, 3 * settings.max_pages).select("base", "url", F.col("seq").cast("int").alias("place"))
        seeds = homes.unionByName(listed.join(homes.select("key", "base"), "base").select("key", "url", "base", "place"))
    visited = crawl(seeds, corpus.edges, settings.max_pages, depth, _allowed(settings, robots), corpus.fetched)
    opened = visited.where("opened").select("key", "final", "url", F.col("seq").alias("visit"))
    match = corpus.matches_at(phrase, opened.select(F.col("url").alias("at"))).drop("seq", "url")
    found = d.join(opened, F.col("key") == F.col("id")).join(match, F.col("url") == F.col("at")).select(*districts.columns, F.col("final").alias("url"), F.col("visit").alias("seq"), *_HIT[1:])
    found = first_per_key(found, ["id", "url"], [F.col("seq")])
    return Found(best_hits(found, ["id"], settings.max_results).withColumn("search_source", F.lit("crawler")), _read(visited, corpus))


def crawl_corpus(districts: DataFrame, pages: DataFrame | Corpus, phrase: str, settings: SearchSettings = SearchSettings(), *options, **named) -> DataFrame:
    return found_by_crawl(districts, pages, phrase, settings, *options, **named).hits


def _allowed(settings: SearchSettings, robots: DataFrame | None):
    return (lambda urls: R.can_fetch(urls, robots)) if robots is not None and settings.respect_robots else None


def _read(visited: DataFrame, corpus: Corpus) -> DataFrame:
    """id, url, error of the pages visited."""
    errors = corpus.fetched.where("error IS NOT NULL").select(F.col("at").alias("url"), "error")
    return visited.select(F.col("key").alias("id"), "url").join(errors, "url", "left").select("id", "url", "error")


def found_by_api(
    districts: DataFrame, answers: DataFrame, pages: DataFrame | Corpus, phrase: str, settings: SearchSettings = SearchSettings(), robots: DataFrame | None = None
) -> Found:
    """Ranked hits of a web-search API: as the API has them, replaced where the page itself is in the corpus and matches.

    answers: id, json. With a follow_depth, matching pages that many links from a hit are hits too.
    """
    from pagequarry.operators.crawl import crawl

    corpus = Corpus.of(pages, settings)
    base = U.prefer_https(F.col("website"))
    asked = districts.where(U.core_host(F.col("website")) != "").join(answers, "id").withColumn("base", base)
    api = first_per_key(api_hits(asked, settings.api_results), ["id", "url"], [F.col("rank")])
    own = {"status_code": F.lit(None).cast("int"), "content_type": F.lit("search/api"), "search_source": F.lit("brave"), "matched_terms": F.array(F.lit(phrase))}
    api = stored(api.withColumns(own), "api")
    seeds = api.select(F.col("id").alias("key"), "url", "base", F.col("rank").alias("place"))
    edges = corpus.edges if settings.follow_depth else seeds.where("false").select(F.lit("").alias("src"), F.lit("").alias("dst"), F.lit(0).alias("pos"))
    visited = crawl(seeds, edges, settings.max_pages, settings.follow_depth, _allowed(settings, robots), corpus.fetched, moves=False)
    opened = visited.where("opened").select("key", "url", "final", "depth", F.col("seq").cast("int").alias("rank"))
    match = corpus.matches(phrase).drop("seq", "url")
    source = F.when(F.col("depth") == 0, "brave+fetch").otherwise("brave-follow")
    found = districts.join(opened, F.col("key") == F.col("id")).join(match, F.col("url") == F.col("at")).drop("url").withColumnRenamed("final", "url")
    found = first_per_key(found, ["id", "url"], [F.col("rank")]).withColumn("search_source", source).withColumn("score", F.col("score") + bonus(source, F.col("rank")))
    columns = [*districts.columns, *_HIT, "rank", "search_source"]
    merged = with_confirmed(api.select(*columns), found.select(*columns), ["id", "url"])
    return Found(best_hits(merged, ["id"], settings.max_results, "rank"), _read(visited, corpus))


def search_by_api(districts: DataFrame, answers: DataFrame, pages: DataFrame | Corpus, phrase: str, settings: SearchSettings = SearchSettings()) -> DataFrame:
    return found_by_api(districts, answers, pages, phrase, settings).hits
