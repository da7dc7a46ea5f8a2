"""Discovery of search profiles, and search by them, over a page corpus: stages of joins, no driver loop over sites.

A corpus stands in for the network: a URL's page is the row of that canonical URL, a URL without a row
is a 404. pages: url, html and, if they have them, status_code and final_url (where redirects led).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagequarry.functions import html as H
from pagequarry.functions import text as X
from pagequarry.functions import urls as U
from pagequarry.operators import discovery as D
from pagequarry.operators.filters import best_profile, usable_profiles
from pagequarry.operators.ranking import first_per_key, numbered, until
from pagequarry.operators.search import ASKED, Corpus, Found, SearchSettings, best_hits, bonus
from pagequarry.schemas import PROFILE_TESTS, PROFILES
from pagequarry.sources.crawl_rules import can_fetch
from pagequarry.sources.tables import conform, stored

#: Links of a search page that are confirmed; a candidate this sure ends a site's tests.
CONFIRMED_LINKS, SURE = 5, 80
#: Candidates of a site that are tested before it is looked at whether one of them is sure.
FIRST_TESTS = 3
#: Links that are read of a search page under test.
TESTED_LINKS = 10


#: The parameter by which a homepage is asked for past a cache.
PROBE = "_probe"


def homepages(districts: DataFrame, pages: DataFrame | Corpus) -> DataFrame:
    """key, start, base, html, status, provider, challenge, tiny of each organisation with a website; html is null if no page came.

    A homepage that fails is asked for once more (attempt 2). One too small to be the site is asked for again, and
    then past caches, by a URL with a parameter PROBE; such an answer counts if it is no challenge, and larger or not
    too small. base is where the homepage led, in the same organisation, else the website itself.
    """
    corpus = Corpus.of(pages)
    start = U.prefer_https(F.col("website"))
    d = districts.where(U.core_host(F.col("website")) != "").select(F.col("id").alias("key"), start.alias("start")).withColumn("asked", U.canonical(F.col("start")))
    d = stored(d, "websites")
    probe = U.query(F.col("url")).rlike(rf"(^|&){PROBE}=[^&]*$")
    at = F.when(probe, U.canonical(F.regexp_replace("url", rf"[?&]{PROBE}=[^&]*$", ""))).otherwise(F.col("at"))
    every = corpus.every.select(at.alias("at"), "html", F.col("status_code").alias("status"), "final_url", "error", F.when(probe, 3).otherwise(F.col("attempt")).alias("attempt"))
    few = F.broadcast(d) if d.count() <= ASKED else d
    page = F.coalesce("html", F.lit(""))
    told = every.where("attempt <= 3").join(few, F.col("at") == F.col("asked")).select("key", "attempt", F.struct(
        "html", "status", F.col("final_url").alias("final"), D.provider(page, F.col("final_url")).alias("provider"),
        D.is_challenge(F.col("status"), page, F.col("final_url")).alias("challenge"), D.is_tiny(page, F.col("final_url")).alias("tiny"),
        (F.col("error").isNull() & F.col("html").isNotNull() & (F.col("status") < 400)).alias("ok"), F.octet_length(page).alias("size"),
    ).alias("p"))
    tries = told.groupBy("key").agg(*[F.max(F.when(F.col("attempt") == k, F.col("p"))).alias(f"p{k}") for k in (1, 2, 3)])

    def better(now: Column, then: Column) -> Column:
        """then in place of now, if now is too small and then is not, or is larger."""
        take = now["tiny"] & then.isNotNull() & ~then["challenge"] & then["html"].isNotNull() & (~then["tiny"] | (then["size"] > now["size"]))
        return F.when(F.coalesce(take, F.lit(False)), then).otherwise(now)

    good = lambda p: F.coalesce(p["ok"] | p["challenge"], F.lit(False))
    first = X.held(tries, ["key", "p2", "p3"], p=F.when(good(F.col("p1")), F.col("p1")).when(good(F.col("p2")), F.col("p2")))
    second = X.held(first, ["key", "p3"], p=better(F.col("p"), F.col("p2")))
    last = X.held(second, ["key"], p=better(F.col("p"), F.col("p3")))
    both = d.join(last, "key", "left")
    base = F.when(U.same_org(F.col("p.final"), F.col("start")), F.col("p.final")).otherwise(F.col("start"))
    empty = F.lit("")
    return both.select(
        "key",
        "start",
        F.coalesce(base, "start").alias("base"),
        "p.html",
        "p.status",
        F.coalesce("p.provider", D.provider(empty, F.col("start"))).alias("provider"),
        F.coalesce("p.challenge", F.lit(False)).alias("challenge"),
        F.coalesce("p.tiny", D.is_tiny(empty, F.col("start"))).alias("tiny"),
    )


_CANDIDATE = ["key", "base", "provider", "phase", "seq", "profile_type", "search_method", "query_param", "search_url_template", "score_hint"]


#: Linked search pages of a homepage that are opened.
SEARCH_PAGES = 3


def _links_on(site: DataFrame) -> DataFrame:
    return stored(D.link_candidates(site.dropDuplicates(["base", "url"]).select("base", "url", "html")), "links")


def _found_on(site: DataFrame, phase: int, links: DataFrame) -> DataFrame:
    """Candidates on the pages of site (key, base, provider, page, url, html): platform, forms, links of each page, in this order."""
    config = D.platform_config(F.col("html"))
    platform = site.where(config.isNotNull()).select(
        "key", "base", "provider", "page", F.lit(phase).alias("phase"), F.lit(0).alias("seq"), F.lit("known_platform").alias("profile_type"),
        F.lit("GET").alias("search_method"), F.lit("q").alias("query_param"), D.platform_template(config).alias("search_url_template"), F.lit(45).alias("score_hint"),
    )
    one = site.dropDuplicates(["base", "url"]).select("base", "url", "html")
    forms = D.form_candidates(one).select("base", "page_url", F.lit(phase + 1).alias("phase"), "seq", "profile_type", "search_method", "query_param", "search_url_template", "score_hint")
    links = links.where("profile_type = 'url_template'")
    key_value = F.concat(F.lit("([?&])"), F.col("query_param"), F.lit("=[^&]*"))
    template = F.regexp_replace(F.col("url"), key_value, F.concat(F.lit("$1"), F.col("query_param"), F.lit("={query}")))
    links = links.select("base", "page_url", F.lit(phase + 2).alias("phase"), "seq", "profile_type", F.lit("GET").alias("search_method"), "query_param", template.alias("search_url_template"), "score_hint")
    names = site.select("key", "base", "provider", "page", F.col("url").alias("page_url")).distinct()
    by_page = forms.unionByName(links).join(names, ["base", "page_url"]).select(*_CANDIDATE, "page")
    return platform.select(*_CANDIDATE, "page").unionByName(by_page)


def search_pages(site: DataFrame, pages: DataFrame | Corpus, links: DataFrame, robots: DataFrame | None = None) -> DataFrame:
    """The first three pages that each homepage links as its search, where they can be had: as site, page is the place of the link.

    links: what link_candidates gives for the homepages.
    """
    linked = links.where("profile_type = 'search_page_link'").select("base", F.col("url").alias("linked"), "seq")
    ranked = _permitted(numbered(linked, ["base"], [F.col("seq")], "page").where(F.col("page") <= SEARCH_PAGES).drop("seq"), "linked", robots)
    there = Corpus.of(pages).answering(stored(ranked, "search-links"), "linked").where("error IS NULL AND status_code < 400 AND html IS NOT NULL")
    return there.select("base", "page", F.col("linked").alias("url"), "html").join(site.select("key", "base", "provider").distinct(), "base")


def candidates(homes: DataFrame, pages: DataFrame | Corpus, robots: DataFrame | None = None) -> DataFrame:
    """Candidates of each homepage, GET, each once, ten at most: its own, those of the search pages it links, common templates.

    The candidates of a page are its platform, forms and links, in this order.
    """
    found = homes.where("html IS NOT NULL AND NOT challenge")
    site = found.select("key", "base", "provider", F.lit(0).alias("page"), F.col("base").alias("url"), "html")
    names = site.select("key", "base", "provider").distinct()
    common = D.common_templates(site.sparkSession, site.select("base").distinct()).select(
        "base", F.lit(6).alias("phase"), "seq", F.lit("url_template").alias("profile_type"), F.lit("GET").alias("search_method"), "query_param", "search_url_template", F.lit(0).alias("score_hint")
    )
    common = common.join(names, "base").select(*_CANDIDATE, F.lit(0).alias("page"))
    links = _links_on(site)
    nested = stored(search_pages(site, pages, links, robots), "search-pages")
    every = _found_on(site, 0, links).unionByName(_found_on(nested, 3, _links_on(nested))).unionByName(common)
    last = F.when(F.col("phase") == 6, 1).otherwise(0)
    ordered = numbered(every, ["key"], [last, F.col("page"), F.col("phase"), F.col("seq")], "place_all").drop("seq", "page").withColumnRenamed("place_all", "seq")
    return stored(D.unique_candidates(ordered, 10), "candidates")


def tested(cands: DataFrame, pages: DataFrame | Corpus, query: str, robots: DataFrame | None = None) -> DataFrame:
    """Each candidate with the answer that its URL gets, its links, how many of them confirm, confidence and status.

    A platform's candidate is answered in JSON, any other by a page. What robots (host, status_code, body) deny is not
    opened.
    """
    corpus = Corpus.of(pages)
    asked = cands.withColumn("attempted_url", U.search_url(F.col("search_url_template"), F.lit(query))).withColumn("blocked", F.lit(False))
    if robots is not None:
        may = can_fetch(asked.select(F.col("attempted_url").alias("url")).distinct(), robots).select(F.col("url").alias("attempted_url"), F.lit(True).alias("may"))
        asked = asked.drop("blocked").join(stored(may, "allowed"), "attempted_url", "left")
        asked = asked.select(*[c for c in asked.columns if c != "may"], F.col("may").isNull().alias("blocked"))
    opened = F.when(~F.col("blocked"), U.canonical(F.col("attempted_url")))
    asked = stored(asked.withColumns({"opened": opened, "searched": F.col("attempted_url"), "json": F.col("profile_type") == "known_platform"}), "asked")
    own = ["key", "place"]
    answer = corpus.answering(asked.select(*own, "opened", "base", "provider", "searched", "json"), "opened")
    page = F.coalesce("html", F.lit(""))
    head = F.concat_ws(" ", H.title(page), F.array_join(H.headings(page), " "))
    redirect = F.coalesce(D.is_homepage_redirect(F.col("final_url"), F.col("base"), F.lit(query)), F.lit(False))
    place = F.when(redirect, F.col("searched")).otherwise(F.col("final_url"))
    links = F.when(~F.col("json"), D.result_links(page, place, F.col("base"), F.col("searched"), F.lit(TESTED_LINKS)))
    answer = answer.select(
        *own,
        "base",
        "searched",
        "json",
        F.when(F.col("json"), F.col("html")).alias("html"),
        "final_url",
        F.col("error").alias("fetch_error"),
        F.col("status_code").alias("status"),
        (~F.col("json") & redirect).alias("redirect"),
        D.is_challenge(F.col("status_code"), page, F.col("final_url")).alias("challenged"),
        (~F.col("json") & X.fold(head).contains("search")).alias("search_title"),
        (~F.col("json") & D.suggests_javascript(page, F.col("provider"))).alias("javascript"),
        F.coalesce(links, F.array().cast(D._RESULT)).alias("links"),
    )
    answer = stored(answer, "answers")
    whole = answer.where("fetch_error IS NULL")
    data = answered_links(whole.where("json"), own, F.lit(TESTED_LINKS), TESTED_LINKS)
    links = stored(whole.where("NOT json").select(*own, F.inline("links")).unionByName(data), "links")
    matched = corpus.matches(query).select(F.col("at").alias("url"), F.lit(1).alias("hit")).distinct()
    confirmed = links.where(F.col("rank") <= CONFIRMED_LINKS).join(matched, "url", "left")
    told = confirmed.groupBy(*own).agg(F.count("hit").alias("confirmed")).join(links.groupBy(*own).agg(F.count("*").cast("int").alias("n")), own)
    answered = answer.select(*own, "status", "redirect", "challenged", "search_title", "javascript", "fetch_error")
    both = asked.drop("opened", "searched", "json").join(answered, own, "left").join(told, own, "left").fillna(0, ["confirmed", "n"])
    both = both.fillna(False, ["redirect", "challenged", "search_title", "javascript"]).withColumn("status", F.coalesce("status", F.lit(404)))
    n = F.col("n")
    parts = {
        "hint": F.col("score_hint"),
        "status": F.col("status"),
        "challenge": F.col("challenged"),
        "redirect": F.col("redirect"),
        "platform": F.col("profile_type") == "known_platform",
        "links": n,
        "same_org": n > 0,
        "search_title": F.col("search_title"),
        "confirmed": F.col("confirmed"),
        "blocked": F.col("blocked"),
    }
    points = D.confidence(parts)
    probable = (n == 0) & F.col("javascript") & (F.col("status") < 400)
    scored = both.withColumn("confidence", points).withColumn("test_success", F.col("confirmed") > 0).withColumn("test_result_count", n)
    scored = scored.withColumn("profile_status", D.status(F.col("confidence"), F.col("confirmed"), F.col("blocked"), F.col("challenged"), probable))
    return scored.drop("n", "search_title", "javascript")


def tests_made(tests: DataFrame, query: str) -> DataFrame:
    """Tests as rows of PROFILE_TESTS."""
    error = (
        F.when(F.col("blocked"), "robots.txt denies it.")
        .when(F.col("challenged"), "A challenge page came back.")
        .when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    )
    rows = tests.withColumns({"error_message": error, "test_query": F.lit(query), "created_at": F.current_timestamp()})
    renamed = {"key": "district_id", "status": "status_code", "test_result_count": "result_count", "test_success": "success"}
    return conform(rows.withColumnsRenamed(renamed), PROFILE_TESTS)


def outcome_counts(rows: DataFrame) -> DataFrame:
    """How a discovery ended, in numbers."""
    s = F.col("profile_status")
    known = ("working", "manual_review", "requires_javascript")
    return rows.agg(
        F.count("*").alias("processed"),
        *[F.count_if(s == k).alias(k) for k in known],
        F.count_if(~s.isin(*known)).alias("failed"),
        F.count_if(s == "no_search_found").alias("no_search_found"),
        F.count_if(F.coalesce(F.col("provider_guess"), F.lit("")) == "").alias("unknown_provider"),
    )


def run_discovery(districts: DataFrame, pages: DataFrame, path: str, history: str | None = None, **options) -> dict[str, int]:
    """Discover, write the profiles at `path` and append the tests at `history`; the counters of the outcome."""
    discover(districts, pages, history=history, **options).write.mode("overwrite").parquet(path)
    return outcome_counts(districts.sparkSession.read.parquet(path)).first().asDict()


def discover(
    districts: DataFrame,
    pages: DataFrame,
    query: str = "calendar",
    known: DataFrame | None = None,
    force: bool = False,
    robots: DataFrame | None = None,
    history: str | None = None,
) -> DataFrame:
    """One profile a site, as rows of PROFILES. Sites that have a working profile keep it unless force.

    The tests that were made are appended at the path `history`, as rows of PROFILE_TESTS.
    """
    if known is not None and not force:
        working = usable_profiles(known).select(F.col("district_id").alias("id")).distinct()
        districts = districts.join(working, "id", "left_anti")
    corpus = Corpus.of(pages)
    homes = homepages(districts, corpus)
    if robots is not None:
        may = can_fetch(homes.select(F.col("start").alias("url")).distinct(), robots).select(F.col("url").alias("start"), F.lit(True).alias("may"))
        homes = homes.join(may, "start", "left").withColumn("denied", F.col("may").isNull()).drop("may")
    homes = stored(homes if robots is not None else homes.withColumn("denied", F.lit(False)), "homes")
    cands = candidates(homes.where("NOT denied"), corpus, robots)
    sure = (F.col("profile_status") == "working") & (F.col("confidence") >= SURE)
    tests = stored(tested(cands.where(F.col("place") <= FIRST_TESTS), corpus, query, robots), "tests")
    rest = stored(cands.where(F.col("place") > FIRST_TESTS).join(tests.where(sure).select("key").distinct(), "key", "left_anti"), "rest")
    if not rest.isEmpty():
        tests = tests.unionByName(tested(rest, corpus, query, robots))
    tests = until(tests, ["key"], "place", sure)
    if history:
        tests_made(tests, query).write.mode("append").parquet(history)
    best = D.best_test(tests.withColumnRenamed("key", "district_id"), "district_id", "place")
    columns = ["district_id", "profile_type", "search_method", "query_param", "search_url_template", "confidence", "test_success", "test_result_count", "profile_status"]
    both = homes.join(best.select(*columns), F.col("key") == F.col("district_id"), "left").drop("district_id")
    status = F.when(F.col("denied"), "blocked_by_robots").when(F.col("html").isNull(), "error").when(F.col("challenge"), "blocked_by_challenge").otherwise(F.coalesce("profile_status", F.lit("no_search_found")))
    tiny = F.col("tiny") & F.col("html").isNotNull() & (F.coalesce("profile_status", F.lit("")) != "working")
    end = D.forced_outcome(F.col("provider"), status, F.coalesce("confidence", F.lit(0.0)), F.col("search_url_template"), tiny)
    rows = both.withColumn("end", end).select(
        F.col("key").alias("district_id"),
        F.col("start").alias("website_normalized"),
        F.col("end.status").alias("profile_status"),
        "profile_type",
        F.col("provider").alias("provider_guess"),
        F.col("end.template").alias("search_url_template"),
        "search_method",
        "query_param",
        F.lit(True).alias("same_domain_only"),
        (F.col("end.status") != status).alias("requires_javascript"),
        F.col("end.confidence").alias("confidence"),
        F.lit(query).alias("test_query"),
        "test_result_count",
        "test_success",
        F.when(F.col("denied"), "robots.txt denies the homepage.").when(F.col("html").isNull(), "The homepage could not be fetched.").when(F.col("challenge"), "The homepage is a challenge page.").alias("error_message"),
    )
    return conform(rows, PROFILES)


def found_by_profile(
    districts: DataFrame, profiles: DataFrame, pages: DataFrame | Corpus, phrase: str, settings: SearchSettings = SearchSettings(), robots: DataFrame | None = None
) -> Found:
    """Hits of each site's own search, by its best profile, kept where the page itself matches; k best a site.

    A platform's profile is answered in JSON, any other by a page of links: each answer is read as what it is, in one
    plan. A challenge, an error or a status from 400 on gives nothing; what is no JSON has no hits.
    """
    corpus = Corpus.of(pages, settings)
    best = best_profile(usable_profiles(profiles)).select(F.col("district_id").alias("id"), "search_url_template", "provider_guess")
    asked = districts.join(best, "id").withColumn("searched", U.search_url(F.col("search_url_template"), F.lit(phrase)))
    asked = asked.withColumns({"base": U.prefer_https(F.col("website")), "asked": U.canonical(F.col("searched")), "json": D.is_platform(F.col("provider_guess"), F.col("search_url_template"))})
    asked = stored(_permitted(asked, "searched", robots if settings.respect_robots else None), "asked")
    answer = stored(corpus.answering(asked, "asked"), "answers").where("error IS NULL")  # one scan of the pages, for links and JSON
    answer = answer.where((F.col("status_code") < 400) & ~D.is_challenge(F.col("status_code"), F.col("html"), F.col("final_url")))
    most = max(3 * settings.max_results, 10)
    links = stored(answered_links(answer, ["id"], F.lit(most), most), "links")
    at = U.canonical(F.col("url"))
    wanted = _permitted(links, "url", robots if settings.respect_robots else None)
    found = districts.join(wanted.select("id", at.alias("linked"), "rank"), "id").join(corpus.matches(phrase).drop("seq"), F.col("linked") == F.col("at"))
    source = F.lit("district_search+fetch")
    scored = found.withColumn("url", U.canonical(F.col("url"))).withColumn("score", F.col("score") + bonus(source, F.col("rank"))).withColumn("search_source", source)
    ranked = best_hits(first_per_key(scored.drop("at", "linked"), ["id", "url"], [F.desc("score"), F.col("rank")]), ["id"], settings.max_results, "rank")
    errors = corpus.fetched.select(F.col("at").alias("asked"), "error")
    read = asked.select("id", "asked").unionByName(wanted.select("id", at.alias("asked"))).join(errors, "asked", "left")
    return Found(ranked, read.select("id", F.col("asked").alias("url"), "error"))


def search_by_profile(districts: DataFrame, profiles: DataFrame, pages: DataFrame | Corpus, phrase: str, settings: SearchSettings = SearchSettings()) -> DataFrame:
    return found_by_profile(districts, profiles, pages, phrase, settings).hits


def _permitted(rows: DataFrame, url: str, robots: DataFrame | None) -> DataFrame:
    """rows whose URL robots does not deny."""
    if robots is None:
        return rows
    may = can_fetch(rows.select(F.col(url).alias("url")).distinct(), robots).select(F.col("url").alias("__may"))
    return rows.join(stored(may, "allowed"), F.col(url) == F.col("__may")).drop("__may")


def answered_links(answer: DataFrame, keys: list[str], most: Column, cap: int) -> DataFrame:
    """keys, url, title, snippet, rank of the hits that answers hold; answer: keys, base, searched, final_url, json (whether it is), html."""
    html = answer.where(~F.col("json"))
    page = html.select(*keys, F.inline(D.result_links(F.col("html"), F.col("final_url"), F.col("base"), F.col("searched"), most)))
    key = F.struct(*keys)
    data = answer.where("json").select(key.alias("key"), "base", "searched", F.col("html").alias("json"))
    found = D.platform_results(data, cap).select(*[F.col(f"key.{k}").alias(k) for k in keys], "url", "title", "snippet", "rank")
    return page.unionByName(found)
