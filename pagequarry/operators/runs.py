"""Search and discovery runs: a run row, batches of its organisations, its events and results.

State goes queued -> running -> completed, cancelled or failed. A run that was running when the driver
stopped is queued again, and running it again replaces its own results only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagequarry.operators.filters import clean_values, listed, matching
from pagequarry.operators.profiles import found_by_profile
from pagequarry.operators.search import Corpus, Found, SearchSettings, found_by_api, found_by_crawl, found_in_corpus, with_fallback
from pagequarry.operators.upsert import write_run
from pagequarry.schemas import EVENTS, EXPORT_COLUMNS, RESULTS, SEARCH_METHODS
from pagequarry.sources.tables import conform, delete, exists, scope, stored

PRICE = 0.005
NOT_STARTED, STOPPED = "Cancelled; nothing was searched.", "The user cancelled the run."
API_METHODS = ("brave", "hybrid")


def now() -> datetime:
    return datetime.now(timezone.utc).replace(microsecond=0, tzinfo=None)


@dataclass(frozen=True)
class Run:
    id: int
    query_text: str
    states: tuple[str, ...] = ()
    agency_types: tuple[str, ...] = ()
    min_enrollment: int | None = None
    max_enrollment: int | None = None
    max_districts: int = 25
    search_method: str = "crawler"
    status: str = "queued"
    cancel_requested: bool = False
    districts_matched: int = 0
    districts_searched: int = 0
    districts_failed: int = 0
    started_at: datetime = field(default_factory=now)
    finished_at: datetime | None = None
    error_message: str | None = None
    batches: int = 1
    next_batch: int = 0
    owner: str | None = None
    lease_until: datetime | None = None

    @property
    def wanted(self) -> dict:
        return {k: getattr(self, k) for k in ("states", "agency_types", "min_enrollment", "max_enrollment")}


def create(districts: DataFrame, run_id: int, text: str, *, max_districts: int | None = None, limit: int = 25, method: str = "crawler", **wanted) -> Run:
    """A queued run with the number of organisations that match; the cap is held between 1 and limit."""
    text = " ".join(text.split())
    if not text:
        raise ValueError("Enter text to search for.")
    cap = max(1, min(limit, max_districts or limit))
    method = method if method in SEARCH_METHODS else "crawler"
    wanted = {k: tuple(clean_values(v)) if k in ("states", "agency_types") else v for k, v in wanted.items()}
    run = Run(run_id, text, max_districts=cap, search_method=method, **wanted)
    return replace(run, districts_matched=matching(districts, **run.wanted).count())


def cost(matched: int, cap: int, method: str) -> float:
    return min(matched, cap) * PRICE if method in API_METHODS else 0.0


def cost_of(matched: Column, cap: Column, method: Column) -> Column:
    """The same for rows."""
    return F.when(method.isin(*API_METHODS), F.round(F.least(matched, cap) * PRICE, 3)).otherwise(0.0)


def cancel(run: Run) -> Run:
    """A queued run ends at once; a running one is flagged and its job interrupted by tag."""
    if run.status == "queued":
        return replace(run, status="cancelled", cancel_requested=True, finished_at=now())
    if run.status == "running":
        return replace(run, cancel_requested=True)
    return run


#: Tags of runs whose jobs were interrupted by this driver.
_INTERRUPTED: set[str] = set()


def interrupt(spark: SparkSession, run: Run) -> None:
    _INTERRUPTED.add(_tag(run))
    spark.interruptTag(_tag(run))


def _tag(run: Run) -> str:
    return f"pagequarry-run-{run.id}"


def recover(runs: list[Run]) -> list[Run]:
    """At start: what was running is queued again, in order of id."""
    return sorted((replace(r, status="queued") if r.status == "running" else r for r in runs), key=lambda r: r.id)


def recovered(stored_runs: DataFrame) -> DataFrame:
    """The same for a stored table of runs."""
    return stored_runs.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


@dataclass(frozen=True)
class Sources:
    """What a run may search besides the pages: API answers (id, json), profiles, sitemaps (url, body), robots (host, status_code, body)."""

    answers: DataFrame | None = None
    profiles: DataFrame | None = None
    sitemaps: DataFrame | None = None
    robots: DataFrame | None = None
    crawl_depth: int | None = None
    crawl: bool = False


FALLBACK_METHODS = ("hybrid", "district_search_hybrid", "district_search_browser_hybrid")
FALLBACK_LABEL = "district_search+fallback_crawler"
_HITS = "url string, title string, snippet string, score double, matched_terms array<string>, status_code int, content_type string, result_rank int, search_source string"
_READ = "url string, error string"


def _chosen(run: Run, districts: DataFrame) -> DataFrame:
    return listed(districts, run.max_districts, **run.wanted)


def searched_by(
    method: str, chosen: DataFrame, pages: DataFrame | Corpus, phrase: str, settings: SearchSettings, sources: Sources = Sources(), known: dict[str, Found] | None = None
) -> Found:
    """Ranked hits by a run's method, and what was read for them: the corpus or a crawl of it, an API's answers, or each site's own search.

    Hybrid methods take the crawler for organisations that have no hit else. Without a script engine the browser
    methods find what the plain ones find. known: what other methods found for the same organisations, by what they
    searched; it is not searched again, and what is searched for all of them is stored and added.
    """
    corpus = Corpus.of(pages, settings)
    columns = [c.split()[0] for c in _HITS.split(", ")]

    def none(kind: str) -> DataFrame:
        fields = [f.split(" ", 1) for f in kind.split(", ")]
        return chosen.where("false").select(*(chosen.columns if kind == _HITS else ["id"]), *[F.lit(None).cast(t).alias(n) for n, t in fields])

    def crawler(some: DataFrame) -> Found:
        if sources.crawl_depth is None and not sources.crawl:
            return found_in_corpus(some, corpus, phrase, settings)
        return found_by_crawl(some, corpus, phrase, settings, sources.crawl_depth, sources.sitemaps, sources.robots)

    def once(what: str, search: Callable[[], Found]) -> Found:
        if known is None:
            return search()
        if what not in known:
            found = search()
            known[what] = Found(stored(found.hits, f"{what}-hits"), found.read)
        return known[what]

    if method == "crawler":
        return once("crawler", lambda: crawler(chosen))
    first, label = None, None
    if method in API_METHODS:
        first = once("api", lambda: found_by_api(chosen, sources.answers, corpus, phrase, settings, sources.robots)) if sources.answers is not None else None
    else:
        first = once("profile", lambda: found_by_profile(chosen, sources.profiles, corpus, phrase, settings, sources.robots)) if sources.profiles is not None else None
        label = FALLBACK_LABEL
    first = first or Found(none(_HITS), none(_READ))
    if method not in FALLBACK_METHODS:
        return first
    hits = first.hits.select(*chosen.columns, *columns)
    hits = stored(hits, "first-hits") if known is None else hits
    answered = hits.select("id").distinct()
    if known is not None and "crawler" in known:
        rest = Found(known["crawler"].hits, known["crawler"].read.join(answered, "id", "left_anti").select("id", "url", "error"))
    else:
        rest = crawler(chosen.join(answered, "id", "left_anti").select(chosen.columns))
    both = with_fallback(hits, rest.hits.select(*chosen.columns, *columns), "id", label)
    return Found(both, first.read.unionByName(rest.read))


def found_by(method: str, chosen: DataFrame, pages: DataFrame | Corpus, phrase: str, settings: SearchSettings, sources: Sources = Sources()) -> DataFrame:
    return searched_by(method, chosen, pages, phrase, settings, sources).hits


def found_by_each(methods: Iterable[str], chosen: DataFrame, pages: DataFrame | Corpus, phrase: str, settings: SearchSettings, sources: Sources = Sources()) -> DataFrame:
    """The hits of each method, with the method: what several of them search is searched once."""
    corpus, known, out = Corpus.of(pages, settings), {}, None
    for method in methods:
        found = searched_by(method, chosen, corpus, phrase, settings, sources, known).hits
        found = found.select(F.lit(method).alias("method"), *chosen.columns, *[c.split()[0] for c in _HITS.split(", ")])
        out = found if out is None else out.unionByName(found)
    return out


def _as_results(run: Run, found: DataFrame) -> DataFrame:
    """Hits as rows of RESULTS, with a copy of each organisation."""
    named = found.withColumn("search_run_id", F.lit(run.id)).withColumn("created_at", F.lit(now()))
    renamed = {"id": "district_id", "agency_name": "district_name", "enrollment": "total_enrollment_excludes_ae"}
    return conform(named.withColumnsRenamed(renamed), RESULTS)


def results_of(run: Run, districts: DataFrame, pages: DataFrame | Corpus, settings: SearchSettings = SearchSettings(), sources: Sources = Sources()) -> DataFrame:
    """The run's ranked hits, found by its method."""
    return _as_results(run, found_by(run.search_method, _chosen(run, districts), pages, run.query_text, settings, sources))


def outcomes(run: Run, chosen: DataFrame, results: DataFrame, sources: Sources = Sources(), read: DataFrame | None = None) -> DataFrame:
    """One row per organisation of a run: district_id, district, stored (its hits), page_errors, failed, error.

    An organisation fails by itself: under the API method, where its answer is missing or no JSON; under any method,
    where each page that was read for it (id, url, error) is an error. Other errors of pages are counted. The others of
    the run are searched all the same, and a failed one counts as searched too.
    """
    hits = results.where(F.col("search_run_id") == run.id).groupBy(F.col("district_id").alias("id")).agg(F.count("*").alias("stored"))
    rows = chosen.select("id", F.col("agency_name").alias("district")).join(hits, "id", "left").fillna(0, ["stored"])
    error = F.lit(None).cast("string")
    if run.search_method == "brave" and sources.answers is None:
        error = F.lit("The API gave no answer.")
    elif run.search_method == "brave":
        rows = rows.join(sources.answers.groupBy("id").agg(F.max("json").alias("json")), "id", "left")
        error = F.when(F.col("json").isNull(), "The API gave no answer.").when(F.try_parse_json("json").isNull(), "The API's answer is no JSON.")
    if read is None:
        rows = rows.withColumn("page_errors", F.lit(0).cast("long"))
    else:
        each = read.groupBy("id").agg(F.count("*").alias("n"), F.count("error").alias("page_errors"), F.min("error").alias("first"))
        rows = rows.join(each, "id", "left").fillna(0, ["page_errors"])
        error = F.coalesce(error, F.when((F.col("stored") == 0) & (F.col("page_errors") == F.col("n")), F.concat(F.lit("No page could be read: "), F.col("first"))))
    return rows.select(F.col("id").alias("district_id"), "district", "stored", "page_errors", error.isNotNull().alias("failed"), error.alias("error"))


def execute(
    run: Run,
    districts: DataFrame,
    pages: DataFrame,
    path: str,
    settings: SearchSettings = SearchSettings(),
    crawl_depth: int | None = None,
    crawl: bool = False,
    sources: Sources | None = None,
    events: str | None = None,
    cancelled: Callable[[], bool] = lambda: False,
    batch: int | None = None,
    progress: Callable[[Run], None] = lambda run: None,
) -> Run:
    """Run the organisations in batches of about `batch` (one batch without), each a job that writes its folder and, at `events`, its log.

    After each batch progress gets the run with its counters, and cancelled is asked, as it is before the start; hits
    that are stored stay. A run whose next_batch is not 0 goes on there. What the batches share (matching pages,
    links) is made once. An error of what they share is the run's, not the caller's.
    """
    if run.cancel_requested or run.status == "cancelled" or cancelled():
        return replace(run, status="cancelled", finished_at=run.finished_at or now(), error_message=run.error_message or NOT_STARTED)
    sources = replace(sources or Sources(), **({"crawl_depth": crawl_depth, "crawl": crawl} if crawl or crawl_depth is not None else {}))
    spark = districts.sparkSession
    spark.addTag(_tag(run))
    _INTERRUPTED.discard(_tag(run))
    if not run.next_batch:
        run = replace(run, started_at=now(), districts_searched=0, districts_failed=0)
    run = replace(run, status="running", finished_at=None, error_message=None)
    keep: list[DataFrame] = []
    try:
        with scope(keep):
            chosen = stored(_chosen(run, districts), "chosen")
            if not run.next_batch:
                n = chosen.count()
                run = replace(run, batches=max(1, -(-n // batch)) if batch else 1)
                delete(spark, f"{path}/search_run_id={run.id}")
                if events:
                    log_event(spark, events, run.id, "run_start", query=run.query_text, method=run.search_method, districts=n)
            progress(run)
            corpus = Corpus.of(pages, settings)
            if run.batches > 1:
                corpus.matches(run.query_text)
            while run.next_batch < run.batches:
                run = _batch(run, chosen, corpus, path, settings, sources, events)
                progress(run)
                if cancelled():
                    run = replace(run, status="cancelled", error_message=STOPPED)
                    break
            run = replace(run, status=run.status if run.status == "cancelled" else "completed", finished_at=now())
        if events:
            log_event(spark, events, run.id, "run_finish", status=run.status, searched=run.districts_searched, failed=run.districts_failed)
        return run
    except Exception as e:
        state = "cancelled" if _tag(run) in _INTERRUPTED else "failed"
        return replace(run, status=state, error_message=str(e)[:1000], finished_at=now())
    finally:
        spark.removeTag(_tag(run))


def _batch(run: Run, chosen: DataFrame, corpus: Corpus, path: str, settings: SearchSettings, sources: Sources, events: str | None) -> Run:
    """Search the run's next batch, store its hits and events; the run with its counters."""
    spark = chosen.sparkSession
    some = chosen.where(F.pmod(F.xxhash64("id"), F.lit(run.batches)) == run.next_batch) if run.batches > 1 else chosen
    found = searched_by(run.search_method, some, corpus, run.query_text, settings, sources)
    write_run(_as_results(run, found.hits).withColumn("batch", F.lit(run.next_batch)), path, "batch")
    done = results_at(spark, path).where(F.col("search_run_id") == run.id)
    read = stored(found.read, "read")
    each = stored(outcomes(run, some, done, sources, read), "outcomes")
    n, failed = each.agg(F.count("*"), F.count_if("failed")).first()
    run = replace(run, districts_searched=run.districts_searched + n, districts_failed=run.districts_failed + failed, next_batch=run.next_batch + 1)
    if events:
        log_batch(run, each, read, events)
    return run


def results_at(spark: SparkSession, path: str) -> DataFrame:
    """The stored hits of all runs; none where no run has stored any."""
    if not exists(spark, path):
        return spark.createDataFrame([], RESULTS)
    return spark.read.schema(RESULTS).parquet(path).select(RESULTS.names)


def log_run(run: Run, each: DataFrame, path: str) -> None:
    """Append the events of a run that is over: its start, one for each organisation, its end."""
    log_event(each.sparkSession, path, run.id, "run_start", run.started_at, query=run.query_text, method=run.search_method, districts=run.districts_searched)
    log_batch(run, each, each.where("false").select(F.col("district_id").alias("id"), F.lit("").alias("url"), F.lit("").alias("error")), path, run.finished_at)
    log_event(each.sparkSession, path, run.id, "run_finish", run.finished_at, status=run.status, searched=run.districts_searched, failed=run.districts_failed)


def log_batch(run: Run, each: DataFrame, read: DataFrame, path: str, at: datetime | None = None) -> None:
    """Append a batch's events: one for each organisation, one for each page that was an error."""
    fields = F.when(F.col("failed"), F.create_map(F.lit("district"), "district", F.lit("error"), "error")).otherwise(
        F.create_map(F.lit("district"), "district", F.lit("stored_results"), F.col("stored").cast("string"))
    )
    name = F.when(F.col("failed"), "district_error").otherwise("district_results_stored")
    head = [F.lit(at or now()).alias("ts"), F.lit(run.id).cast("long").alias("run_id")]
    rows = each.select(*head, name.alias("event"), fields.alias("fields"))
    broken = read.where("error IS NOT NULL").join(each.select(F.col("district_id").alias("id"), "district"), "id")
    told = F.create_map(F.lit("district"), "district", F.lit("url"), "url", F.lit("error"), "error")
    rows.unionByName(broken.select(*head, F.lit("page_error").alias("event"), told.alias("fields"))).write.mode("append").parquet(path)


def run_search(
    spark: SparkSession, districts: DataFrame, pages: DataFrame, text: str, path: str, run_id: int = 1,
    crawl_depth: int | None = None, crawl: bool = False, sources: Sources | None = None, events: str | None = None, batch: int | None = None, **options,
) -> tuple[Run, DataFrame]:
    """Create and execute a run, and read its results."""
    run = execute(create(districts, run_id, text, **options), districts, pages, path, crawl_depth=crawl_depth, crawl=crawl, sources=sources, events=events, batch=batch)
    return run, results_at(spark, path).where(F.col("search_run_id") == run_id)


def exported(results: DataFrame, runs: DataFrame) -> DataFrame:
    """The 15 columns of an export for the results of these runs."""
    named = runs.select(F.col("id").alias("run_id"), F.col("query_text").alias("run_query"))
    rows = results.join(named, F.col("search_run_id") == F.col("run_id"))
    return rows.withColumn("enrollment", F.col("total_enrollment_excludes_ae")).select(*EXPORT_COLUMNS)


def export(results: DataFrame, runs: DataFrame, run_id: int) -> DataFrame:
    """A run's export, by organisation and rank."""
    return exported(results, runs.where(F.col("id") == run_id)).orderBy("district_name", "result_rank")


def runs_table(spark: SparkSession, runs: list[Run]) -> DataFrame:
    from pagequarry.schemas import RUNS

    have = {f.name for f in RUNS}
    rows = [{k: list(v) if isinstance(v, tuple) else v for k, v in asdict(r).items() if k in have} for r in runs]
    return spark.createDataFrame([tuple(r.get(f.name) for f in RUNS) for r in rows], RUNS)


def log_event(spark: SparkSession, path: str, run_id: int, event: str, at: datetime | None = None, **fields) -> None:
    """Append one event."""
    row = (at or now(), run_id, event, {k: str(v) for k, v in sorted(fields.items())})
    spark.createDataFrame([row], EVENTS).coalesce(1).write.mode("append").parquet(path)


def log_lines(events: DataFrame) -> DataFrame:
    """Events as lines: time, event and its fields in order."""
    pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), F.to_json(F.struct(e["value"].alias("v")))))
    return events.select("ts", F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "event", F.array_join(pairs, " ")).alias("line"))


def analyse_match(hit: dict) -> dict:
    """Hook for a model's opinion on a hit; nothing is plugged in, so it has none."""
    return {"is_likely_match": None, "confidence": None, "explanation": None}
