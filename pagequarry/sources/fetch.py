"""Pages from a stored corpus, or from the network by a fetcher that the caller plugs in.

The corpus is the default: a table of url, html and, if it has them, status_code and content_type.
A live fetch runs one task per host group so that the delay between requests holds per host.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pagequarry.functions import urls

HTML_CAP, PDF_CAP = 5 << 20, 10 << 20
FETCHED = "url string, final_url string, status_code int, content_type string, content binary, error string"


@dataclass(frozen=True)
class FetchSettings:
    timeout: float = 15.0
    delay: float = 0.75
    html_cap: int = HTML_CAP
    pdf_cap: int = PDF_CAP
    user_agent: str = "pagequarry/1"
    retry_without_tls_check: bool = False


class TextExtractor(Protocol):
    """Binary document -> text, for formats that no installed library reads (PDF)."""

    def __call__(self, content: bytes) -> str: ...


class Browser(Protocol):
    """URL -> (final URL, DOM), for pages that need a script engine."""

    def __call__(self, url: str, timeout: float) -> tuple[str, str]: ...


def is_pdf(content_type: Column, url: Column) -> Column:
    return F.coalesce(F.lower(content_type).contains("pdf"), F.lit(False)) | F.lower(urls.path(url)).endswith(".pdf")


def kind(content_type: Column, url: Column) -> Column:
    """application/pdf, text/html (html, plain text or no type), or null for what is skipped."""
    c = F.lower(F.coalesce(content_type, F.lit("")))
    page = (c == "") | c.contains("html") | c.contains("text/plain")
    return F.when(is_pdf(content_type, url), "application/pdf").when(page, "text/html")


def within_cap(content: Column, content_type: Column, url: Column, html_cap: int = HTML_CAP, pdf_cap: int = PDF_CAP) -> Column:
    return F.octet_length(content) <= F.when(is_pdf(content_type, url), pdf_cap).otherwise(html_cap)


def from_corpus(frontier: DataFrame, pages: DataFrame, settings: FetchSettings = FetchSettings()) -> DataFrame:
    """frontier (url, ...) joined to the corpus by canonical URL: final_url, status_code, content_type, html."""
    have = set(pages.columns)
    other = {"status_code": F.lit(200), "content_type": F.lit("text/html")}
    known = pages.select(
        urls.canonical(F.col("url")).alias("final_url"),
        "html",
        *[(F.col(c) if c in have else v).alias(c) for c, v in other.items()],
    )
    known = known.where(within_cap(F.col("html"), F.col("content_type"), F.col("final_url"), settings.html_cap, settings.pdf_cap))
    return frontier.join(known, frontier["url"] == known["final_url"]).where("status_code < 400")


def get(url: str, settings: FetchSettings) -> tuple[str, int, str, bytes]:
    """One bounded GET."""
    import ssl

    request = urllib.request.Request(url, headers={"User-Agent": settings.user_agent, "Accept": "text/html,application/pdf;q=0.9,*/*;q=0.5"})

    def once(context):
        try:
            r = urllib.request.urlopen(request, timeout=settings.timeout, context=context)
        except urllib.error.HTTPError as e:
            r = e
        kind_ = r.headers.get("Content-Type", "")
        cap = settings.pdf_cap if "pdf" in kind_.lower() or url.lower().split("?")[0].endswith(".pdf") else settings.html_cap
        body = r.read(cap + 1)
        if len(body) > cap:
            raise ValueError("Response is larger than the cap.")
        return r.geturl(), r.status, kind_, body

    try:
        return once(None)
    except urllib.error.URLError as e:
        if settings.retry_without_tls_check and isinstance(e.reason, ssl.SSLError):
            return once(ssl._create_unverified_context())
        raise


def from_network(
    frontier: DataFrame, settings: FetchSettings = FetchSettings(), fetch: Callable[[str, FetchSettings], tuple] = get
) -> DataFrame:
    """frontier (url) fetched by `fetch`, a host's URLs in one task; an error is a value of its row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url in b["url"]:
                try:
                    final, status, content_type, content = fetch(url, settings)
                    rows.append((url, final, status, content_type, content, None))
                except Exception as e:
                    rows.append((url, None, None, None, None, str(e)))
                time.sleep(settings.delay)
            yield pd.DataFrame(rows, columns=["url", "final_url", "status_code", "content_type", "content", "error"])

    by_host = frontier.select("url").distinct().repartition(urls.host(F.col("url")))
    return by_host.mapInPandas(run, FETCHED)
