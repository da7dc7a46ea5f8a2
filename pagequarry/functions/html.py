"""Parts of a page by built-in expressions only."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from pagequarry.functions.text import collapse, let
from pagequarry.functions.urls import join

#: Elements whose content is not visible text, in the order in which they go: those of most pages, and those of few.
HIDDEN, RARE_HIDDEN = ("script", "style"), ("noscript", "svg")
#: Characters of the named references of HTML 4, as a map that the optimizer makes a constant; a no-break space counts as a space.
_NAMED = json.dumps({name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "})


def decode(c: Column) -> Column:
    """Character references that end in a semicolon, named and numeric; anything else stays as it is."""
    part = lambda x, i: F.when(i == 0, x).otherwise(_reference(x))
    return let(c, lambda v: F.when(v.contains("&") & v.contains(";"), F.array_join(F.transform(F.split(v, "&", -1), part), "")).otherwise(v))


def _reference(after: Column) -> Column:
    """What follows an ampersand, with the reference that it begins, if it does, in its place."""
    name = F.regexp_extract(after, "^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
    return let(
        name,
        lambda n: F.coalesce(
            F.concat(F.when(n.startswith("#"), _numbered(n)).when(n != "", F.element_at(F.from_json(F.lit(_NAMED), "map<string,string>"), n)), F.regexp_replace(after, "^[^;]*;", "")),
            F.concat(F.lit("&"), after),
        ),
    )


def _numbered(name: Column) -> Column:
    """The character of #233 or #xE9, null if there is none."""
    code = F.when(name.rlike("^#[xX]"), F.substring(name, 3, 6)).otherwise(F.conv(F.substring(name, 2, 7), 10, 16))
    exists = lambda x: (x > "00000000") & (x <= "0010FFFF") & ~x.between("0000D800", "0000DFFF")
    return let(F.upper(F.lpad(code, 8, "0")), lambda x: F.when(exists(x), F.decode(F.unhex(x), "UTF-32")))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a start tag: quoted or not, decoded; empty if it has none."""
    raw = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return decode(F.regexp_replace(raw, "^[\"']|[\"']$", ""))


def blocks(markup: Column, tag: str) -> Column:
    """Each element of this name as its markup from the start tag to the end tag, or to the next start tag where there is none."""
    parts = F.filter(F.split(markup, rf"(?i)(?=<{tag}\b)"), lambda x: x.rlike(rf"(?i)^<{tag}\b"))
    return F.transform(parts, lambda x: F.regexp_replace(x, rf"(?is)</{tag}\s*>.*", ""))


def start_tags(markup: Column, tag: str) -> Column:
    return F.regexp_extract_all(markup, F.lit(rf"(?is)(<{tag}\b[^>]*>)"), F.lit(1))


def visible(html: Column) -> Column:
    """The markup without hidden elements and comments."""
    return let(_without(html, HIDDEN), _without_rare)


def _without(html: Column, tags: tuple[str, ...]) -> Column:
    for tag in tags:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return html


def _without_rare(html: Column) -> Column:
    """One search tells that a page has no rare element, in place of one for each."""
    shown = F.when(html.rlike(f"(?i)<(?:{'|'.join(RARE_HIDDEN)})"), _without(html, RARE_HIDDEN)).otherwise(html)
    return let(shown, lambda x: F.when(x.contains("<!--"), F.regexp_replace(x, "(?s)<!--.*?-->", "")).otherwise(x))


def runs(html: Column) -> Column:
    """Text runs, trimmed, without empty ones."""
    return pieces(visible(html))


def shown_text(shown: Column) -> Column:
    """The text of visible markup."""
    return decode(F.array_join(pieces(shown), " "))


def shown_headings(shown: Column) -> Column:
    found = F.regexp_extract_all(shown, F.lit(r"(?is)<h[123]\b[^>]*>(.*?)</h[123]\s*>"), F.lit(1))
    return F.transform(found, shown_text)


def pieces(markup: Column) -> Column:
    parts = F.split(markup, "<[^>]*>")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def body(html: Column) -> Column:
    return shown_text(visible(html))


def title(html: Column) -> Column:
    return collapse(decode(F.regexp_replace(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1), "<[^>]*>", "")))


def headings(html: Column) -> Column:
    return shown_headings(visible(html))


def hrefs(html: Column) -> Column:
    found = F.regexp_extract_all(visible(html), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    return F.filter(
        F.transform(found, lambda x: decode(F.trim(F.regexp_replace(x, "^[\"']|[\"']$", "")))),
        lambda x: (x != "") & ~x.rlike("^(#|mailto:|tel:|javascript:)"),
    )


def links(html: Column, url: Column) -> Column:
    """Absolute links in document order."""
    return F.transform(hrefs(html), lambda x: join(url, x))


def page(html: Column, url: Column) -> Column:
    return F.struct(title(html).alias("title"), headings(html).alias("headings"), body(html).alias("body"), links(html, url).alias("links"))
