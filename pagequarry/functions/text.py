"""Text expressions: Column in, Column out."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it and wherever the plan moves it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def held(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """df's columns `keep` and these new ones, computed once: what comes after can't be moved before them and copy them."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def contains_any(c: Column, words) -> Column:
    """One of the words occurs in c (c folded already): one search, so that c is computed once, within lambdas too."""
    return c.rlike("|".join(map(re.escape, words))) if words else F.lit(False)


#: By Unicode's rule, what case folding does to lower-case letters beyond U+00DF: to one letter, and to several.
_FOLDED = {c: c.casefold() for c in map(chr, range(0xB5, 0x1E944)) if c != "ß" and c.lower() == c != c.casefold()}
_ONE = {c: f for c, f in _FOLDED.items() if len(f) == 1}
_SEVERAL = {c: f for c, f in _FOLDED.items() if len(f) > 1}
#: Texts without such letters hold none that lower case and the sharp s don't settle.
_RARE = "[\u00b5\u0130-\uffff\\x{10000}-\\x{1ffff}]"


def fold(c: Column) -> Column:
    """Full case folding: lower case, sharp s as two letters, and in texts that may hold any, the other letters that fold."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in _SEVERAL.items()])

    def folded(low: Column) -> Column:
        one = F.translate(low, "".join(_ONE), "".join(_ONE.values()))
        return F.when(low.rlike(_RARE), F.aggregate(pairs, one, lambda text, p: F.replace(text, p["k"], p["v"]))).otherwise(low)

    return let(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), folded)


def fold_text(s: str) -> str:
    return s.casefold()


def collapse(c: Column) -> Column:
    """Runs of Unicode white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def occurrences(folded: Column, phrase: str) -> Column:
    """How often the folded phrase occurs, without overlap."""
    q = fold_text(phrase)
    gone = F.length(folded) - F.length(F.replace(folded, F.lit(q), F.lit("")))
    return (gone / F.lit(len(q))).cast("int")


def snippet(text: Column, phrase: str, around: int = 200, folded: Column | None = None) -> Column:
    """The text around the first hit. The hit's place is that in the folded text, taken in the text itself; folded: that text, where it is known."""
    q = fold_text(phrase)

    def cut(x: Column) -> Column:
        text, at = x["text"], x["at"]
        start = F.greatest(at - around, F.lit(0))
        end = F.least(at + len(phrase) + around, x["n"])
        part = F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))
        head = F.when(start > 0, "...").otherwise("")
        tail = F.when(end < x["n"], "...").otherwise("")
        return F.when(at < 0, collapse(F.substring(text, 1, 2 * around))).otherwise(collapse(F.concat(head, part, tail)))

    at = F.instr(fold(text) if folded is None else folded, q) - 1
    return let(F.struct(text.alias("text"), at.alias("at"), F.length(text).alias("n")), cut)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def highlight(c: Column, phrase: str) -> Column:
    """HTML-escaped text with each hit of the phrase, in any case, in <mark>."""
    if not phrase.strip():
        return escape_html(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        phrase = phrase.replace(a, b)
    return F.regexp_replace(escape_html(c), "(?i)(" + re.escape(phrase).replace("\\ ", " ") + ")", "<mark>$1</mark>")


def snake_case(c: Column) -> Column:
    s = F.replace(F.lower(F.trim(c)), F.lit("&"), F.lit("and"))
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "unnamed").otherwise(s)


def strip_tags(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "<[^>]*>", " "))


def report_number(c: Column) -> Column:
    """1,234 or nothing."""
    return F.coalesce(F.format_number(c, 0), F.lit(""))


def elapsed(start: Column, end: Column) -> Column:
    """Whole seconds between two times as `Ns` or `Mm Ss`; nothing without an end, never negative."""
    s = F.greatest(F.floor(F.timestamp_diff("MICROSECOND", start, end) / 1_000_000), F.lit(0)).cast("long")
    long = F.concat(F.floor(s / 60).cast("long").cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))
    return F.when(start.isNull() | end.isNull(), "").when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(long)


def json_strings(c: Column) -> Column:
    """A JSON list of strings; anything else is an empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def sorted_json(c: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
