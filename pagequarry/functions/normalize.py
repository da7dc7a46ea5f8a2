"""Cleaning of imported values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagequarry.functions.text import collapse
from pagequarry.functions.urls import prefer_https
from pagequarry.schemas import INVALID_WEBSITES, STATES


def state(c: Column) -> Column:
    """Two letters in upper case, a state's name as its letters, anything else as it is."""
    s = collapse(F.coalesce(c, F.lit("")))
    names = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return F.when(s.rlike("^[A-Za-z]{2}$"), F.upper(s)).otherwise(F.coalesce(F.try_element_at(names, F.lower(s)), s))


def integer(c: Column) -> Column:
    """A count: commas and stray characters dropped, fractions cut off; null if there is no number."""
    s = collapse(F.coalesce(c.cast("string"), F.lit("")))
    digits = F.regexp_replace(s, "[^0-9.-]", "")
    number = digits.try_cast("double")
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return F.when(~F.lower(s).isin(*INVALID_WEBSITES), whole.try_cast("int"))


def optional_integer(c: Column) -> Column:
    """A whole number without its commas, null for anything else."""
    s = F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), ",", "")
    return F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("int"))


def website(c: Column) -> Column:
    """struct(url, searchable): an absolute URL with a plausible host, or ('', false)."""
    bare = F.trim(F.coalesce(c, F.lit("")))
    s = collapse(F.regexp_replace(F.regexp_replace(bare, '^"+|"+$', ""), "^'+|'+$", ""))
    bad = F.lower(s).isin(*INVALID_WEBSITES) | s.contains("†") | s.contains("‡")
    full = (
        F.when(s.startswith("//"), F.concat(F.lit("https:"), s))
        .when(s.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), s)
        .otherwise(F.concat(F.lit("https://"), s))
    )
    full = F.regexp_replace(full, r"[ .,\s]+$", "")
    name = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    name = F.regexp_replace(name, r"^\.+|\.+$", "")
    good = ~bad & name.rlike(r"(?i)^[^.\s]+(\.[^.\s]+)*\.[a-z]{2,63}$")
    return F.struct(F.when(good, full).otherwise("").alias("url"), good.alias("searchable"))


def secure_website(c: Column) -> Column:
    return prefer_https(website(c)["url"])


def clamp(c: Column, low, high, default=None) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c, F.lit(low if default is None else default))))
