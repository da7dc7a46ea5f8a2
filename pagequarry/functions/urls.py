"""URL expressions, by the generic syntax of RFC 3986: nothing here fails on a bad URL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from pagequarry.functions.text import any_of, contains_any, fold, let
from pagequarry.schemas import NON_CONTENT, SEARCH_LOOPS

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(c: Column, n: int) -> Column:
    return F.regexp_extract(c, _URL, n)


def scheme(c: Column) -> Column:
    return F.lower(_part(c, 1))


def authority(c: Column) -> Column:
    return F.lower(_part(c, 2))


def host(c: Column) -> Column:
    """Host without user and port, in lower case."""
    return F.regexp_replace(F.regexp_replace(authority(c), "^.*@", ""), ":[0-9]*$", "")


def path(c: Column) -> Column:
    return _part(c, 3)


def query(c: Column) -> Column:
    return _part(c, 4)


def core_host(c: Column) -> Column:
    """Host without dots at its ends and without one leading www."""
    return F.regexp_replace(F.regexp_replace(host(c), r"^\.+|\.+$", ""), r"^www\.", "")


def same_org(url: Column, base: Column) -> Column:
    """The URL's host is the base's, or lies below it."""
    both = F.struct(core_host(url).alias("h"), core_host(base).alias("b"))
    return let(both, lambda x: (x["h"] != "") & (x["b"] != "") & ((x["h"] == x["b"]) | F.endswith(x["h"], F.concat(F.lit("."), x["b"]))))


def canonical(c: Column) -> Column:
    """Without fragment and parameters, scheme and host in lower case, no slash at the end; the query stays."""
    return let(F.trim(c), _canonical)


def _canonical(c: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(path(c), ";[^/]*$", ""), "/+$", "")
    front = F.when(scheme(c) != "", F.concat(scheme(c), F.lit(":"))).otherwise("")
    place = F.when(authority(c) != "", F.concat(F.lit("//"), authority(c))).otherwise("")
    q = F.when(query(c) != "", F.concat(F.lit("?"), query(c))).otherwise("")
    return F.concat(front, place, p, q)


def join(base: Column, href: Column) -> Column:
    """href as seen from base, with its dot segments resolved."""
    root = F.concat(scheme(base), F.lit("://"), _part(base, 2))
    folder = F.regexp_replace(F.when(path(base) == "", "/").otherwise(path(base)), "[^/]*$", "")
    bare = F.regexp_replace(base, "[?#].*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, without_dots(href)))
        .when(href.startswith("?"), F.concat(bare, href))
        .when(href.startswith("#") | (href == ""), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(root, without_dots(F.concat(folder, href))))
    )


def without_dots(place: Column) -> Column:
    """An absolute path, with query and fragment if it has any, without its . and .. segments."""
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    parts = F.slice(F.split(F.regexp_extract(place, "^[^?#]*", 0), "/", -1), F.lit(2), F.lit(1 << 20))
    whole = F.aggregate(parts, F.array().cast("array<string>"), step)
    folder = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    resolved = F.concat(F.lit("/"), F.array_join(whole, "/"), F.when(F.size(whole) > 0, folder).otherwise(""), F.regexp_extract(place, "[?#].*$", 0))
    return F.when(place.rlike(r"^[^?#]*/\.\.?(?:[/?#]|$)"), resolved).otherwise(place)


def pairs(query_: Column) -> Column:
    """The parameters of a query string as structs k, v in order, decoded: each name once, with its last value."""
    text = lambda x: F.coalesce(F.try_url_decode(x), x)
    value = lambda x: F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")
    each = F.filter(F.split(query_, "&"), lambda x: x != "")
    each = F.transform(each, lambda x: F.struct(text(F.substring_index(x, "=", 1)).alias("k"), text(value(x)).alias("v")))
    return last_values(each)


def last_values(given: Column) -> Column:
    """Structs k, v with each k once, at its first place with its last v."""
    names = lambda x: F.array_distinct(F.transform(x, lambda p: p["k"]))
    last = lambda x, k: F.element_at(F.filter(x, lambda p: p["k"] == k), -1)
    return let(given, lambda x: F.transform(names(x), lambda k: last(x, k)))


def template(url: Column, param: Column, extra: Column) -> Column:
    """A search template: the URL with `param` standing for the query and the structs k, v of `extra` where it lacks them."""
    slot = F.struct(param.alias("k"), F.lit(None).cast("string").alias("v"))
    own = lambda x: F.exists(x, lambda p: p["k"] == param)
    named = lambda x: F.transform(x, lambda p: p["k"])
    said = let(pairs(query(url)), lambda x: F.concat(x, F.filter(extra, lambda p: ~F.array_contains(named(x), p["k"]))))
    whole = let(said, lambda x: F.when(own(x), x).otherwise(F.concat(x, F.array(slot))))
    coded = F.transform(whole, lambda p: F.concat(encode_plus(p["k"]), F.lit("="), F.when(p["k"] == param, "{query}").otherwise(encode_plus(p["v"]))))
    place = F.regexp_replace(F.when(path(url) == "", "/").otherwise(path(url)), ";[^/]*$", "")
    asked = F.replace(F.array_join(coded, "&"), F.lit("%7Bquery%7D"), F.lit("{query}"))
    return F.concat(scheme(url), F.lit("://"), _part(url, 2), place, F.lit("?"), asked)


def prefer_https(c: Column) -> Column:
    c = F.trim(F.coalesce(c, F.lit("")))
    local = host(c).isin("localhost", "127.0.0.1", "::1", "[::1]")
    return F.when((scheme(c) == "http") & ~local, F.regexp_replace(c, "^[hH][tT][tT][pP]:", "https:")).otherwise(c)


def looks_like_search(c: Column) -> Column:
    return contains_any(fold(c), SEARCH_LOOPS)


def valid_result(url: Column, base: Column, searched: Column) -> Column:
    """May be a hit: a page of the organisation that is no file, not the search itself and no other search."""
    return let(url, lambda u: _valid_result(u, base, searched))


def _valid_result(url: Column, base: Column, searched: Column) -> Column:
    low = F.lower(path(url))
    return (
        F.coalesce(url != "", F.lit(False))
        & scheme(url).isin("http", "https")
        & ~any_of([low.endswith(s) for s in NON_CONTENT])
        & (canonical(url) != canonical(searched))
        & ~looks_like_search(url)
        & same_org(url, base)
    )


def encode_plus(c: Column) -> Column:
    """Form encoding in which a space is +, ~ stays and * does not."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def search_url(template: Column, text: Column) -> Column:
    return F.replace(template, F.lit("{query}"), encode_plus(F.trim(text)))


def cache_busted(url: Column, stamp: Column, name: str = "_probe") -> Column:
    """The URL with a parameter that no cache has seen, as the last of its query."""
    mark = F.concat(F.when(query(url) == "", F.lit("?")).otherwise("&"), F.lit(f"{name}="), stamp.cast("string"))
    place = F.when(path(url) == "", F.concat(F.regexp_extract(url, "^[^?#]*", 0), F.lit("/"))).otherwise(F.regexp_extract(url, "^[^?#]*", 0))
    asked = F.when(query(url) == "", "").otherwise(F.concat(F.lit("?"), query(url)))
    return F.concat(place, asked, mark, F.regexp_extract(url, "#.*$", 0))


def site_query(phrase: Column, base: Column) -> Column:
    """The phrase in quotes, unless it begins or ends with one, and the site it is searched on."""
    p = F.trim(phrase)
    quoted = F.when(p.startswith('"') | p.endswith('"'), p).otherwise(F.concat(F.lit('"'), p, F.lit('"')))
    return F.concat(quoted, F.lit(" site:"), core_host(base))


def filename_title(c: Column) -> Column:
    """The last part of the path, else the host, else the URL, with - and _ as spaces."""
    last = F.regexp_extract(path(c), "([^/]*)$", 1)
    name = F.when(last != "", last).when(host(c) != "", host(c)).otherwise(c)
    return F.translate(name, "-_", "  ")


def path_segments(c: Column) -> Column:
    return F.size(F.filter(F.split(path(c), "/"), lambda x: x != ""))


@F.pandas_udf(T.StringType())
def urljoin_udf(base, href):
    """Full resolution, with dot segments."""
    from urllib.parse import urljoin

    import pandas as pd

    def one(b, h):
        try:
            return urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([one(b, h) if b is not None and h is not None else None for b, h in zip(base, href)])
