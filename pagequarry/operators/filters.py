"""Filters over organisations and their profiles: optional predicates, AND-ed, pushed to the scan."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pagequarry.operators.ranking import latest
from pagequarry.schemas import NEVER_TESTED, PROFILE_STATUSES


def clean_values(values: Iterable | None) -> list[str]:
    """Trimmed, without empty ones, in order, each once."""
    return list(dict.fromkeys(v for v in (str(x if x is not None else "").strip() for x in values or ()) if v))


def district_predicate(
    states=None, agency_types=None, min_enrollment: int | None = None, max_enrollment: int | None = None, only_searchable: bool = True
) -> Column:
    tests = [F.col("searchable")] if only_searchable else []
    for name, values in (("state", clean_values(states)), ("agency_type", clean_values(agency_types))):
        if values:
            tests.append(F.col(name).isin(values))
    if min_enrollment is not None:
        tests.append(F.col("enrollment") >= min_enrollment)
    if max_enrollment is not None:
        tests.append(F.col("enrollment") <= max_enrollment)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def matching(districts: DataFrame, **wanted) -> DataFrame:
    return districts.where(district_predicate(**wanted))


def listed(districts: DataFrame, limit: int | None = None, **wanted) -> DataFrame:
    out = matching(districts, **wanted).orderBy("state", "agency_name", "id")
    return out if limit is None else out.limit(limit)


def with_latest_profile(districts: DataFrame, profiles: DataFrame) -> DataFrame:
    """districts left-joined to each one's latest profile, whose columns get the prefix p_."""
    p = latest(profiles)
    p = p.select(*[F.col(c).alias(f"p_{c}") for c in p.columns])
    return districts.join(p, F.col("id") == F.col("p_district_id"), "left")


def profile_predicate(statuses=None, provider: str | None = None) -> Column:
    """After the left join: never tested or one of the statuses, and the provider if one is named."""
    chosen = [s for s in clean_values(statuses) if s in PROFILE_STATUSES or s == NEVER_TESTED]
    plain = [s for s in chosen if s != NEVER_TESTED]
    tests = []
    if NEVER_TESTED in chosen:
        tests.append(F.col("p_id").isNull())
    if plain:
        tests.append(F.coalesce(F.col("p_profile_status").isin(plain), F.lit(False)))
    test = reduce(lambda a, b: a | b, tests) if tests else F.lit(True)
    return test & (F.col("p_provider_guess") == provider) if provider else test


def stored_statuses(c: Column) -> Column:
    """The known statuses of a stored filter: a JSON list, or one status as older settings have it."""
    text = F.trim(F.coalesce(c, F.lit("")))
    one = F.array(F.regexp_replace(text, '^"(.*)"$', "$1"))
    values = F.when(text.startswith("["), F.coalesce(F.from_json(text, "array<string>"), one)).otherwise(one)
    return F.filter(values, lambda x: x.isin(*PROFILE_STATUSES, NEVER_TESTED))


def profile_filtered(districts: DataFrame, profiles: DataFrame, statuses=None, provider: str | None = None, **wanted) -> DataFrame:
    return with_latest_profile(matching(districts, **wanted), profiles).where(profile_predicate(statuses, provider))


def browse_predicate(text: str = "", state: str = "") -> Column:
    """Name, id or website like %text%; % and _ of the text are wildcards."""
    test = F.lit(True)
    if text:
        like = [F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False)) for c in ("agency_name", "agency_id_nces", "website")]
        test = reduce(lambda a, b: a | b, like)
    return test & (F.col("state") == state) if state else test


SORTS = ("agency_name", "state", "agency_type", "enrollment", "website")


def browse(districts: DataFrame, text: str = "", state: str = "", sort: str = "agency_name", descending: bool = False) -> tuple[DataFrame, list[Column]]:
    """The filtered rows and their order; an unknown sort column means the name."""
    sort = sort if sort in SORTS else "agency_name"
    key = F.col(sort)
    if sort == "website":
        key = F.lower(F.coalesce(F.nullif(F.col("website"), F.lit("")), F.col("website_normalized")))
    elif sort != "enrollment":
        key = F.lower(key)
    order = key.desc_nulls_last() if descending else key.asc_nulls_first()
    return districts.where(browse_predicate(text, state)), [order, F.lower("agency_name").asc_nulls_first(), F.col("id")]


def usable_profiles(profiles: DataFrame, statuses: Iterable[str] = ("working",)) -> DataFrame:
    return profiles.where(
        F.col("profile_status").isin(list(statuses)) & (F.col("search_method") == "GET") & F.coalesce(F.col("search_url_template") != "", F.lit(False))
    )


def best_profile(profiles: DataFrame) -> DataFrame:
    from pagequarry.operators.ranking import first_per_key

    order = [F.desc_nulls_last("confidence"), F.desc_nulls_last("last_tested_at"), F.desc("id")]
    return first_per_key(profiles, ["district_id"], order)
