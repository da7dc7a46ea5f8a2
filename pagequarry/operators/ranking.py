"""Ranking, top-k and ordered dedup. Every order ends in a sequence column: ties never depend on the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "result_rank") -> DataFrame:
    """The first k of each key. The filter on the rank becomes a per-partition limit before the shuffle."""
    return numbered(df, keys, order, rank).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "__first").drop("__first")


def latest(df: DataFrame, key: str = "district_id", by: str = "id") -> DataFrame:
    """The row with the greatest `by` of each key, in place of a self-join with its maximum."""
    return first_per_key(df, [key], [F.desc_nulls_last(by)])


def best_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The greatest row of each key by a struct of `order`: an aggregate that is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def overwrite(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The union by key in which a row of `second` replaces that of `first`."""
    both = first.withColumn("__phase", F.lit(0)).unionByName(second.withColumn("__phase", F.lit(1)))
    return first_per_key(both, keys, [F.desc("__phase")]).drop("__phase")


def until(df: DataFrame, keys: list[str], seq: str, stop: Column) -> DataFrame:
    """Rows up to and with the first, by seq, for which stop holds."""
    w = W.partitionBy(*keys)
    marked = df.withColumn("__stop", F.min(F.when(stop, F.col(seq))).over(w))
    return marked.where(F.col("__stop").isNull() | (F.col(seq) <= F.col("__stop"))).drop("__stop")


def page_of(df: DataFrame, order: list[Column], page: int, size: int = 100) -> DataFrame:
    return df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)
