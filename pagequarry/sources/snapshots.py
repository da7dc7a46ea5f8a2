"""Versions of a table in a folder: each a Parquet folder v=N that is renamed into place when it is whole.

A table of an older version is read with today's columns: what it lacks gets that column's default.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from pagequarry.sources.tables import file_system


class Conflict(RuntimeError):
    """Another writer made the next version."""


def migrated(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """df with exactly the schema's columns. One that df lacks has its default in every row; a null that df has stays."""
    have, given = set(df.columns), defaults or {}
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(given.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])


def read_versions(spark: SparkSession, paths: list[str], schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Files of several versions of a table as one table. Each is read by its own columns."""
    out = None
    for path in paths:
        one = migrated(spark.read.parquet(path), schema, defaults)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], schema) if out is None else out


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, defaults: dict[str, object] | None = None):
        self.spark, self.folder, self.schema, self.defaults = spark, folder.rstrip("/"), schema, defaults

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        fs, at = file_system(self.spark, self.folder)
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max((int(n.removeprefix("v=")) for n in names if n.startswith("v=")), default=0)

    def path(self, version: int) -> str:
        return f"{self.folder}/v={version:08d}"

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the newest by default."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return migrated(self.spark.read.parquet(self.path(version)), self.schema, self.defaults)

    def commit(self, df: DataFrame, after: int) -> int:
        """Write df as the version after `after`, from which it was made."""
        draft = f"{self.folder}/_draft-{uuid.uuid4().hex}"
        df.write.parquet(draft)
        fs, place = file_system(self.spark, self.path(after + 1))
        _, at = file_system(self.spark, draft)
        if fs.exists(place) or not fs.rename(at, place):
            fs.delete(at, True)
            raise Conflict(f"Version {after + 1} of {self.folder} exists.")
        return after + 1
