"""Tables: the driver's Parquet files, and intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: int = 20_000, *keys: str) -> DataFrame:
    """df in tasks of some `rows` rows: for work that costs much more than its rows' bytes, by which a scan is cut, tell.

    A whole table of narrow rows is one task of a scan. The rows are counted for it. With keys they are dealt by these.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns; columns that an older file lacks are null."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder is made only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pagequarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables that are not deleted yet: session, path and, of a bucketed one, its name.
_LIVE: list[tuple[SparkSession, str, str]] = []


def stored(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    The table goes with the `scope` it was made in, else when the driver ends, since the frame that is
    returned is lazy.
    """
    return counted(df, what, compression, count=False)[0]


def counted(df: DataFrame, what: str, compression: str = "zstd", count: bool = True) -> tuple[DataFrame, int]:
    """The same with the number of rows, counted as they are written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagequarry/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    _LIVE.append((spark, path, ""))
    seen = Observation()
    (df.observe(seen, F.count(F.lit(1)).alias("n")) if count else df).write.option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path), seen.get["n"] if count else -1


def bucketed(df: DataFrame, what: str, column: str, buckets: int) -> DataFrame:
    """df stored in buckets by a column, sorted: joins on it, however many, don't shuffle this side."""
    spark = df.sparkSession
    name = f"pagequarry_{what}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/pagequarry/{name}"
    _LIVE.append((spark, path, name))
    df.write.bucketBy(buckets, column).sortBy(column).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


@contextlib.contextmanager
def scope(keep: list[DataFrame]):
    """Delete at the end what was stored meanwhile, but for the tables of the frames then in `keep`."""
    before = len(_LIVE)
    yield
    kept = {path for df in keep for path in _folders(df)}
    for at in _LIVE[before:]:
        if _name(at[1]) not in kept:
            _remove(*at)
            _LIVE.remove(at)


def discard(*frames: DataFrame | None) -> None:
    """Delete the tables that these frames, each straight from `stored`, read."""
    gone = {path for df in frames if df is not None for path in _folders(df)}
    for at in list(_LIVE):
        if _name(at[1]) in gone:
            _remove(*at)
            _LIVE.remove(at)


def folder(spark: SparkSession, what: str) -> str:
    """A path in the shared folder for files that go when the driver ends."""
    path = f"{shared_dir(spark)}/pagequarry/{what}-{uuid.uuid4().hex}"
    _LIVE.append((spark, path, ""))
    return path


def _name(path: str) -> str:
    return path.rpartition("/")[2]


def _folders(df: DataFrame) -> set[str]:
    return {_name(f.rpartition("/")[0]) for f in df.inputFiles()}


@atexit.register
def _remove_all() -> None:
    for at in _LIVE:
        _remove(*at)


def _remove(spark: SparkSession, path: str, name: str) -> None:
    try:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)
    except Exception:  # the session is gone already
        pass


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)
