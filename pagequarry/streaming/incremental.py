"""Pages as they arrive: the same scoring as a batch run, per micro-batch.

New page files are read as a stream; each micro-batch is scored and merged into the results kept so far
by best hit per page, so a page that arrives again replaces its earlier hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagequarry.functions import urls as U
from pagequarry.operators.ranking import first_per_key
from pagequarry.operators.search import best_hits, hits

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def pages_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def score_stream(pages: DataFrame, phrase: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's hits under path/batch=N: a batch that runs again replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        found = hits(batch, phrase).select("page_id", "url", "title", "score", "snippet")
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_top(spark: SparkSession, path: str, k: int = 5) -> DataFrame:
    """The k best hits of each site over all batches; of a page's hits the newest batch counts."""
    rows = spark.read.parquet(path)
    newest = first_per_key(rows, ["page_id"], [F.desc("batch")]).withColumn("host", U.core_host(F.col("url")))
    return best_hits(newest, ["host"], k, "page_id").select("host", "page_id", "url", "score", "result_rank")
