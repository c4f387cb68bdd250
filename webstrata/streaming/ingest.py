"""Captured pages as a stream: new files refresh the derived tables batch by batch.

The source watches a folder; every micro-batch is extracted once and appended to narrow tables named by batch, so a
batch that runs again after a failure overwrites its own output and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webstrata.functions import scalars as S
from webstrata.functions.dialect import Spark
from webstrata.operators import extract as X

PAGES = "page_id long, url string, html string"


def page_stream(spark: SparkSession, folder: str, glob: str = "*.parquet", per_batch: int = 8) -> DataFrame:
    """Pages as they arrive, keyed as the batch operators expect them."""
    raw = spark.readStream.schema(PAGES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).parquet(folder)
    return raw.select(F.expr(S.host(Spark, "url")).alias("scan"), F.col("page_id").alias("pid"), "url", F.expr(S.page_path(Spark, "url")).alias("path"), "html", F.octet_length("html").cast("long").alias("size"))


def refresh(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps ``out``/meta, ``out``/links and ``out``/facts up to date with the stream; all that is there is processed, then it stops."""

    def write(batch: DataFrame, number: int) -> None:
        for name, build in (("meta", X.page_meta), ("links", X.links), ("facts", X.facts)):
            build(batch).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
