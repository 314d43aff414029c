"""Refreshing listings from their product pages in chunks, each written exactly once.

A chunk is a micro-batch.  Its rows go to a folder of the batch's number, which a repetition
overwrites, and then its counts to a log; a batch whose counts are in the log is skipped.  So a
run that breaks off anywhere and starts again neither loses nor doubles a chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import pages
from . import folders

LOG = "batch_id long, done long, failed long"


def read_products(fetched: DataFrame) -> DataFrame:
    """(listing_id, error, product columns) of fetched pages (listing_id, html); a page that can't be read has an error."""
    got = pages.product_pages(fetched.select(F.col("listing_id").cast("string").alias("url"), "html"))
    kind = fetched.schema["listing_id"].dataType
    return got.select(F.col("page_url").cast(kind).alias("listing_id"), *[c for c in got.columns if c != "page_url"])


def backfilled(numbers: Column, from_page: Column) -> Column:
    """Part numbers of a listing: its own, or where it has none those of its product page; a page that failed adds none."""
    own = F.coalesce(numbers, F.array().cast("array<string>"))
    return F.when(F.size(own) > 0, own).otherwise(F.array_distinct(F.concat(F.coalesce(from_page, F.array().cast("array<string>")), own)))


def backfill(listings: DataFrame, products: DataFrame) -> DataFrame:
    """``listings`` (id, oem_numbers and more) with the numbers of their product pages (`read_products`) where they have none."""
    found = products.where("error IS NULL").groupBy(F.col("listing_id").alias("id")).agg(F.min_by("oem_numbers", F.to_json("oem_numbers")).alias("_page"))
    joined = listings.join(found, "id", "left")
    return joined.withColumn("oem_numbers", backfilled(F.col("oem_numbers"), F.col("_page"))).select(*listings.columns)


def chunk_writer(root: str, failed: Column, made: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that writes ``made(batch)`` under ``root`` once per batch number, and counts rows and ``failed`` ones."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log = f"{root}/log/batch_id={number}"
        if folders.exists(spark, f"{log}/_SUCCESS"):
            return
        rows = f"{root}/rows/batch_id={number}"
        made(batch).write.mode("overwrite").parquet(rows)
        # Counted from what was written: the batch isn't read again, and the counts are of these rows.
        counts = spark.read.parquet(rows).agg(F.count("*").alias("done"), F.count_if(failed).alias("failed"))
        counts.coalesce(1).write.mode("overwrite").parquet(log)

    return write


def log(spark: SparkSession, root: str) -> DataFrame:
    """(batch_id, done, failed) of each chunk so far."""
    if not folders.exists(spark, f"{root}/log"):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(f"{root}/log")


def rows(spark: SparkSession, root: str) -> DataFrame:
    """What the logged chunks hold; a chunk that broke off before its log isn't among them."""
    written = spark.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows")
    return written.join(F.broadcast(log(spark, root).select("batch_id")), "batch_id", "left_semi")


def progress(chunks: DataFrame, total: int | None = None) -> DataFrame:
    """(total, done, refreshed, failed, message) over the chunks; the message, if any failed, says how many of how many."""
    sums = chunks.agg(F.coalesce(F.sum("done"), F.lit(0)).alias("done"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"))
    whole = F.col("done") if total is None else F.lit(total).cast("long")
    message = F.when(F.col("failed") > 0, F.concat(F.lit("Не вдалося оновити "), F.col("failed").cast("string"), F.lit(" з "), whole.cast("string"), F.lit(" товарів")))
    return sums.select(whole.alias("total"), "done", (F.col("done") - F.col("failed")).alias("refreshed"), "failed", message.alias("message"))


def refresh(fetched: DataFrame, root: str, checkpoint: str):
    """Run over a stream of fetched pages (listing_id, html): products under ``root``, a chunk a micro-batch, until none is left."""
    write = chunk_writer(root, F.col("error").isNotNull(), read_products)
    return fetched.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
