"""Archived evidence: pages stored compressed, reports, photo verdicts, search results."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(requested_url, status_code, html, intact) of an archive of gzip and base64 bodies; intact: the digest agrees."""
    raw = spark.read.option("multiLine", True).json(path).select(F.explode("entries").alias("e"))
    packed = raw.select("e.requested_url", F.col("e.status_code").cast("int").alias("status_code"), F.unbase64("e.body").alias("body"), F.col("e.body_sha256").alias("sha"))

    def run(batches):
        for b in batches:
            yield b.set_column(2, "body", pa.array([None if x is None else gzip.decompress(x) for x in b.column("body").to_pylist()], pa.binary()))

    open_ = packed.mapInArrow(run, packed.schema)
    return open_.select("requested_url", "status_code", F.decode("body", "UTF-8").alias("html"), (F.sha2("body", 256) == F.col("sha")).alias("intact"))


def reports(spark: SparkSession, path: str) -> DataFrame:
    """(listing_id, source, offer_ord, title, price, currency, url, seller, confidence, is_analog) of archived reports."""
    raw = spark.read.option("multiLine", True).json(path)
    each = raw.select(F.col("query.listing_id").alias("listing_id"), F.explode("sources").alias("s"))
    offers = each.select("listing_id", F.col("s.source").alias("source"), F.posexplode("s.offers").alias("offer_ord", "o"))
    return offers.select("listing_id", "source", "offer_ord", "o.title", F.col("o.price").cast("decimal(14,2)").alias("price"), "o.currency", "o.url", "o.seller", F.col("o.confidence").cast("double").alias("confidence"), "o.is_analog")


def photo_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path).select(F.explode("entries").alias("e")).select("e.key", "e.verdict", F.col("e.ttl_seconds").cast("int").alias("ttl_seconds"))


def search_results(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("multiLine", True).json(path).select(F.explode("results").alias("r"))
    return raw.select(F.col("r.query").alias("query_id"), F.posexplode("r.response.organic").alias("ord", "o")).select("query_id", "ord", "o.title", "o.link", "o.snippet")
