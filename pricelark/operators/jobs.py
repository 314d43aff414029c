"""Quotas, queues and run logs, as analytic views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab


def quota(checks: DataFrame, free: DataFrame | None = None, most: int = vocab.FREE_CHECKS) -> DataFrame:
    """Each check with the number used by its workspace so far, and whether it was allowed."""
    w = Window.partitionBy("workspace_id").orderBy("at", "check_id")
    used = checks.withColumn("checks_used", F.row_number().over(w))
    if free is not None:
        used = used.join(free.select("workspace_id", F.lit(True).alias("_free")).distinct(), "workspace_id", "left")
        return used.withColumn("allowed", F.col("_free").isNotNull() | (F.col("checks_used") <= most)).drop("_free")
    return used.withColumn("allowed", F.col("checks_used") <= most)


def queue_head(runs: DataFrame) -> DataFrame:
    """Per workspace the oldest queued run without a task, unless one is running."""
    busy = runs.where("status = 'running'").select("workspace_id").distinct()
    waiting = runs.where("status = 'queued' AND task_id IS NULL").join(busy, "workspace_id", "left_anti")
    return waiting.groupBy("workspace_id").agg(F.min(F.struct("created_at", "run_id"))["run_id"].alias("run_id"))


def final_status(log: DataFrame) -> DataFrame:
    """Each run's last status by time; a cancelled run stays cancelled."""
    last = log.groupBy("run_id").agg(F.max(F.struct("at", "seq", "status"))["status"].alias("last"), F.bool_or(F.col("status") == "cancelled").alias("c"))
    return last.select("run_id", F.when(F.col("c"), F.lit("cancelled")).otherwise(F.col("last")).alias("status"))


def fresh(reports: DataFrame, now, ttl_seconds: int = 21_600) -> DataFrame:
    """Cached reports still within their time to live."""
    return reports.where(F.col("observed_at") > now - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))


def fresh_verdicts(verdicts: DataFrame, now) -> DataFrame:
    """Photo verdicts: seven days, one day for ``unsure``."""
    ttl = F.when(F.col("verdict") == "unsure", F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 7 DAYS"))
    return verdicts.where(F.col("at") + ttl > now)


def cheapest_first(offers: DataFrame, k: int = 4) -> DataFrame:
    """A client's ladder: the k cheapest offers of each query."""
    w = Window.partitionBy("query_id").orderBy("price", "source_ord", "offer_ord")
    return offers.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
