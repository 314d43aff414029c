"""Stores of a workspace: lists, runs, oldest links, and the shops that are left out of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import merge


def listed(stores: DataFrame) -> DataFrame:
    """Stores with their ``place`` in their workspace's list, the newest first."""
    w = Window.partitionBy("workspace_id").orderBy(F.col("created_at").desc(), "store_id")
    return stores.withColumn("place", F.row_number().over(w))


def active_imports(runs: DataFrame, stores: DataFrame) -> DataFrame:
    """Catalogue imports that are queued or running, with their store (if it is still there) and ``place`` in the workspace's queue."""
    active = runs.where((F.col("kind") == "catalog_import") & F.col("status").isin("queued", "running"))
    w = Window.partitionBy("workspace_id").orderBy("created_at", "run_id")
    shown = stores.select("store_id", F.col("name").alias("store_name"))
    return active.withColumn("place", F.row_number().over(w)).join(shown, "store_id", "left")


def with_oldest_link(stores: DataFrame, links: DataFrame) -> DataFrame:
    """Stores with the workspace of their oldest link (store_id, workspace_id, created_at); null without one."""
    oldest = links.groupBy("store_id").agg(F.min_by("workspace_id", F.struct("created_at", "workspace_id")).alias("workspace_id"))
    return stores.drop("workspace_id").join(oldest, "store_id", "left")


EXCLUSION = ["workspace", "marketplace", "external_id"]


def exclude(exclusions: DataFrame, entered: DataFrame) -> DataFrame:
    """Exclusions after shops were entered: slug, name and store of a known one change, a new one is added; slugs are folded.

    Both have workspace, marketplace, external_id, slug, name, store_id; ``entered`` has ``ord`` too.
    """
    return merge.upsert_by(exclusions, entered.withColumn("slug", text.fold(text.present(F.col("slug")))), EXCLUSION, ["slug", "name", "store_id"])


def without_stores(exclusions: DataFrame, gone: DataFrame) -> DataFrame:
    """Exclusions after stores were deleted: they stay and lose the store."""
    marked = exclusions.join(gone.select("store_id", F.lit(True).alias("_gone")).distinct(), "store_id", "left")
    return marked.withColumn("store_id", F.when(F.col("_gone").isNull(), F.col("store_id"))).select(*exclusions.columns)


def backfill_exclusions(exclusions: DataFrame, stores: DataFrame, links: DataFrame, ours: Column) -> DataFrame:
    """Exclusions with a row for each linked store that is ``ours`` and has none yet; rows that exist stay as they are.

    ``stores``: store_id, marketplace, external_id, slug, name; ``links``: store_id, workspace.
    """
    made = links.select("store_id", "workspace").distinct().join(stores.where(ours), "store_id").where("external_id IS NOT NULL")
    one = made.groupBy(*EXCLUSION).agg(F.min_by(F.struct(text.fold(F.col("slug")).alias("slug"), "name", "store_id"), "store_id").alias("s")).select(*EXCLUSION, "s.*")
    return exclusions.unionByName(one.join(exclusions.select(*EXCLUSION), EXCLUSION, "left_anti").select(*exclusions.columns))
