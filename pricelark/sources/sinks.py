"""Writing results: exports, reports with a time to live, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export(products: DataFrame, path: str, kind: str = "csv") -> None:
    """One row a product in the frame's column order; lists as JSON text in CSV."""
    if kind == "json":
        products.write.mode("overwrite").json(path)
    elif kind == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in products.dtypes]
        products.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(kind)


def store_reports(reports: DataFrame, path: str, now) -> None:
    """Append reports under their date, for `jobs.fresh` to read back."""
    reports.withColumn("observed_at", now).withColumn("day", F.to_date("observed_at")).write.mode("append").partitionBy("day").parquet(path)
