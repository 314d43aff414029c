"""Exchange rates from the central bank's JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Currencies that are looked for.
WANTED = ("USD", "EUR")


def bank_rates(payloads: DataFrame, wanted: tuple = WANTED) -> DataFrame:
    """(day, code, rate) of the wanted currencies with a rate above 0; ``payloads``: day, payload (an array of objects with cc and rate).

    The last entry of a code counts.  What is no such array gives no rate, and prices then stay as they are.
    """
    entries = F.from_json("payload", "array<struct<cc: string, rate: string>>")
    each = payloads.select("day", F.posexplode(entries).alias("ord", "e")).select("day", "ord", F.upper("e.cc").alias("code"), F.col("e.rate").try_cast("decimal(18,6)").alias("rate"))
    fine = each.where(F.col("code").isin(*wanted) & (F.col("rate") > 0))
    return fine.groupBy("day", "code").agg(F.max_by("rate", "ord").alias("rate"))
