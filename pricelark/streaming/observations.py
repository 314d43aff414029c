"""Price observations as streams: emit on change, windows, merges by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "listing_id long, seq long, price_cents long, currency string, is_available boolean, observed_at timestamp"


def _changed(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get if state.exists else None
    rows = pd.concat(list(frames)).sort_values(["observed_at", "seq"], kind="stable")
    keep = []
    for i, now in enumerate(zip(rows["price_cents"].astype("int64").tolist(), rows["currency"].tolist(), [None if pd.isna(x) else bool(x) for x in rows["is_available"]])):
        keep.append(now != last)
        last = now
    state.update(last)
    yield rows.loc[keep, [c.split()[0] for c in OUT.split(", ")]]


def changes(observations: DataFrame) -> DataFrame:
    """A streaming frame of the observations that differ from the one before of their listing.

    State is a listing's last price, currency and availability.  Observations without a
    price are left out.  Within a micro-batch rows count in the order of time, then seq.
    """
    priced = observations.where("price_cents IS NOT NULL").select(*[c.split()[0] for c in OUT.split(", ")])
    return priced.groupBy("listing_id").applyInPandasWithState(_changed, OUT, "price long, currency string, is_available boolean", "append", GroupStateTimeout.NoTimeout)


def windowed(observations: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Prices by listing and time window under a watermark (an extension: nothing before had windows)."""
    w = F.window("observed_at", width)
    return observations.withWatermark("observed_at", late).groupBy(w, "listing_id").agg(F.count("*").alias("n"), F.min("price_cents").alias("low"), F.max("price_cents").alias("high"))


def import_batches(products: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``save`` on each micro-batch of incoming product files until none is left."""
    return products.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
