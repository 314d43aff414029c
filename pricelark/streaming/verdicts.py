"""A cache of photo verdicts as a stream: who is asked, who is answered from the cache, and when entries end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000
#: Milliseconds that a verdict is kept, by its value.
TTL = {"unsure": DAY}
TTL_ELSE = 7 * DAY

OUT = "url string, seq long, at timestamp, verdict string, cached boolean, expires_at timestamp"


def ttl_of(verdict: str) -> int:
    return TTL.get(verdict, TTL_ELSE)


class VerdictCache(StatefulProcessor):
    """Per url: the verdict last stored and when it ends.

    A request before that is answered from the cache; at or after it the model's answer counts
    and is stored for a time that depends on its value.  A model that failed (null) stores
    nothing.  A timer clears an entry once the watermark has passed its end, so state holds
    live entries only; results don't depend on when it fires.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "verdict string, ends long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["ms", "seq"], kind="stable")
        verdict, ends = self.entry.get() if self.entry.exists() else (None, -1)
        before, out = ends, []
        for seq, ms, answer in zip(asked["seq"].tolist(), asked["ms"].tolist(), asked["answer"].tolist()):
            cached = ms < ends
            if not cached:
                verdict = None if pd.isna(answer) else answer
                ends = ms + ttl_of(verdict) if verdict is not None else -1
            out.append((key[0], seq, ms, verdict, cached, ends if ends >= 0 else None))
        if ends != before:
            if before >= 0:
                self.handle.deleteTimer(before)
            if ends >= 0:
                self.entry.update((verdict, ends))
                self.handle.registerTimer(ends)
            else:
                self.entry.clear()
        made = pd.DataFrame(out, columns=["url", "seq", "ms", "verdict", "cached", "ends"])
        made["at"], made["expires_at"] = pd.to_datetime(made["ms"], unit="ms"), pd.to_datetime(made["ends"], unit="ms")
        yield made[[c.split()[0] for c in OUT.split(", ")]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists() and self.entry.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        return iter([])

    def close(self) -> None:
        pass


def answered(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """(url, seq, at, verdict, cached, expires_at) of each request; ``requests``: url, seq, at, answer (what the model says if it is asked; null: it failed).

    Requests of a url count in the order of time, then seq, within a micro-batch; those later than ``late``
    behind the watermark are dropped, as its state may be gone.  A micro-batch's rows of one
    url are sorted in one task: the trigger's size bounds them.  Works on batches too.  Needs the
    RocksDB state store (`state_store`).
    """
    rows = requests.withWatermark("at", late).select("url", "seq", "at", F.unix_millis("at").alias("ms"), "answer")
    return rows.groupBy("url").transformWithStateInPandas(VerdictCache(), OUT, "append", "eventTime")


def live(outcomes: DataFrame, now) -> DataFrame:
    """(url, verdict) of the entries that live at ``now``, from the outcomes up to then."""
    stored = outcomes.where((F.col("at") <= now) & F.col("expires_at").isNotNull())
    last = stored.groupBy("url").agg(F.max_by(F.struct("verdict", "expires_at"), F.struct("at", "seq")).alias("e"))
    return last.where(F.col("e.expires_at") > now).select("url", "e.verdict")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
