"""Market statistics of offers: per query, per source, and by position in the market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, vocab


def strong() -> Column:
    return F.col("confidence") >= vocab.STRONG


def _median(counts: DataFrame, keys: list[str], price: str, n: Column, name: str, order: tuple[str, ...] = ()) -> DataFrame:
    """``counts`` (rows of a key, each ``n`` times a price) with the key's ``<name>_total`` and, on the rows that hold them, its middle two prices.

    A running count by price finds the places; all windows share one exchange and one
    sort, and nothing is gathered in a list.  Null prices don't count.  Rows may come in the order of other columns
    (``order``) that puts these, where they aren't null, in theirs.
    """
    w, counted = Window.partitionBy(*keys), F.when(F.col(price).isNotNull(), n).otherwise(0)
    upto = F.sum(counted).over(w.orderBy(*[F.col(c).asc_nulls_last() for c in order or (price,)]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumn("_upto", upto).withColumn(f"{name}_total", F.sum(counted).over(w)).withColumn("_own", counted)
    holds = lambda at: (F.col("_upto") >= at) & (F.col("_upto") - F.col("_own") < at)
    return placed.withColumn(f"{name}_low", F.when(holds(F.expr(f"({name}_total + 1) DIV 2")), F.col(price))).withColumn(f"{name}_high", F.when(holds(F.expr(f"{name}_total DIV 2") + 1), F.col(price))).drop("_upto", "_own")


def _summed(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of each key from rows of key, source, ``_strong``, price and ``_n``."""
    price = F.col("_price")
    rows = _median(counts.withColumn("_price", F.when(F.col("_strong"), F.col("price"))), keys, "_price", F.col("_n"), "_s")
    out = rows.groupBy(*keys).agg(
        F.sum("_n").alias("offers_total"), F.max("_s_total").alias("strong_total"), F.countDistinct("source").alias("sources_total"),
        F.min(price).alias("min_price"), money.middle(F.max("_s_low"), F.max("_s_high")).alias("median_price"), F.max(price).alias("max_price"),
    )
    return out.select(
        *keys, "offers_total", "sources_total", "strong_total", "min_price", "median_price", "max_price",
        (F.col("strong_total") < vocab.MIN_SAMPLE).alias("thin_market"), money.recommended(F.col("min_price"), F.col("strong_total")).alias("recommended_price"),
    )


def _counts(offers: DataFrame, *keys: str) -> DataFrame:
    return offers.groupBy(*dict.fromkeys((*keys, "source")), "price", F.coalesce(strong(), F.lit(False)).alias("_strong")).agg(F.count("*").alias("_n"))


def stats(offers: DataFrame, *keys: str) -> DataFrame:
    """offers_total, sources_total, strong_total, min, median, max, thin market flag and recommendation for each key.

    Offers become counts by key, source and price before anything is sorted, by partial
    aggregates; a key with very many offers sends as many rows as it has prices.
    """
    return _summed(_counts(offers, *keys), list(keys))


def levels(offers: DataFrame) -> DataFrame:
    """`stats` of each query and of each of its sources in one pass: query_id, ``of_source`` (false: the whole query, source null), source, statistics."""
    twice = _counts(offers, "query_id").withColumn("of_source", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("_at", F.when(F.col("of_source"), F.col("source")))
    return _summed(twice, ["query_id", "of_source", "_at"]).withColumnRenamed("_at", "source")


def with_anchor(offers: DataFrame, least: int = vocab.MIN_SAMPLE, key: str = "query_id", order: tuple[str, ...] = ()) -> DataFrame:
    """``offers`` with ``anchor``, the median strong price of the query where it has at least ``least`` of them (else null), and ``n_offers``.

    Windows over one exchange by query; offers are not joined with themselves.
    """
    rows = _median(offers.withColumn("_price", F.when(strong(), F.col("price"))), [key], "_price", F.lit(1), "_s", order)
    w = Window.partitionBy(key)
    middle = money.middle(F.max("_s_low").over(w), F.max("_s_high").over(w))
    out = rows.withColumn("anchor", F.when(F.col("_s_total") >= least, middle)).withColumn("n_offers", F.count(F.lit(1)).over(w))
    return out.drop("_price", "_s_low", "_s_high", "_s_total")


def anchors(offers: DataFrame, key: str = "query_id", least: int = vocab.MIN_SAMPLE) -> DataFrame:
    """(key, anchor, n_offers) of each query, from counts by price."""
    s = stats(offers, key)
    return s.select(key, F.when(F.col("strong_total") >= least, F.col("median_price")).alias("anchor"), F.col("offers_total").alias("n_offers"))


def legacy_stats(offers: DataFrame, *keys: str) -> DataFrame:
    """Statistics by the earlier rule, for audits: all prices where fewer than three are strong."""
    keys = list(keys)
    counts = _counts(offers, *keys).withColumn("_price", F.when(F.col("_strong"), F.col("price")))
    # Strong prices stand in the order of all prices, so one sort serves both.
    rows = _median(counts, keys, "price", F.col("_n"), "_a")
    rows = _median(rows, keys, "_price", F.col("_n"), "_s", ("price",))
    each = rows.groupBy(*keys).agg(
        F.max("_s_total").alias("strong_total"), F.min("_price").alias("s_min"), F.max("_price").alias("s_max"), money.middle(F.max("_s_low"), F.max("_s_high")).alias("s_median"),
        F.min("price").alias("a_min"), F.max("price").alias("a_max"), money.middle(F.max("_a_low"), F.max("_a_high")).alias("a_median"),
    )
    used = lambda c: F.when(F.col("strong_total") >= vocab.MIN_SAMPLE, F.col(f"s_{c}")).otherwise(F.col(f"a_{c}"))
    cut = F.greatest(F.bround(used("min") * F.lit(vocab.DISCOUNT).cast("decimal(3,2)"), 0), F.lit(1).cast("decimal(14,0)"))
    return each.select(*keys, "strong_total", used("min").alias("min_price"), used("median").alias("median_price"), used("max").alias("max_price"), cut.alias("recommended_price"))


def report(offers: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """One row for each query: its statistics and its sources with their offers, as JSON text.

    Sources stand in their order, offers by price, then position.  Amounts are strings.  Offers move once, by query; since a
    query's row holds them all anyway, its statistics are read off the sorted lists.
    """
    facts = [c for c in ("title", "currency", "seller", "url", "confidence", "is_analog", "availability") if c in offers.columns]
    order = F.struct("price", "offer_ord", *facts, F.coalesce(strong(), F.lit(False)).alias("_strong"))
    keyed = offers.where(F.col("query_id").isNotNull()).select("query_id", "source", "source_ord", "price", "offer_ord", *dict.fromkeys((*facts, "confidence"))).repartition("query_id")
    per = keyed.groupBy("query_id", "source").agg(F.min("source_ord").alias("source_ord"), F.sort_array(F.collect_list(order)).alias("offers"))
    per = per.withColumn("_prices", F.transform(F.filter("offers", lambda o: o["_strong"] & o["price"].isNotNull()), lambda o: o["price"]))
    at = lambda place: F.get("_prices", place.cast("int"))
    n = F.size("_prices")
    low, median, high = at(F.lit(0)), money.middle(at(F.floor((n + 1) / 2) - 1), at(F.floor(n / 2))), at(n - 1)
    shown = F.transform("offers", lambda o: F.struct(o["price"].cast("string").alias("price"), *[o[c].alias(c) for c in facts]))
    total = F.size("offers").cast("long")
    source = F.struct("source_ord", "source", total.alias("offers_total"), low.cast("string").alias("min_price"), median.cast("string").alias("median_price"), high.cast("string").alias("max_price"), shown.alias("offers"))
    out = per.groupBy("query_id").agg(
        F.sum(total).alias("offers_total"), F.count("source").alias("sources_total"), F.sum(n.cast("long")).alias("strong_total"), F.array_sort(F.flatten(F.collect_list("_prices"))).alias("_prices"), F.sort_array(F.collect_list(source)).alias("sources"),
    )
    out = out.select("query_id", "offers_total", "sources_total", "strong_total", low.alias("min_price"), median.alias("median_price"), high.alias("max_price"), F.to_json(F.struct("sources")).alias("report"))
    return out.select(
        "query_id", "offers_total", "sources_total", "strong_total", "min_price", "median_price", "max_price",
        (F.col("strong_total") < vocab.MIN_SAMPLE).alias("thin_market"), money.recommended(F.col("min_price"), F.col("strong_total")).alias("recommended_price"), "report",
    )


# --- a price's place in its market --------------------------------------------------------


def position_band(price: Column, low: Column, median: Column) -> Column:
    """best: within 1 % of the lowest; optimal: up to the median; expensive: over 15 % above it; else above."""
    return (
        F.when(price * 100 <= low * 101, F.lit("best"))
        .when(price <= median, F.lit("optimal"))
        .when(price * 100 > median * 115, F.lit("expensive"))
        .when(price.isNotNull() & median.isNotNull(), F.lit("above"))
    )


def spectrum(value: Column, low: Column, high: Column) -> Column:
    """Where a value lies between the ends, 0 to 1; null where they don't differ."""
    return F.when(high > low, F.least(F.greatest((value - low).cast("double") / (high - low).cast("double"), F.lit(0.0)), F.lit(1.0)))


def simulate(prices: DataFrame, most: int = 30) -> DataFrame:
    """Each row with every discount from 0 to ``most`` percent and the price it gives."""
    cut = F.bround(F.col("price") * (100 - F.col("discount")) / F.lit(100).cast("decimal(5,0)"), 2).cast(money.MONEY)
    return prices.withColumn("discount", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("simulated", cut)
