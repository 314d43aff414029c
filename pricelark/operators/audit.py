"""Audits of catalogues and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(listings: DataFrame) -> DataFrame:
    return listings.agg(F.count("*").alias("total"), F.count_if(F.col("price").isNull()).alias("unpriced"), F.count_if(F.col("price") <= 0).alias("not_positive"), F.count_if(~F.col("is_available")).alias("unavailable"))


def price_shapes(raw: DataFrame, column: str = "raw_price") -> DataFrame:
    c = F.col(column)
    return raw.agg(F.count_if(c.contains(",")).alias("comma"), F.count_if(c.contains(".")).alias("dot"), F.count_if(c.contains(",") & c.contains(".")).alias("both"), F.count_if(c.rlike(r"\s")).alias("space"))


def number_shapes(numbers: DataFrame) -> DataFrame:
    """By origin, how many part numbers have which shape; ``numbers``: origin, number."""
    n = F.col("number")
    return numbers.groupBy("origin").agg(
        F.count("*").alias("total"), F.count_if(n.rlike("^[0-9]+$")).alias("digits"), F.count_if(n.rlike("^[0-9]+$") & (F.length(n) < 8)).alias("short_digits"),
        F.count_if(n.rlike("[A-Za-z]")).alias("with_letter"), F.count_if(n.rlike("[^0-9A-Za-z]")).alias("with_mark"), F.count_if(F.length(n) < 6).alias("short"),
    )


def key_histogram(rows: DataFrame, column: str) -> DataFrame:
    """How many rows have each top-level key of a JSON column."""
    return rows.select(F.explode(F.map_keys(F.from_json(column, "map<string,string>"))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def key_paths(rows: DataFrame, column: str, deepest: int = 12) -> DataFrame:
    """(path, n): how often each key occurs at each place of a JSON column, nested ones too; items of arrays stand as ``[]``.

    Values are parsed once as VARIANT and opened level by level in the JVM.  Text that is no JSON
    counts nothing; a column that goes on below ``deepest`` levels is an error, not cut off.
    """
    spark = rows.sparkSession
    level = rows.select(F.lit("").alias("path"), F.try_parse_json(column).alias("v")).where("v IS NOT NULL")
    found = None
    for _ in range(deepest):
        opened = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        path = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))
        level = opened.select(path.alias("path"), F.col("key").isNotNull().alias("named"), F.col("value").alias("v"))
        counted = level.where("named").groupBy("path").agg(F.count("*").alias("n"))
        found = counted if found is None else found.unionByName(counted)
        level = level.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)<")).select("path", "v")
        if level.isEmpty():
            return found.groupBy("path").agg(F.sum("n").alias("n"))
    raise ValueError(f"{column} is nested deeper than {deepest} levels")


def drift(verdicts: DataFrame) -> DataFrame:
    """Per item of repeated runs (item, run, verdict): number of verdicts and whether they differ."""
    return verdicts.groupBy("item").agg(F.countDistinct("verdict").alias("verdicts")).withColumn("drift", F.col("verdicts") > 1)


def disagreement(verdicts: DataFrame) -> DataFrame:
    """Per pair of runs the share of items whose verdicts differ, to four places."""
    a = verdicts.select("item", F.col("run").alias("run_a"), F.col("verdict").alias("va"))
    b = verdicts.select("item", F.col("run").alias("run_b"), F.col("verdict").alias("vb"))
    pairs = a.join(b, "item").where("run_a < run_b").groupBy("run_a", "run_b")
    return pairs.agg(F.bround(F.count_if(F.col("va") != F.col("vb")) / F.count("*"), 4).alias("rate"))


def gate_comparison(off: DataFrame, on: DataFrame) -> DataFrame:
    """Queries whose recommendation the availability gate changes."""
    a = off.select("query_id", F.col("recommended_price").alias("without"))
    b = on.select("query_id", F.col("recommended_price").alias("with"))
    return a.join(b, "query_id").where(~F.col("without").eqNullSafe(F.col("with")))


def demoted(before: DataFrame, after: DataFrame) -> DataFrame:
    """Offers out of stock that the gate left at a confidence that counts; there should be none."""
    from ..functions import text, vocab

    out = before.where(F.coalesce(F.coalesce(F.col("stock"), text.stock_of(F.col("availability"))) == "out_of_stock", F.lit(False)))
    return after.join(out.select("query_id", "source_ord", "offer_ord"), ["query_id", "source_ord", "offer_ord"], "left_semi").where(F.col("confidence") >= vocab.STRONG)


def photo_keys(offers: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached photo verdicts (key, verdict) of offers, by the hash of their url."""
    return offers.withColumn("key", F.concat(F.lit("photo-used:v1:"), F.sha1("url"))).join(cache, "key")


def signals(offers: DataFrame) -> DataFrame:
    """Per query: offers out of stock, sets, used words that were missed, analogues below half the median, image coverage."""
    from ..functions import text
    from . import market

    a = market.anchors(offers).select("query_id", "anchor")
    o = offers.join(a, "query_id", "left")
    low = F.col("is_analog") & (F.col("price") * 2 < F.col("anchor"))
    return o.groupBy("query_id").agg(
        F.count_if(text.stock_of(F.col("availability")) == "out_of_stock").alias("out_of_stock"), F.count_if(text.any_of(F.col("title"), (r"\bкомплект\w*", r"\bнабір\b", r"\bнабор\b"))).alias("sets"),
        F.count_if(text.is_used(F.col("title"))).alias("used"), F.count_if(low).alias("low_analogs"), F.count_if(F.col("image_url").isNotNull()).alias("with_image"),
    )


def summary(stats: DataFrame) -> DataFrame:
    """Reports by thin market: how many, their offers and strong prices, and how many have a recommendation."""
    return stats.groupBy("thin_market").agg(F.count("*").alias("reports"), F.sum("offers_total").alias("offers"), F.sum("strong_total").alias("strong"), F.count("recommended_price").alias("recommended"))


# --- samples and probes ---------------------------------------------------------------------

SETS = r"комплект|пара|2\s*шт"
SIDES = "лів|прав|лев|перед|задн|внутр|зовніш|внешн"
SYNONYMS = "маточин|ступиц|кришк|крышк"


def name_pathologies(listings: DataFrame) -> DataFrame:
    """How many names speak of sets, of sides, of a gearbox (whose word begins like a side), and of parts with names in two languages."""
    has = lambda p: F.col("name").rlike(f"(?iu)(?:{p})")
    return listings.agg(
        F.count_if(has(SETS)).alias("sets"), F.count_if(has(SIDES)).alias("sides"), F.count_if(has("передач")).alias("gearbox"), F.count_if(has("передач") & has("задн")).alias("gearbox_rear"),
        F.count_if(has("кпп")).alias("gearbox_short"), F.count_if(has(SYNONYMS)).alias("synonyms"), F.count_if(has("внутр")).alias("inner_side"), F.count_if(has("зовніш|внешн")).alias("outer_side"),
    )


def sample(rows: DataFrame, *order: str, most: int = 60) -> DataFrame:
    """The first ``most`` rows in an order: a report to read, a top-k of its kind."""
    return rows.orderBy(*order).limit(most)


def odd_numbers(numbers: DataFrame) -> DataFrame:
    """Part numbers (origin, number, id) without a digit, with Cyrillic letters, or longer than 20."""
    n = F.col("number")
    return numbers.where(~n.rlike("[0-9]") | n.rlike("[А-Яа-яІіЇїЄєЁё]") | (F.length(n) > 20))


def unmatched_photo_keys(cache: DataFrame, offers: DataFrame) -> DataFrame:
    """Cached verdicts (key, verdict) that belong to no offer."""
    return cache.join(offers.select(F.concat(F.lit("photo-used:v1:"), F.sha1("url")).alias("key")), "key", "left_anti")


def weak_by_name(offers: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, source, offer_ord, similarity) of offers that count by their number alone: their names are not alike enough."""
    from ..functions import text, vocab

    asked = queries.select("query_id", text.name_tokens(F.col("name")).alias("_ours"))
    alike = text.token_similarity(F.col("_ours"), text.name_tokens(F.col("title")))
    found = offers.where(F.col("confidence") >= vocab.OEM_HIT).join(asked, "query_id").withColumn("similarity", alike)
    return found.where(F.col("similarity") < vocab.NAME_KEEP).select("query_id", "source", "offer_ord", "similarity")
