"""Whole sources, from raw pages to offers: what each source does with its pages, for all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, text, vocab
from ..sources import crawl, pages
from . import offers

FEED = "https://avto.pro"
#: Part numbers of a query that a feed is asked for, in order.
FEED_NUMBERS = 3
FEED_HIT, FEED_MOST = 0.98, vocab.SOURCE_MOST["avtopro"]


def row_text(maker: Column, code: Column, description: Column) -> Column:
    """A feed row as one line for the gates: maker, code and description, empty ones left out."""
    filled = F.filter(F.array(maker, code, description), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.array_join(filled, " ")


def first_that_answers(offers: DataFrame, rank: str = "rank", key: str = "query_id") -> DataFrame:
    """Of each query's offers those of its first term (smallest ``rank``) that has any left.  Comes after gates and dedupe."""
    first = F.min(rank).over(Window.partitionBy(key))
    return offers.withColumn("_first", first).where(F.col(rank) == F.col("_first")).drop("_first")


def feed_rows(found: DataFrame, first_pages: DataFrame, continuations: DataFrame, most: int = crawl.FEED_PAGES) -> DataFrame:
    """Rows of the part pages that ``found`` (query_id, rank, part_uri, and more) names, followed through their continuations.

    ``first_pages``: url (``part_uri``), html; ``continuations``: token, html, error.  Rows
    have found's columns, ``page``, and those of `pages.feed_offers`.
    """
    of = lambda c: F.element_at("_page", 1)[c]
    begun = found.join(pages.read_once(pages.feed_lists(first_pages.select(F.col("url").alias("part_uri"), "html")), "part_uri").hint("merge"), "part_uri")
    # Exploded, a token's conditions stay above the exchange of pages, which the rows share.
    start = begun.select(*found.columns, F.explode_outer(F.array(F.when(of("is_feed"), of("token")))).alias("token"))
    # A page that failed isn't read.  A token that failed once ends the chain, whatever other rows of it show.
    asked = continuations.select(crawl.token_key(F.col("token")).alias("at"), F.col("token").alias("asked"), F.col("error").isNotNull().alias("failed"), F.when(F.col("error").isNull(), F.col("html")).alias("html"))
    read = pages.read_once(pages.feed_lists(asked), "at")
    told = read.groupBy(of("asked")).agg(F.min("at").alias("_next"), F.bool_or(of("failed")).alias("_failed"), F.bool_or(of("is_feed")).alias("_read"), F.min(F.when(of("is_feed"), crawl.token_key(of("token")))).alias("_to"))
    links = told.where("_read AND NOT _failed").groupBy("_next").agg(F.min("_to").alias("_to"))
    later = crawl.follow_keys(start, links, most).join(read.hint("merge"), "at")
    whole = [x.select(*found.columns, page.alias("page"), of("rows").alias("rows")) for x, page in ((begun, F.lit(0)), (later, F.col("page")))]
    return pages.offers_of(whole[0].unionByName(whole[1]), "own_uri")


def feed_gated(queries: DataFrame, suggested: DataFrame, first_pages: DataFrame, continuations: DataFrame, most_pages: int = crawl.FEED_PAGES) -> DataFrame:
    """Rows of the parts feed that survive the gates, for each query and all its part numbers; the tables as `feed_source` has them.

    A query has rows here if and only if `feed_source` has offers for it.
    """
    asked = queries.select("query_id", "brand", "name", "oem_numbers", F.coalesce(F.col("manual"), F.lit(False)).alias("manual"))
    ranked = suggested.where(F.col("rank") < FEED_NUMBERS).select(F.struct("query_id", "rank").alias("query_id"), "payload")
    each = asked.join(suggested.where(F.col("rank") < FEED_NUMBERS).select("query_id", "rank").distinct().hint("merge"), "query_id").where(F.col("rank") < F.size("oem_numbers"))
    keyed = each.select(F.struct("query_id", "rank").alias("query_id"), "brand", "name", "manual")
    listed = pages.suggestions(ranked)
    picked = pages.pick_suggestion(listed, keyed.where("NOT manual")).unionByName(pages.pick_suggestion(listed, keyed.where("manual"), fallback=True))
    found = picked.select("query_id.query_id", "query_id.rank", "part_uri", F.col("title").alias("_suggested"))
    rows = feed_rows(found, first_pages, continuations, most_pages)
    line = row_text(F.col("maker"), F.col("code"), F.col("description"))
    return rows.withColumn("_line", line).where(~F.col("used") & ~text.is_junk(F.col("_line"), F.col("availability")))


def feed_source(queries: DataFrame, suggested: DataFrame, first_pages: DataFrame, continuations: DataFrame, most_pages: int = crawl.FEED_PAGES) -> DataFrame:
    """Offers of the parts feed for each query: those of its first part number whose rows survive the gates.

    ``queries``: query_id, oem_numbers, brand, name, manual.  ``suggested``: query_id, rank (place of the number, from 0), payload.
    A number without a suggestion, or whose rows are all used or on request, falls back to the
    next.  Junk goes before the dedupe, which keeps the cheapest row of a maker's code; the
    first 40 by confidence, then price, stay.
    """
    # Dealt out by query once: its own windows and the join all need no more.
    fine = feed_gated(queries, suggested, first_pages, continuations, most_pages).withColumn("_code", text.norm_code(F.col("code"))).withColumn("_maker", F.coalesce("maker", F.lit(""))).repartition("query_id")
    code = F.col("_code")
    cheapest = F.row_number().over(Window.partitionBy("query_id", "rank", "_maker", "_code").orderBy("price", "page", "offer_ord"))
    unique = fine.withColumn("_rn", cheapest).where("_rn = 1").drop("_rn").join(queries.select("query_id", F.transform("oem_numbers", text.norm_code).alias("_exact")).hint("merge"), "query_id")
    exact = F.array_contains("_exact", code)
    made = unique.withColumn("confidence", F.when(exact, F.lit(FEED_HIT)).otherwise(F.lit(vocab.ANALOG))).withColumn("is_analog", ~exact)
    top = F.row_number().over(Window.partitionBy("query_id", "rank").orderBy(F.col("confidence").desc(), "price", "page", "offer_ord"))
    kept = first_that_answers(made.withColumn("_top", top).where(F.col("_top") <= FEED_MOST))
    none = F.lit(None).cast("string")
    # Used rows are gone, so all that are left count as new.
    return kept.select(
        "query_id", F.lit("avtopro").alias("source"), F.lit(1).alias("source_ord"), F.col("_top").cast("long").alias("offer_ord"), F.coalesce(F.nullif("_line", F.lit("")), "_suggested").alias("title"),
        F.col("price").cast(money.MONEY).alias("price"), "currency", none.alias("seller"), F.concat(F.lit(FEED), F.coalesce(F.nullif("own_uri", F.lit("")), "part_uri")).alias("url"), "city", "availability",
        F.lit("new").alias("condition"), none.alias("image_url"), "confidence", "is_analog", none.alias("stock"), "rank",
    )


def feed_status(queries: DataFrame, offers: DataFrame) -> DataFrame:
    """(query_id, source, status) of the feed: skipped without a part number, empty without offers (or rows of `feed_gated`), else ok."""
    some = offers.select("query_id").distinct().withColumn("_some", F.lit(True))
    status = F.when(F.coalesce(F.size("oem_numbers"), F.lit(0)) <= 0, F.lit("skipped")).when(F.col("_some"), F.lit("ok")).otherwise(F.lit("empty"))
    return queries.join(some.hint("merge"), "query_id", "left").select("query_id", F.lit("avtopro").alias("source"), status.alias("status"))


def market_source(queries: DataFrame, found: DataFrame, owners: DataFrame) -> DataFrame:
    """Offers of the marketplace's search for each query, from its result pages.

    ``found``: query_id, term, term_ord, page, html.  A page that can't be read adds nothing.  Products
    keep their place by term, page and position; what comes after is `offers.from_products`.
    """
    read = crawl.listing_pages(found.select("query_id", "term", "term_ord", "page", "html"), pages.SEARCH)
    each = read.select("query_id", "term", "term_ord", "page", F.posexplode("products").alias("position", "p"))
    products = each.select("query_id", "term", "term_ord", "page", "position", *pages.product(F.col("p")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("term_ord", "page", "position")) - 1
    return offers.from_products(products.withColumn("place", place.cast("long")), queries, owners)


def web_source(queries: DataFrame, results: DataFrame, fetched: DataFrame, source: str = "google", only_domains: tuple = ()) -> DataFrame:
    """Offers of a web search: candidates, the price their page states or their snippet names, and the source's best.

    With ``only_domains`` it is a search of those sites alone.  ``results`` and ``fetched`` as `pages.web_candidates` and `pages.web_offers` read them.
    """
    ordinal = list(vocab.SOURCE_MOST).index(source)
    made = pages.web_offers(pages.web_candidates(results, queries, only_domains), fetched)
    return offers.top_per_source(made.withColumn("source", F.lit(source)).withColumn("source_ord", F.lit(ordinal)))
