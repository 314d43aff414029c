"""Crawled pages in their order: where a catalogue of unknown length ends, what can't be read, where a feed goes on.

Nothing here fetches.  A crawl is a table: a row for each page and attempt.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import pages as source

#: Pages of a feed that are read at most, the first included.
FEED_PAGES = 4
#: Pages that a worker holds as Python texts at once.
HELD = 256


def _slices(batches):
    """The same rows in batches of ``HELD`` at most."""
    for b in batches:
        yield from (b.slice(at, HELD) for at in range(0, b.num_rows, HELD))


def listing_pages(pages: DataFrame, prefix: str = source.LISTING) -> DataFrame:
    """``pages`` (html and any columns) with ``total``, ``products`` (raw, in order), ``ids`` and ``error`` in place of html."""
    kept = [c for c in pages.columns if c != "html"]

    def run(batches):
        for b in _slices(batches):
            got = [source.state_record(h, prefix) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array([r for r, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=[*kept, "_record", "error"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "html"), "_record string", "error string"])
    read = pages.mapInArrow(run, fields).withColumn("_page", F.from_json("_record", source._PAGE)["result"]["listing"]["page"])
    products = F.filter(F.coalesce(F.col("_page.products")["product"], F.array().cast(f"array<{source.RAW}>")), lambda p: p.isNotNull())
    return read.select(*kept, F.col("_page.total").alias("total"), products.alias("products"), F.transform(products, lambda p: p["id"]).alias("ids"), "error")


def readable() -> Column:
    """A page that holds a catalogue: a total or products.  One with neither is no end of a catalogue but a page that failed."""
    return F.col("total").isNotNull() | (F.size("products") > 0)


def settled(read: DataFrame, *series: str) -> DataFrame:
    """Each page (series, page) once: its first readable attempt, or else its last one.  ``read`` has page and attempt."""
    order = [F.when(readable(), 0).otherwise(1), F.when(readable(), F.col("attempt")).otherwise(-F.col("attempt"))]
    w = Window.partitionBy(*series, "page").orderBy(*order, F.to_json("ids"))
    return read.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def strict(pages: DataFrame, *series: str) -> DataFrame:
    """The pages; the job fails at one that isn't readable, so that no import is cut short in silence."""
    told = F.concat_ws(" ", F.lit("no catalogue on page"), F.col("page").cast("string"), F.lit("of"), F.concat_ws("/", *[F.col(c).cast("string") for c in series]), F.coalesce("error", F.lit("")))
    return pages.where(F.when(readable(), F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))


def parted(pages: DataFrame, observation: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(readable pages, quarantined ones with ``error``).  ``observation`` gets ``pages`` and ``unreadable`` once the first part has run."""
    seen = pages.observe(observation, F.count("*").alias("pages"), F.count_if(~readable()).alias("unreadable")) if observation is not None else pages
    return seen.where(readable()), pages.where(~readable()).withColumn("error", F.coalesce("error", F.lit("neither a total nor products")))


def until_end(pages: DataFrame, *series: str) -> DataFrame:
    """Pages of each series before its end: the first page, after the first one there is, that is empty or shows the products of an earlier page.

    A page's signature is the list of its product ids; two of them that differ never count as
    equal.  Later pages don't count, whatever they show.
    """
    by_series = Window.partitionBy(*series)
    signature = F.to_json("ids")
    first = F.min("page").over(by_series)
    before = F.min("page").over(Window.partitionBy(*series, "_signature"))
    marked = pages.withColumn("_signature", signature).withColumn("_first", first).withColumn("_shown", before)
    ends = (F.col("page") > F.col("_first")) & ((F.size("ids") == 0) | (F.col("_shown") < F.col("page")))
    stop = F.min(F.when(ends, F.col("page"))).over(by_series)
    return marked.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))).drop("_signature", "_first", "_shown", "_stop")


def token_key(token: Column) -> Column:
    """A continuation token (JSON) without blanks, its keys in order: tokens that ask for the same page are equal.  Null if it is no JSON."""
    return F.to_json(F.try_parse_json(token))


def follow(starts: DataFrame, continuations: DataFrame, most: int = FEED_PAGES) -> DataFrame:
    """(starts' columns, page, at): the pages a feed goes on to, from page 1; ``at`` is the token of each.

    ``starts`` has ``token``, that of its first page (page 0).  ``continuations``: token, next (its page's own
    token), error.  A link that is missing or has an error ends the chain, and what came before stays.
    Feeds move on page by page, each in one row, and every step reads the same shuffled links, so the plan
    grows with ``most`` and pages are parsed once; a chain that leads back to itself ends at ``most``.
    """
    fine = continuations.where("error IS NULL").groupBy(token_key(F.col("token")).alias("_next")).agg(F.min(token_key(F.col("next"))).alias("_to"))
    return follow_keys(starts, fine, most)


def follow_keys(starts: DataFrame, links: DataFrame, most: int = FEED_PAGES) -> DataFrame:
    """`follow` over ``links`` that are ready: _next and _to, `token_key` of a page's token and of its own, each _next once."""
    # Both columns are needed at each step, the last one too, or its links would be another exchange.
    known = links.where("_next IS NOT NULL").select("_next", F.struct("_to").alias("_page")).hint("merge")
    chain = starts.withColumn("_next", token_key(F.col("token"))).withColumn("_ats", F.array().cast("array<string>"))
    if most < 2:
        chain = chain.where(F.lit(False))
    for page in range(1, most):
        met = chain.join(known, "_next", "left" if page > 1 else "inner")
        ats = F.when(F.col("_page").isNull(), F.col("_ats")).otherwise(F.concat("_ats", F.array("_next")))
        # What ended keeps a key that is no JSON, each its own, so that ends don't gather in one task.
        after = F.coalesce(F.col("_page")["_to"], F.concat(F.lit("\0"), "_next"))
        chain = met.select(*starts.columns, after.alias("_next"), ats.alias("_ats"))
    each = chain.select(*starts.columns, F.posexplode("_ats").alias("page", "at"))
    return each.withColumn("page", F.col("page") + 1)


def interleaved(plan: DataFrame) -> DataFrame:
    """Pages still to be read (url, page, group) with their ``turn``: the first remaining page of every group, then the second of every group, and so on."""
    nth = F.row_number().over(Window.partitionBy("url", "group").orderBy("page"))
    return plan.withColumn("_nth", nth).withColumn("turn", F.row_number().over(Window.partitionBy("url").orderBy("_nth", "group")) - 1).drop("_nth")
