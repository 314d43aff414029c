"""Queries that run streams to their end, or write tables and read them back, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money
from ..operators import merge
from ..streaming import folders, refresh, verdicts
from . import catalog_queries as c
from . import source_queries as s
from . import testbed as t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _requests(spark, d):
    """Events as requests for a photo verdict, and what the model would say."""
    kind = F.col("event_type")
    answer = F.when(kind == "signup", "unsure").when(kind == "error", F.lit(None)).when(kind == "purchase", "used").otherwise("not_used")
    return t.table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("seq"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("at"), answer.alias("answer"))


_CACHE_SQL = f"""WITH RECURSIVE r AS (SELECT 'u' || user_id AS url, event_id AS seq, (epoch_us(CAST(ts AS TIMESTAMP)) // 1000) AS ms, CASE event_type WHEN 'signup' THEN 'unsure' WHEN 'error' THEN NULL WHEN 'purchase' THEN 'used' ELSE 'not_used' END AS answer,
  row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(CAST(ts AS TIMESTAMP)) // 1000), event_id) AS n FROM events),
k AS (SELECT *, CASE WHEN answer = 'unsure' THEN ms + {verdicts.DAY} WHEN answer IS NOT NULL THEN ms + {verdicts.TTL_ELSE} ELSE -1 END AS until FROM r),
c AS (SELECT url, seq, ms, n, answer AS verdict, false AS cached, until AS ends FROM k WHERE n = 1
  UNION ALL SELECT k.url, k.seq, k.ms, k.n, CASE WHEN k.ms < c.ends THEN c.verdict ELSE k.answer END, k.ms < c.ends, CASE WHEN k.ms < c.ends THEN c.ends ELSE k.until END FROM c JOIN k ON k.url = c.url AND k.n = c.n + 1)
"""


@query(_CACHE_SQL + "SELECT url, seq, verdict, cached, CASE WHEN ends >= 0 THEN ends END AS ends_ms FROM c")
def verdict_cache(spark, d):
    """Which requests the cache answers, by a streaming run over all events."""
    path = folders.shared(spark, "verdicts")
    _requests(spark, d).write.parquet(f"{path}/in")
    with folders.setting(spark, verdicts.STORE, verdicts.ROCKS):
        source = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
        run = verdicts.answered(source).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(verdicts.OUT).parquet(f"{path}/out").select("url", "seq", "verdict", "cached", F.unix_millis("expires_at").alias("ends_ms"))


def _product_pages(spark, d):
    """Product pages of all parts; every ninth is no product page."""
    p = t.table(spark, d, "part")
    card = F.struct(F.struct(s._product()["product"].alias("product")).alias("result"))
    state = F.struct(F.create_map(F.lit("ProductCardPageQuery(x)"), card).alias("_FAST_CACHE"))
    html = F.concat(F.lit("<script>window.ApolloCacheState = "), F.to_json(state), F.lit(";</script>"))
    return p.select(F.col("p_partkey").alias("listing_id"), F.when(F.col("p_partkey") % 9 != 4, html).otherwise(F.lit("<html>gone</html>")).alias("html"), (F.col("p_partkey") % 5).alias("chunk"))


@query("SELECT p_partkey AS listing_id, CASE WHEN p_partkey % 9 <> 4 THEN p_name END AS name, p_partkey % 9 = 4 AS failed FROM part")
def chunked_refresh(spark, d):
    """All listings refreshed from their pages in chunks; the first run breaks off after a chunk's rows and before its log, then everything is run again."""
    path = folders.shared(spark, "refresh")
    pages = _product_pages(spark, d)
    pages.repartition(5, "chunk").select("listing_id", "html").write.parquet(f"{path}/in")
    refresh.read_products(spark.read.parquet(f"{path}/in").limit(3)).write.parquet(f"{path}/out/rows/batch_id=0")
    source = spark.readStream.schema("listing_id long, html string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    refresh.refresh(source, f"{path}/out", f"{path}/state").awaitTermination()
    return refresh.rows(spark, f"{path}/out").select("listing_id", "name", F.col("error").isNotNull().alias("failed"))


@query("SELECT count(*) AS total, count(*) AS done, count(*) FILTER (p_partkey % 9 <> 4) AS refreshed, count(*) FILTER (p_partkey % 9 = 4) AS failed, 'Не вдалося оновити ' || count(*) FILTER (p_partkey % 9 = 4) || ' з ' || count(*) || ' товарів' AS message FROM part")
def refresh_progress(spark, d):
    """The counters of a refresh, from its chunks' log."""
    path = folders.shared(spark, "progress")
    _product_pages(spark, d).repartition(5, "chunk").select("listing_id", "html").write.parquet(f"{path}/in")
    source = spark.readStream.schema("listing_id long, html string").option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    refresh.refresh(source, f"{path}/out", f"{path}/state").awaitTermination()
    return refresh.progress(refresh.log(spark, f"{path}/out"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'OWN' || p_partkey WHEN p_partkey % 9 <> 4 THEN 'AB' || p_partkey || '0012' ELSE '' END AS numbers FROM part")
def oem_backfill(spark, d):
    """Part numbers of listings, from their product pages where they have none."""
    k = F.col("p_partkey")
    listings = t.table(spark, d, "part").select(k.alias("id"), F.when(k % 2 == 0, F.array(F.concat(F.lit("OWN"), k.cast("string")))).when(k % 4 == 1, F.array().cast("array<string>")).alias("oem_numbers"))
    return refresh.backfill(listings, refresh.read_products(_product_pages(spark, d))).select("id", F.array_join("oem_numbers", ",").alias("numbers"))


@query(c.SQL["upsert_merge"])
def merge_touched_files(spark, d):
    """The same import as `upsert_merge` into a stored table of which only touched buckets are rewritten."""
    path = folders.shared(spark, "listings")
    columns = [*merge.KEY, "name", "url", "sku", "brand", "currency", "price", "is_available", "last_seen_at"]
    merge.create(path, c._stored(spark, d).select(*columns), 16)
    merge.merge_into(path, c._incoming(spark, d), c._now(), 16)
    out = spark.read.parquet(path)
    return out.select("external_id", "name", "sku", "brand", "currency", money.cents(F.col("price")).alias("price_cents"), "is_available", (F.col("last_seen_at") == c._now()).alias("seen_now"))
