"""Upserts, soft deletes and patches, as joins that give the new state of a table.

Tables here are immutable files: each operator returns the whole new state, for the caller
to write.  Keys are unique in the stored side; of equal keys in the incoming side the last
by ``ord`` counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, urls

KEY = ["store_id", "external_id"]


def latest(rows: DataFrame, *keys: str, by: str = "ord") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def valid_products(products: DataFrame) -> DataFrame:
    return products.where("external_id IS NOT NULL AND coalesce(name, '') <> '' AND coalesce(url, '') <> ''")


def filled(new: Column, old: Column) -> Column:
    """The new text unless it is empty."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def upsert(stored: DataFrame, products: DataFrame, now: Column) -> DataFrame:
    """Listings after an import.

    What a product carries wins field by field, what it leaves empty stays; its currency
    always counts (UAH if none); a price only above 0; availability only if known.
    """
    new = latest(valid_products(products), *KEY)
    n = new.select(*KEY, *[F.col(c).alias(f"_{c}") for c in ("name", "url", "sku", "brand", "currency", "price", "is_available")], F.lit(True).alias("_in"))
    both = stored.join(n, KEY, "full")
    came = F.coalesce(F.col("_in"), F.lit(False))
    text = [F.when(came, filled(F.col(f"_{c}"), F.col(c))).otherwise(F.col(c)).alias(c) for c in ("name", "url", "sku", "brand")]
    return both.select(
        *KEY, *text,
        F.when(came, money.currency_code(F.col("_currency"))).otherwise(F.col("currency")).alias("currency"),
        F.when(came, F.coalesce(money.positive(F.col("_price")), F.col("price"))).otherwise(F.col("price")).alias("price"),
        F.when(came, F.coalesce(F.col("_is_available"), F.col("is_available"))).otherwise(F.col("is_available")).alias("is_available"),
        F.when(came, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )


# --- a stored table whose untouched files stay ----------------------------------------------

BUCKETS = 64


def bucket_of(buckets: int, keys: list[str] = KEY) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int").alias("bucket")


def _in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """By bucket; the rebalance parts a bucket that is too large for one file."""
    return rows.withColumn("bucket", bucket_of(buckets)).hint("rebalance", "bucket")


def create(path: str, listings: DataFrame, buckets: int = BUCKETS) -> None:
    """Write a table of listings, parted by a hash of its key.  More buckets mean less to rewrite for a small import."""
    _in_buckets(listings, buckets).write.mode("errorifexists").partitionBy("bucket").parquet(path)


def merge_into(path: str, products: DataFrame, now: Column, buckets: int = BUCKETS) -> list[int]:
    """`upsert` into the table at ``path``, rewriting only buckets that an incoming key falls into; their numbers.

    ``buckets`` is what the table was created with.  Files of other buckets are neither read nor written.
    New files are staged and take their buckets' place when all are written; products are read once more for that.
    """
    spark = products.sparkSession
    new = valid_products(products).withColumn("bucket", bucket_of(buckets))
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # ``buckets`` numbers at most
    if not touched:
        return []
    stored = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    merged = upsert(stored.drop("bucket"), products, now).select(*[c for c in stored.columns if c != "bucket"])
    _in_buckets(merged, buckets).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def observed(stored: DataFrame, products: DataFrame, now: Column) -> DataFrame:
    """Price observations an import adds: new listings, and those whose price, currency or availability differs.

    A product without a price adds none.
    """
    new = latest(valid_products(products), *KEY).withColumn("price", money.positive(F.col("price"))).withColumn("currency", money.currency_code(F.col("currency"))).where("price IS NOT NULL")
    old = stored.select(*KEY, *[F.col(c).alias(f"_{c}") for c in ("price", "currency", "is_available")], F.lit(True).alias("_known"))
    same = F.col("price").eqNullSafe(F.col("_price")) & F.col("currency").eqNullSafe(F.col("_currency")) & F.col("is_available").eqNullSafe(F.col("_is_available"))
    joined = new.join(old, KEY, "left").where(F.col("_known").isNull() | ~same)
    return joined.select(*KEY, "price", "currency", "is_available", now.alias("observed_at"))


def merge_maps(stored: Column, incoming: Column) -> Column:
    """A stored map overlaid by the non-empty values of another."""
    kept = F.map_filter(incoming, lambda k, v: v.isNotNull() & (v != ""))
    old = F.coalesce(stored, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(kept, k)), kept)


def upsert_by(stored: DataFrame, rows: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """New keys are added whole; known ones have only the columns of ``update`` changed (stores, bridges, exclusions)."""
    n = latest(rows, *keys).select(*keys, *[F.col(c).alias(f"_{c}") for c in stored.columns if c not in keys], F.lit(True).alias("_in"))
    both = stored.withColumn("_old", F.lit(True)).join(n, keys, "full")
    pick = lambda c: F.when(F.col("_old").isNull() | (F.lit(c in update) & F.col("_in")), F.col(f"_{c}")).otherwise(F.col(c))
    return both.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in stored.columns])


def soft_delete(overrides: DataFrame, ids: DataFrame) -> DataFrame:
    """Overrides with a tombstone for each listing id: set where there is a row, a bare row elsewhere."""
    gone = ids.select(F.col("id").alias("listing_id"), F.lit(True).alias("_gone")).distinct()
    both = overrides.join(gone, "listing_id", "full")
    return both.withColumn("is_deleted", F.coalesce("_gone", "is_deleted", F.lit(False))).select(*overrides.columns)


def undelete(overrides: DataFrame, ids: DataFrame) -> DataFrame:
    """Bare tombstones of the listings go; other rows lose the mark."""
    back = ids.select(F.col("id").alias("listing_id"), F.lit(True).alias("_back")).distinct()
    both = overrides.join(back, "listing_id", "left")
    returns = F.coalesce(F.col("_back"), F.lit(False)) & F.coalesce(F.col("is_deleted"), F.lit(False))
    bare = F.coalesce("name", F.col("price").cast("string"), "sku", "brand").isNull()
    return both.where(~(returns & bare)).withColumn("is_deleted", F.when(returns, F.lit(False)).otherwise(F.col("is_deleted"))).select(*overrides.columns)


def delete_exports(listings: DataFrame, *dependents: DataFrame) -> list[DataFrame]:
    """Listings, and each dependent by listing_id, without those that came from a file."""
    gone = listings.where(urls.is_export(F.col("url"))).select(F.col("id").alias("listing_id"))
    rest = listings.where(~urls.is_export(F.col("url")))
    return [rest, *[d.join(gone, "listing_id", "left_anti") for d in dependents]]


def seed_overrides(overrides: DataFrame, listings: DataFrame, ids: DataFrame) -> DataFrame:
    """Overrides with a copy of its listing for each id that has none."""
    names = [c for c in overrides.columns if c != "listing_id"]
    missing = listings.join(ids.select("id").distinct(), "id", "left_semi").join(overrides.select(F.col("listing_id").alias("id")), "id", "left_anti")
    copied = [F.col(c) if c in listings.columns else F.lit(False).alias(c) if c == "is_deleted" else F.lit(None).cast(dict(overrides.dtypes)[c]).alias(c) for c in names]
    return overrides.unionByName(missing.select(F.col("id").alias("listing_id"), *copied))


def mirror_pages(overrides: DataFrame, pages: DataFrame, now: Column) -> DataFrame:
    """Overrides after a page refresh: the page's fields count, blanks too, but for a blank name; tombstones go."""
    p = pages.select("listing_id", *[F.col(c).alias(f"_{c}") for c in ("name", "sku", "brand", "price", "is_available")], F.lit(True).alias("_in"))
    both = overrides.join(p, "listing_id", "left")
    came = F.col("_in").isNotNull()
    new = {c: F.when(came, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("sku", "brand", "price", "is_available")}
    new["name"] = F.when(came, filled(F.trim("_name"), F.col("name"))).otherwise(F.col("name"))
    new["is_deleted"] = F.when(came, F.lit(False)).otherwise(F.col("is_deleted"))
    new["updated_at"] = F.when(came, now).otherwise(F.col("updated_at"))
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in overrides.columns])


def patch(rows: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the columns a patch sets (``set_<column>`` true) replaced, nulls too."""
    p = patches.select(key, *[F.col(c).alias(f"_{c}") for c in columns], *[F.col(f"set_{c}") for c in columns])
    both = rows.join(p, key, "left")
    return both.select(*[F.when(F.coalesce(F.col(f"set_{c}"), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def changes(observations: DataFrame) -> DataFrame:
    """The observations that differ from the one before of their listing in price, currency or availability."""
    w = Window.partitionBy("listing_id").orderBy("observed_at", "seq")
    now = F.struct("price", "currency", "is_available")
    before = F.lag(now).over(w)
    priced = observations.where("price IS NOT NULL")
    return priced.withColumn("_b", before).where(~F.col("_b").eqNullSafe(now)).drop("_b")
