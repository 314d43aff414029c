"""Domain relations laid over the TPC-H-like test tables.

There is no marketplace data among the test tables, so queries over them use this fixed
projection: parts are listings, line items are offers, suppliers are sellers and stores,
events are price observations.  `SQL` has the same projection as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = (
    "Фара ліва передня BMW", "Фара права передня BMW", "Амортизатор задній б/у", "Радіатор охолодження 77 00 308 222 Kangoo",
    "Бампер передній новий", "Фільтр масляний ціна за запитом", "Стартер контрактний", "Генератор Bosch 120A",
    "Двигун з розборки", "Блок управління ЕБУ двигуна Bosch", "Headlight left used", "Filter new in box",
    "Ціна договірна, підшипник", "Ступиця нижня", "Ступиця верхня", "Комплект зчеплення",
)
STOCKS = (
    "В наявності", "Немає в наявності", "не в наявності", "Під замовлення", "Отправка товара завтра из г. Киев", "Отправка товара через 5 дней из г. Киев",
    "avail", "not_avail", "Закінчився", "in stock", "Sold out", "очікується", "order",
)
PRICES = ("1 234,56", "1,234.56", "1.234", "-15%", "1 299 грн", "договірна", "", "999.995", "12")
SNIPPETS = ("від 365 ₴ x 6 ; від 365 ₴", "Ціна 2190 грн. Або від 365 ₴ x 6", "Купити за 204 грн", "від 199 грн/міс", "без ціни", "1 250,50 UAH сьогодні")
NUMBERS = ("062 121 350", " w914/2 ", "12", "---", "Audi 100", "PEUGEOT206", "8E0 513 033", "vkba6522", "77 00 308 222", "1.6-1.8-2.0")
RATES = {"USD": "41.5000", "EUR": "45.2500"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, key) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _cents(c: Column) -> Column:
    return (c.cast("decimal(14,0)") / 100).cast("decimal(14,2)")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    export = F.concat(F.lit("https://shop-cs"), (k % 10).cast("string"), F.lit(".prom.ua/p"), k.cast("string"), F.lit("-x.html"))
    page = F.concat(F.lit("https://prom.ua/ua/p"), k.cast("string"), F.lit("-x.html"))
    return table(spark, sf_dir, "part").select(
        k.alias("id"), (k % 10).alias("store_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("sku"),
        _cents(F.round(F.col("p_retailprice") * 100).cast("long")).alias("price"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("is_available"),
        F.when(k % 2 == 0, export).otherwise(page).alias("url"), F.lit("UAH").alias("currency"), F.timestamp_seconds(k).alias("last_seen_at"), F.col("p_type").alias("category"),
    )


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    return listings(spark, sf_dir).where(k % 7 == 0).select(
        k.alias("listing_id"), F.when(k % 14 != 0, F.concat(F.lit("Override "), F.col("name"))).alias("name"), F.when(k % 28 != 0, F.col("sku")).alias("sku"), F.when(k % 28 != 0, F.col("brand")).alias("brand"),
        F.when(k % 49 != 0, (F.col("price") + 10).cast("decimal(14,2)")).alias("price"), (k % 2 == 0).alias("is_available"), (k % 21 == 0).alias("is_deleted"), F.timestamp_seconds(k + 1_000_000).alias("updated_at"),
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every store that a listing names."""
    s = table(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("store_id")).distinct()
    return s.select("store_id", F.when(F.col("store_id") % 5 == 0, "owned").otherwise("competitor").alias("kind"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as offers; (order, seller, line, quantity) tells a part's apart."""
    s, n = F.col("l_suppkey"), F.col("l_linenumber")
    flag = F.col("l_returnflag")
    money = F.expr("CAST(round(l_extendedprice * 100) AS BIGINT) DIV CAST(l_quantity AS BIGINT)")
    confidence = F.when(n == 1, 0.95).when(n == 2, 0.9).when(n == 3, 0.75).when(n == 4, 0.7).when(n == 5, 0.55).otherwise(0.5)
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("query_id"), F.when(flag == "A", "prom").when(flag == "N", "avtopro").otherwise("google").alias("source"),
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("source_ord"), (F.col("l_orderkey") * 10_000_000_000 + s * 10_000 + n * 100 + F.col("l_quantity").cast("long")).alias("offer_ord"),
        pick(TITLES, F.col("l_orderkey")).alias("title"), _cents(money).alias("price"), F.when(s % 10 == 0, "USD").when(s % 10 == 1, "EUR").otherwise("UAH").alias("currency"), s.alias("seller"),
        F.concat(F.lit("https://shop"), s.cast("string"), F.when(s % 4 == 0, ".com").when(s % 4 == 1, ".kemp.ua").otherwise(".ua"), F.lit("/p"), F.col("l_orderkey").cast("string")).alias("url"),
        F.when(F.col("l_linestatus") == "F", "Немає в наявності").otherwise("В наявності").alias("availability"), confidence.alias("confidence"), (n >= 3).alias("is_analog"),
        F.when(s % 3 == 0, F.concat(F.lit("https://img/"), s.cast("string"))).alias("image_url"), F.when(n % 2 == 0, "new").alias("condition"), F.lit(None).cast("string").alias("stock"),
    )
    return rows


def fine_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at a finer grain, so that some queries have few offers: a query is a part and a stock state."""
    o = offers(spark, sf_dir)
    return o.withColumn("query_id", F.col("query_id") * 10 + F.col("source_ord") * 2 + (F.col("availability") == "В наявності").cast("int"))


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in RATES.items()], "code string, rate string")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("listing_id"), F.col("event_id").alias("seq"), F.round("value").cast("long").alias("price_cents"), F.lit("UAH").alias("currency"),
        F.when(kind == "error", F.lit(None)).otherwise(kind.isin("purchase", "view")).alias("is_available"), F.col("ts").cast("timestamp").alias("observed_at"),
    )


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick_sql(values, key: str) -> str:
    return f"{_list(values)}[CAST({key} % {len(values)} AS INT) + 1]"


#: The projection for DuckDB; amounts are whole cents.
SQL = {
    "listing": """listing AS (SELECT p_partkey AS id, p_partkey % 10 AS store_id, p_name AS name, p_brand AS brand, p_brand || '-' || p_size AS sku, CAST(round(p_retailprice * 100) AS BIGINT) AS cents,
  CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_available,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://shop-cs' || (p_partkey % 10) || '.prom.ua/p' || p_partkey || '-x.html' ELSE 'https://prom.ua/ua/p' || p_partkey || '-x.html' END AS url, p_partkey AS seen FROM part)""",
    "override": """override AS (SELECT id AS listing_id, CASE WHEN id % 14 <> 0 THEN 'Override ' || name END AS name, CASE WHEN id % 28 <> 0 THEN sku END AS sku, CASE WHEN id % 28 <> 0 THEN brand END AS brand,
  CASE WHEN id % 49 <> 0 THEN cents + 1000 END AS cents, id % 2 = 0 AS is_available, id % 21 = 0 AS is_deleted, id + 1000000 AS seen FROM listing WHERE id % 7 = 0)""",
    "store": "store AS (SELECT DISTINCT p_partkey % 10 AS store_id, CASE WHEN p_partkey % 10 % 5 = 0 THEN 'owned' ELSE 'competitor' END AS kind FROM part)",
    "cat": """cat AS (SELECT l.id, l.store_id, s.kind, l.url, CASE WHEN o.listing_id IS NOT NULL THEN o.name ELSE l.name END AS name, CASE WHEN o.listing_id IS NOT NULL THEN o.sku ELSE l.sku END AS sku,
  CASE WHEN o.listing_id IS NOT NULL THEN o.brand ELSE l.brand END AS brand, CASE WHEN o.listing_id IS NOT NULL THEN o.cents ELSE l.cents END AS cents,
  CASE WHEN o.listing_id IS NOT NULL THEN o.is_available ELSE l.is_available END AS is_available, CASE WHEN o.listing_id IS NOT NULL THEN o.seen ELSE l.seen END AS seen
  FROM listing l JOIN store s USING (store_id) LEFT JOIN override o ON o.listing_id = l.id WHERE NOT coalesce(o.is_deleted, false))""",
    "keyed": """keyed AS (SELECT *, CASE WHEN regexp_replace(upper(regexp_replace(coalesce(sku, ''), '[^0-9A-Za-z]+', '', 'g')), 'KEMP$', '') = '' THEN CAST(id AS VARCHAR)
  ELSE regexp_replace(upper(regexp_replace(coalesce(sku, ''), '[^0-9A-Za-z]+', '', 'g')), 'KEMP$', '') END AS group_key FROM cat)""",
    "ranked": """ranked AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY (cents IS NULL OR cents <= 0), cents ASC NULLS LAST, id) AS rn, count(*) OVER (PARTITION BY group_key) AS group_size FROM keyed)""",
    "offer": f"""offer AS (SELECT l_partkey AS query_id, CASE l_returnflag WHEN 'A' THEN 'prom' WHEN 'N' THEN 'avtopro' ELSE 'google' END AS source,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS source_ord, l_orderkey * 10000000000 + l_suppkey * 10000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS offer_ord, {pick_sql(TITLES, 'l_orderkey')} AS title,
  CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS cents, CASE l_suppkey % 10 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'UAH' END AS currency, l_suppkey AS seller,
  'https://shop' || l_suppkey || CASE l_suppkey % 4 WHEN 0 THEN '.com' WHEN 1 THEN '.kemp.ua' ELSE '.ua' END || '/p' || l_orderkey AS url,
  CASE l_linestatus WHEN 'F' THEN 'Немає в наявності' ELSE 'В наявності' END AS availability,
  CASE l_linenumber WHEN 1 THEN 95 WHEN 2 THEN 90 WHEN 3 THEN 75 WHEN 4 THEN 70 WHEN 5 THEN 55 ELSE 50 END AS conf, l_linenumber >= 3 AS is_analog,
  CASE WHEN l_suppkey % 3 = 0 THEN 'https://img/' || l_suppkey END AS image_url, CASE WHEN l_linenumber % 2 = 0 THEN 'new' END AS condition FROM lineitem)""",
    "fine": "fine AS (SELECT * REPLACE (query_id * 10 + source_ord * 2 + CASE WHEN availability = 'В наявності' THEN 1 ELSE 0 END AS query_id) FROM offer)",
    "observation": """observation AS (SELECT user_id AS listing_id, event_id AS seq, CAST(round(value) AS BIGINT) AS price_cents, 'UAH' AS currency,
  CASE WHEN event_type = 'error' THEN NULL ELSE event_type IN ('purchase', 'view') END AS is_available, ts AS observed_at FROM events)""",
}


def with_(*names: str, extra: str = "") -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + (", " + extra if extra else "") + " "
