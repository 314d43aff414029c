"""Offer and market queries over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money, text, vocab
from ..operators import audit, jobs, market, matching, models, offers
from . import testbed as t
from .testbed import with_

QUERIES: dict = {}
SQL: dict[str, str] = {}

def _price():
    return money.cents(F.col("price")).alias("price_cents")


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _even(a: str, b: int) -> str:
    """a / b for whole numbers, a half to the even side."""
    return f"(({a}) // {b} + CASE WHEN 2 * (({a}) % {b}) > {b} OR (2 * (({a}) % {b}) = {b} AND (({a}) // {b}) % 2 = 1) THEN 1 ELSE 0 END)"


def _on(sql: str, source: str) -> str:
    return sql.replace("@src", source)


def _median(xs: str) -> str:
    n = f"len({xs})"
    return f"(CASE WHEN {n} > 0 THEN {_even(f'{xs}[({n} + 1) // 2] + {xs}[{n} // 2 + 1]', 2)} END)"


def _stats_sql(source: str, keys: str) -> str:
    return f"""lists AS (SELECT {keys}, count(*) AS offers_total, count(DISTINCT source) AS sources_total, list_sort(coalesce(list(cents) FILTER (conf >= 70), CAST([] AS BIGINT[]))) AS p FROM {source} GROUP BY {keys})
SELECT {keys}, offers_total, sources_total, CAST(len(p) AS BIGINT) AS strong_total, p[1] AS min_cents, {_median('p')} AS median_cents, p[len(p)] AS max_cents, len(p) < 3 AS thin_market, CASE WHEN len(p) >= 3 THEN greatest({_even('p[1] * 94', 10000)}, 1) END AS recommended FROM lists"""


def _shown(stats, *keys):
    c = lambda n: money.cents(F.col(f"{n}_price")).alias(f"{n}_cents")
    return stats.select(*keys, "offers_total", "sources_total", "strong_total", c("min"), c("median"), c("max"), "thin_market", F.col("recommended_price").cast("long").alias("recommended"))


@query(with_("offer") + ", " + _stats_sql("offer", "query_id"))
def market_stats(spark, d):
    return _shown(market.stats(t.offers(spark, d), "query_id"), "query_id")


@query(with_("offer") + ", " + _stats_sql("offer", "query_id, source"))
def market_stats_by_source(spark, d):
    return _shown(market.stats(t.offers(spark, d), "query_id", "source"), "query_id", "source")


@query(with_("offer", "fine") + ", " + _stats_sql("fine", "query_id"))
def thin_market(spark, d):
    return _shown(market.stats(t.fine_offers(spark, d), "query_id"), "query_id")


@query(
    with_("offer", "fine")
    + f""", lists AS (SELECT query_id, list_sort(list(cents)) AS al, list_sort(coalesce(list(cents) FILTER (conf >= 70), CAST([] AS BIGINT[]))) AS st FROM fine GROUP BY query_id), u AS (SELECT query_id, CAST(len(st) AS BIGINT) AS strong_total, CASE WHEN len(st) >= 3 THEN st ELSE al END AS p FROM lists)
SELECT query_id, strong_total, p[1] AS min_cents, {_median('p')} AS median_cents, p[len(p)] AS max_cents, greatest({_even('p[1] * 94', 10000)}, 1) AS recommended FROM u"""
)
def legacy_stats(spark, d):
    s = market.legacy_stats(t.fine_offers(spark, d), "query_id")
    c = lambda n: money.cents(F.col(f"{n}_price")).alias(f"{n}_cents")
    return s.select("query_id", "strong_total", c("min"), c("median"), c("max"), F.col("recommended_price").cast("long").alias("recommended"))


_KEY = "query_id, source, offer_ord"


@query(with_("offer") + f"SELECT {_KEY}, cents AS price_cents FROM (SELECT *, row_number() OVER (PARTITION BY query_id, seller ORDER BY cents, source_ord, offer_ord) AS rn FROM offer) WHERE rn = 1")
def cheapest_per_seller(spark, d):
    return offers.cheapest_per(t.offers(spark, d), "query_id", "seller").select("query_id", "source", "offer_ord", _price())


@query(with_("offer") + f"SELECT {_KEY}, cents AS price_cents FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY conf DESC, cents, offer_ord) AS rn FROM offer) WHERE rn <= 3")
def topk_per_source(spark, d):
    return offers.top_per_source(t.offers(spark, d), 3).select("query_id", "source", "offer_ord", _price())


@query(with_("offer") + f"SELECT {_KEY}, cents AS price_cents, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cents, source_ord, offer_ord) AS rn FROM offer) WHERE rn <= 4")
def client_ladder(spark, d):
    return jobs.cheapest_first(t.offers(spark, d)).select("query_id", "source", "offer_ord", _price(), "rank")


_UAH = f"uah AS (SELECT * REPLACE (CASE currency WHEN 'USD' THEN {_even('cents * 415', 10)} WHEN 'EUR' THEN {_even('cents * 4525', 100)} ELSE cents END AS cents, 'UAH' AS currency) FROM @src)"


@query(with_("offer", extra=_on(_UAH, "offer")) + f"SELECT {_KEY}, cents AS price_cents, currency FROM uah")
def fx_convert(spark, d):
    return offers.to_uah(t.offers(spark, d), t.rates(spark)).select("query_id", "source", "offer_ord", _price(), "currency")


_MAIN = """counts AS (SELECT query_id, currency, count(*) AS n, min(source_ord * 10000000000000000 + offer_ord) AS seen FROM @src GROUP BY query_id, currency),
main AS (SELECT query_id, currency AS main FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY currency <> 'UAH', n DESC, seen) AS rn FROM counts) WHERE rn = 1)"""


_MIXED = "mixed AS (SELECT * REPLACE (CASE WHEN query_id % 3 = 0 AND currency = 'UAH' THEN CASE WHEN seller % 4 < 2 THEN 'PLN' ELSE 'GBP' END ELSE currency END AS currency) FROM fine)"


@query(with_("offer", "fine", extra=_MIXED + ", " + _on(_MAIN, "mixed")) + f"SELECT {_KEY}, currency FROM mixed JOIN main USING (query_id) WHERE currency = main")
def single_currency(spark, d):
    """A third of the queries has no hryvnia at all."""
    other = F.when(F.col("seller") % 4 < 2, "PLN").otherwise("GBP")
    o = t.fine_offers(spark, d).withColumn("currency", F.when((F.col("query_id") % 3 == 0) & (F.col("currency") == "UAH"), other).otherwise(F.col("currency")))
    return offers.single_currency(o).select("query_id", "source", "offer_ord", "currency")


_ANCHOR = "anchor_@name AS (SELECT query_id, count(*) AS n, list_sort(coalesce(list(cents) FILTER (conf >= 70), CAST([] AS BIGINT[]))) AS p FROM @src GROUP BY query_id), med_@name AS (SELECT query_id, n, len(p) AS strong, " + _median("p") + " AS anchor FROM anchor_@name)"


def _anchor(name: str, source: str) -> str:
    return _on(_ANCHOR, source).replace("@name", name)


_PLAUSIBLE = _anchor("pl", "spread") + ", plausible AS (SELECT s.* FROM spread s JOIN med_pl USING (query_id) WHERE cents > 0 AND (n < 4 OR anchor IS NULL OR (cents * 8 >= anchor AND cents <= anchor * 8)))"
_SPREAD = "spread AS (SELECT * REPLACE (CASE WHEN offer_ord % 11 = 0 THEN cents * 100 WHEN offer_ord % 13 = 0 THEN cents // 50 ELSE cents END AS cents) FROM fine)"


def _spread(spark, d):
    c = F.col("price")
    return t.fine_offers(spark, d).withColumn("price", F.when(F.col("offer_ord") % 11 == 0, c * 100).when(F.col("offer_ord") % 13 == 0, F.floor(c * 2).cast("decimal(14,0)") / 100).otherwise(c).cast("decimal(14,2)"))


@query(with_("offer", "fine", extra=f"{_SPREAD}, {_PLAUSIBLE}") + f"SELECT {_KEY}, cents AS price_cents FROM plausible")
def drop_implausible(spark, d):
    return offers.drop_implausible(_spread(spark, d)).select("query_id", "source", "offer_ord", _price())


_GATED = "gated AS (SELECT * REPLACE (CASE WHEN availability = 'Немає в наявності' THEN least(conf, 50) ELSE conf END AS conf) FROM @src)"


@query(with_("offer", extra=_on(_GATED, "offer")) + f"SELECT {_KEY}, CAST(conf AS DOUBLE) / 100 AS confidence FROM gated")
def availability_gate(spark, d):
    return offers.availability_gate(t.offers(spark, d)).select("query_id", "source", "offer_ord", "confidence")


_PICKED = (
    _anchor("vp", "spread")
    + """, picked AS (SELECT * FROM (SELECT s.*, anchor, row_number() OVER (PARTITION BY query_id ORDER BY cents, source_ord, offer_ord) - 1 AS position FROM spread s JOIN med_vp USING (query_id) WHERE strong >= 3 AND (conf >= 70 OR cents * 5 < anchor * 2)) WHERE position < 40)"""
)


@query(with_("offer", "fine", extra=f"{_SPREAD}, {_PICKED}") + f"SELECT {_KEY}, CAST(position AS INT) AS position, anchor AS anchor_cents FROM picked")
def verify_pick(spark, d):
    return offers.verify_pick(_spread(spark, d)).select("query_id", "source", "offer_ord", "position", money.cents(F.col("anchor")).alias("anchor_cents"))


@query(
    with_("offer", "fine", extra=f"{_SPREAD}, {_PICKED}")
    + f"SELECT s.query_id, s.source, s.offer_ord, CAST(CASE WHEN p.position IS NOT NULL AND p.position % 3 <> 0 AND p.cents * 5 < p.anchor * 2 THEN least(s.conf, 50) ELSE s.conf END AS DOUBLE) / 100 AS confidence FROM spread s LEFT JOIN picked p USING ({_KEY}) WHERE p.position IS NULL OR p.position % 3 <> 1"
)
def verify_apply(spark, d):
    o = _spread(spark, d)
    said = offers.verify_pick(o).where("position % 3 <> 2").select("query_id", "position", F.when(F.col("position") % 3 == 0, "ok").otherwise("drop").alias("verdict"))
    return offers.verify_apply(o, said).select("query_id", "source", "offer_ord", "confidence")


_PHOTO = (
    _anchor("ph", "spread")
    + """, photo AS (SELECT s.*, anchor, conf >= 70 AND condition IS NULL AS eligible FROM spread s JOIN med_ph USING (query_id) WHERE strong >= 3 AND image_url IS NOT NULL),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, eligible ORDER BY cents, source_ord, offer_ord) AS rn FROM photo) WHERE (eligible AND rn <= 3) OR cents * 5 < anchor * 2),
firsts AS (SELECT *, first_value(cents) OVER f AS c1, first_value(source_ord) OVER f AS c2, first_value(offer_ord) OVER f AS c3 FROM chosen WINDOW f AS (PARTITION BY query_id, url ORDER BY cents, source_ord, offer_ord)),
shot AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY c1, c2, c3) AS place FROM firsts) WHERE place <= 4)"""
)


@query(with_("offer", "fine", extra=f"{_SPREAD}, {_PHOTO}") + f"SELECT {_KEY}, url FROM shot")
def photo_pick(spark, d):
    return offers.photo_pick(_spread(spark, d)).select("query_id", "source", "offer_ord", "url")


@query(
    with_("offer", "fine", extra=f"{_SPREAD}, {_PHOTO}")
    + f"""SELECT s.query_id, s.source, s.offer_ord, CASE WHEN p.seller % 2 = 0 THEN 'used' ELSE s.condition END AS condition, CAST(CASE WHEN p.seller % 2 = 0 OR (p.seller IS NOT NULL AND p.cents * 5 < p.anchor * 2) THEN least(s.conf, 50) ELSE s.conf END AS DOUBLE) / 100 AS confidence
FROM spread s LEFT JOIN shot p USING ({_KEY}) WHERE p.seller IS NULL OR p.seller % 2 <> 0 OR NOT p.cents * 5 < p.anchor * 2"""
)
def photo_apply(spark, d):
    o = _spread(spark, d)
    said = o.select("url", F.when(F.col("seller") % 2 == 0, "used").otherwise("unsure").alias("verdict")).distinct()
    return offers.photo_apply(o, said).select("query_id", "source", "offer_ord", "condition", "confidence")


@query(
    with_("offer", extra=f"{_on(_UAH, 'offer')}, {_on(_MAIN, 'uah')}, one AS (SELECT uah.* FROM uah JOIN main USING (query_id) WHERE currency = main), spread AS (SELECT * FROM one), {_PLAUSIBLE}, {_on(_GATED, 'plausible')}")
    + ", " + _stats_sql("gated", "query_id")
)
def full_report(spark, d):
    return _shown(market.stats(offers.collect(t.offers(spark, d), t.rates(spark)), "query_id"), "query_id")


@query(with_("offer") + f"SELECT {_KEY} FROM offer WHERE seller % 5 <> 0")
def own_seller_anti(spark, d):
    owned = t.table(spark, d, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("seller"))
    return offers.drop_own_sellers(t.offers(spark, d), owned).select("query_id", "source", "offer_ord")


_EXCLUDED = """excl AS (SELECT s_suppkey % 3 AS w, CASE WHEN s_suppkey % 5 = 0 THEN CAST(s_suppkey AS VARCHAR) END AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'shop_' || s_suppkey END AS slug FROM supplier WHERE s_suppkey % 2 = 0),
ids AS (SELECT w, id AS v FROM excl WHERE id IS NOT NULL UNION SELECT w, '4' FROM range(3) g(w)), slugs AS (SELECT w, slug AS v FROM excl WHERE slug IS NOT NULL UNION SELECT w, 'shop_9' FROM range(3) g(w))"""


def _owners(spark, d):
    k = F.col("s_suppkey")
    entered = t.table(spark, d, "supplier").select(
        (k % 3).alias("workspace"), F.when(k % 2 == 0, "Prom").otherwise("exist").alias("marketplace"), F.when(k % 5 == 0, F.concat(F.lit(" "), k.cast("string"))).otherwise(F.lit(" ")).alias("external_id"),
        F.when(k % 7 == 0, F.concat(F.lit("SHOP_"), k.cast("string"))).alias("slug"),
    )
    return offers.owner_identity(spark.range(3).withColumnRenamed("id", "workspace"), entered, own=(("4", "shop_9"),))


@query("WITH " + _EXCLUDED + " SELECT w AS workspace, (SELECT string_agg(v, ',' ORDER BY v) FROM ids WHERE ids.w = g.w) AS seller_ids, (SELECT string_agg(v, ',' ORDER BY v) FROM slugs WHERE slugs.w = g.w) AS seller_slugs FROM range(3) g(w)")
def owner_identity(spark, d):
    return _owners(spark, d).select("workspace", F.array_join("seller_ids", ",").alias("seller_ids"), F.array_join("seller_slugs", ",").alias("seller_slugs"))


@query(
    with_("offer", extra=_EXCLUDED)
    + """, x AS (SELECT query_id, source, offer_ord, query_id % 3 AS w, seller, offer_ord // 10000000000 % 50 AS product FROM offer)
SELECT query_id, source, offer_ord FROM x WHERE NOT (seller % 3 = 0 AND EXISTS (SELECT 1 FROM ids WHERE ids.w = x.w AND v = CAST(seller AS VARCHAR))) AND NOT (seller % 3 = 1 AND EXISTS (SELECT 1 FROM slugs WHERE slugs.w = x.w AND v = 'shop_' || seller))
AND NOT (seller % 4 = 0 AND EXISTS (SELECT 1 FROM ids WHERE ids.w = x.w AND v = CAST(seller AS VARCHAR))) AND product <> query_id % 50"""
)
def own_product_anti(spark, d):
    """Every clause by which an offer may be one's own."""
    s, product = F.col("seller"), F.expr("offer_ord DIV 10000000000 % 50").cast("string")
    made = t.offers(spark, d).select(
        "query_id", "source", "offer_ord", (F.col("query_id") % 3).alias("workspace"), F.when(s % 3 == 0, s.cast("string")).alias("seller_id"), F.when(s % 3 == 1, F.concat(F.lit(" Shop_"), s.cast("string"))).alias("seller_slug"),
        F.when(s % 4 == 0, F.concat(F.lit("https://my_shop-cs"), s.cast("string"), F.lit(".prom.ua/ua/p"), product, F.lit("-a.html"))).otherwise(F.concat(F.lit("https://prom.ua/p"), product, F.lit("-b.html"))).alias("url"),
        F.concat(F.lit("https://prom.ua/ua/p"), (F.col("query_id") % 50).cast("string"), F.lit("-c.html")).alias("source_url"),
    )
    return offers.drop_own_products(made, _owners(spark, d)).select("query_id", "source", "offer_ord")


@query(with_("offer") + f"SELECT {_KEY} FROM offer WHERE seller % 4 NOT IN (0, 1)")
def domain_suffix_filter(spark, d):
    return offers.drop_own_domains(t.offers(spark, d)).select("query_id", "source", "offer_ord")


from .catalog_queries import _matches  # noqa: E402


@query(with_("offer") + f"SELECT {_KEY} FROM offer WHERE NOT ({_matches('title', vocab.USED)} OR {_matches('availability', vocab.USED)} OR {_matches('title', vocab.ON_REQUEST)} OR {_matches('availability', vocab.ON_REQUEST_STOCK)})")
def drop_junk(spark, d):
    return offers.drop_junk(t.offers(spark, d)).select("query_id", "source", "offer_ord")


@query(
    with_("offer")
    + f"""SELECT {_KEY}, is_analog AND offer_ord % 4 <> 1 OR offer_ord % 4 = 2 AS is_analog, CASE offer_ord % 4 WHEN 1 THEN greatest(CAST(conf AS DOUBLE) / 100, 0.95) WHEN 2 THEN 0.75 ELSE CAST(conf AS DOUBLE) / 100 END AS confidence FROM offer WHERE offer_ord % 4 <> 0"""
)
def refine_verdicts(spark, d):
    o = t.offers(spark, d)
    m = F.col("offer_ord") % 4
    said = o.where(m != 3).select("query_id", "source", "offer_ord", F.when(m == 0, "no").when(m == 1, "same").otherwise("analog").alias("verdict"))
    return offers.refine(o, said).select("query_id", "source", "offer_ord", "is_analog", "confidence")


@query(with_("offer") + "SELECT query_id, lower(title) AS title, cents AS price_cents, count(DISTINCT source) AS sources, count(*) AS offers FROM (SELECT * REPLACE (cents // 100000 * 100000 AS cents) FROM offer) GROUP BY query_id, title, cents HAVING count(DISTINCT source) > 1")
def cross_source_dupes(spark, d):
    o = t.offers(spark, d).withColumn("price", (F.floor(F.col("price") / 1000) * 1000).cast("decimal(14,2)"))
    return offers.cross_source_duplicates(o).select("query_id", "title", _price(), "sources", "offers")


_PRICED = with_("listing", "offer") + ", " + "st AS (SELECT query_id, list_sort(list(cents) FILTER (conf >= 70)) AS p FROM offer GROUP BY query_id), m AS (SELECT query_id, p[1] AS lo, " + _median("p") + " AS med, p[len(p)] AS hi FROM st), mine AS (SELECT id, cents, lo, med, hi FROM listing JOIN m ON m.query_id = id WHERE lo IS NOT NULL)"


def _mine(spark, d):
    s = market.stats(t.offers(spark, d), "query_id").where("min_price IS NOT NULL")
    return t.listings(spark, d).join(s, F.col("id") == F.col("query_id"))


@query(_PRICED + " SELECT id, CASE WHEN cents * 100 <= lo * 101 THEN 'best' WHEN cents <= med THEN 'optimal' WHEN cents * 100 > med * 115 THEN 'expensive' ELSE 'above' END AS band FROM mine")
def position_band(spark, d):
    return _mine(spark, d).select("id", market.position_band(F.col("price"), F.col("min_price"), F.col("median_price")).alias("band"))


@query(_PRICED + " SELECT id, CASE WHEN hi > lo THEN round(least(greatest(CAST(cents - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE), 0), 1), 6) END AS place FROM mine")
def spectrum(spark, d):
    return _mine(spark, d).select("id", F.round(market.spectrum(F.col("price"), F.col("min_price"), F.col("max_price")), 6).alias("place"))


@query(with_("listing") + f"SELECT id, CAST(x.d AS INT) AS discount, {_even('cents * (100 - x.d)', 100)} AS price_cents FROM listing, (SELECT unnest(range(31)) AS d) x")
def price_simulation(spark, d):
    return market.simulate(t.listings(spark, d)).select("id", "discount", money.cents(F.col("simulated")).alias("price_cents"))


@query(with_("listing") + ", codes AS (SELECT id, upper(regexp_replace(brand, '[^0-9A-Za-z]', '', 'g')) || id AS code FROM listing WHERE id % 20 = 0), texts AS (SELECT id AS offer_id, upper(regexp_replace(brand || name, '[^0-9A-Za-z]', '', 'g')) || id AS flat FROM listing) SELECT c.id AS query_id, offer_id, code FROM codes c JOIN texts x ON contains(flat, code) WHERE length(code) >= 6")
def code_inside_title(spark, d):
    lists = t.listings(spark, d)
    code = F.concat(text.norm_code(F.col("brand")), F.col("id").cast("string"))
    q = lists.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.array(code).alias("oem_numbers"))
    titles = lists.select(F.col("id").alias("offer_id"), F.expr("concat(regexp_replace(upper(concat(brand, name)), '[^0-9A-Z]', ''), CAST(id AS STRING))").alias("title"))
    return offers.containing_code(q, titles)


_NAMED = "named AS (SELECT min(p_partkey) AS id, lower(p_name || ' ' || p_type || ' ' || replace(p_brand, '#', '') || ' s' || p_size) AS name FROM part GROUP BY 2)"


@query(
    f"""WITH {_NAMED}, w AS (SELECT id, unnest(list_distinct(list_filter(string_split(name, ' '), lambda x: length(x) >= 2))) AS word FROM named), n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
met AS (SELECT a.id AS left_id, b.id AS right_id, count(*) AS i FROM w a JOIN w b ON a.word = b.word AND a.id < b.id GROUP BY ALL),
s AS (SELECT left_id, right_id, round_even(CAST(0.5 AS DOUBLE) * i / (x.n + y.n - i) + CAST(0.5 AS DOUBLE) * i / least(x.n, y.n), 3) AS similarity FROM met JOIN n x ON x.id = left_id JOIN n y ON y.id = right_id)
SELECT left_id, right_id, CAST(similarity AS DOUBLE) AS similarity FROM s WHERE similarity >= 0.7"""
)
def similar_part_names(spark, d):
    """The names of all parts that are alike enough, each two once."""
    name = F.concat_ws(" ", "p_name", "p_type", F.replace("p_brand", F.lit("#"), F.lit("")), F.concat(F.lit("s"), F.col("p_size").cast("string")))
    names = t.table(spark, d, "part").select(F.lower(name).alias("name"), F.col("p_partkey").alias("id")).groupBy("name").agg(F.min("id").alias("id"))
    return matching.similar_pairs(names)


@query(
    with_("listing")
    + ", codes AS (SELECT id, upper(regexp_replace(brand, '[^0-9A-Za-z]', '', 'g')) || id || 'X' || id % 7 AS code FROM listing), texts AS (SELECT id AS offer_id, 'PARTS' || upper(regexp_replace(brand, '[^0-9A-Za-z]', '', 'g')) || id || 'X' || id % 5 || 'NEW' AS flat FROM listing)"
    " SELECT c.id AS query_id, offer_id, code FROM codes c JOIN texts x ON contains(flat, code) WHERE length(code) >= 6"
)
def code_by_rarest_gram(spark, d):
    """All listings' codes, which share their brands' prefixes, among all titles."""
    k = F.col("id").cast("string")
    lists = t.listings(spark, d)
    brand = text.norm_code(F.col("brand"))
    q = lists.select(F.col("id").alias("query_id"), F.array(F.concat(brand, k, F.lit("X"), (F.col("id") % 7).cast("string"))).alias("oem_numbers"))
    titles = lists.select(F.col("id").alias("offer_id"), F.concat(F.lit("Parts "), F.col("brand"), k, F.lit(" x-"), (F.col("id") % 5).cast("string"), F.lit(" new")).alias("title"))
    return matching.containing_code(q, titles)


_VOCAB = " ".join(f"WHEN title = '{x}' THEN {s}" for x, s in (("Фара ліва передня BMW", 0.7), ("Радіатор охолодження 77 00 308 222 Kangoo", 0.9)))


@query(f"WITH x AS (SELECT p_partkey, {t.pick_sql(t.TITLES, 'p_partkey')} AS title FROM part) SELECT p_partkey, CAST(CASE {_VOCAB} ELSE 0 END AS DOUBLE) AS score FROM x")
def match_score(spark, d):
    title = t.pick(t.TITLES, F.col("p_partkey"))
    score = text.match_score(F.array(F.lit("7700308222")), F.lit("Фара ліва передня BMW"), F.lit("KEMP"), title)
    return t.table(spark, d, "part").select("p_partkey", score.alias("score"))


@query(
    with_("offer")
    + """, c AS (SELECT query_id, source, row_number() OVER (PARTITION BY query_id, source ORDER BY cents, offer_ord) - 1 AS position FROM offer)
SELECT query_id, source, CAST(position AS INT) AS position, CASE WHEN position % 25 = 0 THEN 'same' WHEN position % 25 = 1 THEN 'analog' ELSE 'no' END AS verdict FROM c WHERE query_id % 5 <> 0"""
)
def model_verdicts(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id", "source").orderBy("price", "offer_ord")
    c = t.offers(spark, d).select("query_id", "source", (F.row_number().over(w) - 1).alias("position"), "title")
    said = models.batches(c).select("query_id", "source", "chunk", F.when(F.col("query_id") % 5 == 0, "not json").otherwise('{"verdicts": [{"index": 0, "verdict": "same"}, {"index": 1, "verdict": "analog"}, {"index": 90, "verdict": "no"}]}').alias("response"))
    return models.verdicts(c, said)


@query(with_("offer") + ", s AS (SELECT query_id, source FROM offer WHERE availability <> 'Немає в наявності' GROUP BY ALL), q AS (SELECT DISTINCT query_id FROM offer) SELECT query_id, src.source, CASE WHEN src.source = 'exist' THEN 'skipped' WHEN s.source IS NULL THEN 'empty' ELSE 'ok' END AS status FROM q CROSS JOIN (VALUES ('prom'), ('avtopro'), ('google'), ('exist')) src(source) LEFT JOIN s USING (query_id, source)")
def source_status(spark, d):
    o = t.offers(spark, d)
    all_ = o.select("query_id").distinct().select("query_id", F.explode(F.array(*map(F.lit, ("prom", "avtopro", "google", "exist")))).alias("source")).withColumn("status", F.when(F.col("source") == "exist", "skipped").otherwise("ok"))
    return offers.status(o.where("availability <> 'Немає в наявності'"), all_).select("query_id", "source", "status")


@query(
    with_("offer", extra=f"plain AS (SELECT * FROM offer), {_on(_GATED, 'offer')}, a AS (SELECT query_id, list_sort(coalesce(list(cents) FILTER (conf >= 70), CAST([] AS BIGINT[]))) AS p FROM plain GROUP BY query_id), b AS (SELECT query_id, list_sort(coalesce(list(cents) FILTER (conf >= 70), CAST([] AS BIGINT[]))) AS p FROM gated GROUP BY query_id)")
    + f", r AS (SELECT a.query_id, CASE WHEN len(a.p) >= 3 THEN greatest({_even('a.p[1] * 94', 10000)}, 1) END AS x, CASE WHEN len(b.p) >= 3 THEN greatest({_even('b.p[1] * 94', 10000)}, 1) END AS y FROM a JOIN b USING (query_id)) SELECT query_id, x AS without_gate, y AS with_gate FROM r WHERE x IS DISTINCT FROM y"
)
def gate_comparison(spark, d):
    o = t.offers(spark, d)
    got = audit.gate_comparison(market.stats(o, "query_id"), market.stats(offers.availability_gate(o), "query_id"))
    return got.select("query_id", F.col("without").cast("long").alias("without_gate"), F.col("with").cast("long").alias("with_gate"))


@query(with_("offer") + "SELECT query_id, source, offer_ord, 'v' || seller % 3 AS verdict FROM offer WHERE seller % 2 = 0")
def photo_keys(spark, d):
    o = t.offers(spark, d)
    cache = o.where("seller % 2 = 0").select(F.concat(F.lit("photo-used:v1:"), F.sha1("url")).alias("key"), F.concat(F.lit("v"), (F.col("seller") % 3).cast("string")).alias("verdict")).distinct()
    return audit.photo_keys(o, cache).select("query_id", "source", "offer_ord", "verdict")


@query(None)
def report_json(spark, d):
    return market.report(t.offers(spark, d)).select("query_id", "offers_total", "report")


@query(None)
def stream_changes(spark, d):
    """Price changes by a streaming run over all events, read to its end."""
    from ..streaming import folders, observations

    path = folders.shared(spark, "stream")
    t.observations(spark, d).write.parquet(f"{path}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
    done = observations.changes(source).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(observations.OUT).parquet(f"{path}/out").select("listing_id", "seq", "price_cents", "is_available")


SQL["stream_changes"] = """SELECT listing_id, seq, price_cents, is_available FROM (SELECT *, lag(price_cents) OVER w AS p, lag(is_available) OVER w AS a, row_number() OVER w AS n FROM (SELECT user_id AS listing_id, event_id AS seq, CAST(round(value) AS BIGINT) AS price_cents,
  CASE WHEN event_type = 'error' THEN NULL ELSE event_type IN ('purchase', 'view') END AS is_available, ts AS observed_at FROM events) WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at, seq))
WHERE n = 1 OR price_cents IS DISTINCT FROM p OR is_available IS DISTINCT FROM a"""


@query(with_("offer", "fine") + ", x AS (SELECT query_id, count(*) AS o, count(*) FILTER (conf >= 70) AS s FROM fine GROUP BY query_id) SELECT s < 3 AS thin_market, count(*) AS reports, CAST(sum(o) AS BIGINT) AS offers, CAST(sum(s) AS BIGINT) AS strong, count(*) FILTER (s >= 3) AS recommended FROM x GROUP BY s < 3")
def report_summary(spark, d):
    return audit.summary(market.stats(t.fine_offers(spark, d), "query_id"))


@query(
    with_("offer", extra=_anchor("sg", "offer"))
    + f""" SELECT query_id, count(*) FILTER (availability = 'Немає в наявності') AS out_of_stock, count(*) FILTER (title LIKE '%омплект%') AS sets, count(*) FILTER ({_matches('title', vocab.USED)}) AS used,
count(*) FILTER (is_analog AND strong >= 3 AND cents * 2 < anchor) AS low_analogs, count(image_url) AS with_image FROM offer JOIN med_sg USING (query_id) GROUP BY query_id"""
)
def offer_signals(spark, d):
    return audit.signals(t.offers(spark, d))


@query(with_("offer") + "SELECT query_id, source, offer_ord FROM offer WHERE false")
def gate_acceptance(spark, d):
    """Offers out of stock that still count after the gate: none."""
    o = t.offers(spark, d)
    return audit.demoted(o, offers.availability_gate(o)).select("query_id", "source", "offer_ord")
