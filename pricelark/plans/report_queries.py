"""Queries of whole reports, composed sources and stores, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money, text, vocab
from ..operators import audit, catalog, composed, market, models, offers, stores
from ..sources import pages, rates
from . import market_queries as m
from . import source_queries as s
from . import testbed as t
from .catalog_queries import _matches
from .testbed import with_

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# --- the whole pipeline with all passes ---------------------------------------------------------

_REFINED = "refined AS (SELECT * REPLACE (is_analog AND offer_ord % 4 <> 1 OR offer_ord % 4 = 2 AS is_analog, CASE offer_ord % 4 WHEN 1 THEN greatest(conf, 95) WHEN 2 THEN 75 ELSE conf END AS conf) FROM offer WHERE offer_ord % 4 <> 0)"
_ONE = f"{m._on(m._UAH, 'refined')}, {m._on(m._MAIN, 'uah')}, spread AS (SELECT uah.* FROM uah JOIN main USING (query_id) WHERE currency = main), {m._PLAUSIBLE}, {m._on(m._GATED, 'plausible')}"
_CHECKED = f"""{m._anchor('vf', 'gated')},
asked AS (SELECT * FROM (SELECT g.*, anchor, row_number() OVER (PARTITION BY query_id ORDER BY cents, source_ord, offer_ord) - 1 AS position FROM gated g JOIN med_vf USING (query_id) WHERE strong >= 3 AND (conf >= 70 OR cents * 5 < anchor * 2)) WHERE position < 40),
checked AS (SELECT g.* REPLACE (CASE WHEN p.position % 3 <> 0 AND p.cents * 5 < p.anchor * 2 THEN least(g.conf, 50) ELSE g.conf END AS conf) FROM gated g LEFT JOIN asked p USING (query_id, source, offer_ord) WHERE p.position IS NULL OR p.position % 3 <> 1)"""
_SHOT = m._PHOTO.replace("spread", "checked").replace("_ph", "_pf")
_FINAL = "final AS (SELECT c.* REPLACE (CASE WHEN p.seller % 2 = 0 OR (p.seller IS NOT NULL AND p.cents * 5 < p.anchor * 2) THEN least(c.conf, 50) ELSE c.conf END AS conf) FROM checked c LEFT JOIN shot p USING (query_id, source, offer_ord) WHERE p.seller IS NULL OR p.seller % 2 <> 0 OR NOT p.cents * 5 < p.anchor * 2)"


@query(with_("offer", extra=f"{_REFINED}, {_ONE}, {_CHECKED}, {_SHOT}, {_FINAL}") + ", " + m._stats_sql("final", "query_id"))
def report_all_passes(spark, d):
    """All stages in their order: model verdicts, one currency, outliers, availability, the second pass, photos."""
    o = t.offers(spark, d)
    k = F.col("offer_ord") % 4
    verdicts = o.where(k != 3).select("query_id", "source", "offer_ord", F.when(k == 0, "no").when(k == 1, "same").otherwise("analog").alias("verdict"))
    places = o.select("query_id").distinct().select("query_id", F.explode(F.sequence(F.lit(0), F.lit(vocab.VERIFY_MOST - 1))).alias("position")).where("position % 3 <> 2")
    checked = places.select("query_id", "position", F.when(F.col("position") % 3 == 0, "ok").otherwise("drop").alias("verdict"))
    photos = o.select("url", F.when(F.col("seller") % 2 == 0, "used").otherwise("unsure").alias("verdict")).distinct()
    done = offers.collect(o, t.rates(spark), verdicts, checked, photos)
    return m._shown(market.stats(done, "query_id"), "query_id")


_SAID = f"""CASE {' '.join(f"WHEN lower(trim(stock)) = '{k}' THEN '{v}'" for k, v in vocab.STOCK_CODES.items())} WHEN {_matches('stock', vocab.OUT_OF_STOCK)} THEN 'out_of_stock' WHEN {_matches('stock', vocab.ON_ORDER)} THEN 'on_order' WHEN {_matches('stock', vocab.IN_STOCK)} THEN 'in_stock' END"""
_OWN_STOCK = "CASE seller % 5 WHEN 0 THEN 'out_of_stock' WHEN 1 THEN 'in_stock' END"


@query(
    with_("offer")
    + f""", x AS (SELECT query_id, source, offer_ord, conf, {t.pick_sql(t.STOCKS, 'seller')} AS stock, {_OWN_STOCK} AS own FROM offer), y AS (SELECT *, {_SAID} AS said FROM x)
SELECT query_id, source, offer_ord, CAST(CASE WHEN coalesce(own, said) = 'out_of_stock' THEN least(conf, 50) ELSE conf END AS DOUBLE) / 100 AS confidence,
  CASE WHEN own = 'out_of_stock' AND said IS DISTINCT FROM 'out_of_stock' THEN '{vocab.OUT_OF_STOCK_LABEL}' ELSE stock END AS availability FROM y"""
)
def availability_gate_texts(spark, d):
    """The availability gate over every way in which stock is put, and over sources with a signal of their own."""
    seller = F.col("seller")
    o = t.offers(spark, d).withColumn("availability", t.pick(t.STOCKS, seller)).withColumn("stock", F.when(seller % 5 == 0, "out_of_stock").when(seller % 5 == 1, "in_stock"))
    return offers.availability_gate(o).select("query_id", "source", "offer_ord", "confidence", "availability")


@query(
    with_("offer")
    + """, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cents, source_ord, offer_ord) - 1 AS position FROM offer)
SELECT query_id, CAST(position AS INT) AS position, CASE WHEN position % 12 = 0 THEN 'ok' WHEN position % 12 = 5 THEN 'drop' ELSE 'unsure' END AS verdict FROM p WHERE position < 40 AND (position // 12 + query_id) % 3 <> 0"""
)
def verify_verdicts(spark, d):
    """Answers of the second pass in batches of twelve; a third of the batches fail."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("price", "source_ord", "offer_ord")
    picked = t.offers(spark, d).withColumn("position", F.row_number().over(w) - 1).where(F.col("position") < vocab.VERIFY_MOST)
    good = '{"verdicts": [{"index": 0, "verdict": "ok"}, {"index": 5, "verdict": "drop"}, {"index": 12, "verdict": "drop"}]}'
    said = models.verify_batches(picked).select("query_id", "chunk", F.when((F.col("chunk") + F.col("query_id")) % 3 == 0, F.lit("no answer")).otherwise(F.lit(good)).alias("response"))
    return models.verify_verdicts(picked, said)


@query(
    with_("offer")
    + """, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cents, source_ord, offer_ord) - 1 AS position FROM offer),
lines AS (SELECT query_id, position // 12 AS chunk, string_agg((position % 12) || '. ' || title || chr(10) || '   ціна: ' || cents // 100 || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || chr(10) || '   продавець: ' || seller || chr(10) || '   наявність: ' || availability || chr(10) || '   стан: ' || coalesce(condition, 'невідомо'), chr(10) ORDER BY position) AS l FROM p WHERE position < 40 GROUP BY ALL)
SELECT query_id, CAST(chunk AS INT) AS chunk, md5('Наша деталь: ' || p_name || chr(10) || 'Виробник: ' || p_brand || chr(10) || 'Каталожні номери: K' || query_id || chr(10) || 'Ринок' || chr(10) || chr(10) || 'Кандидати:' || chr(10) || l) AS prompt FROM lines JOIN part ON p_partkey = query_id"""
)
def verify_prompts(spark, d):
    """The prompts of the second pass, by their digest."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("price", "source_ord", "offer_ord")
    picked = t.offers(spark, d).withColumn("position", F.row_number().over(w) - 1).where(F.col("position") < vocab.VERIFY_MOST)
    asked = models.verify_batches(picked).join(t.table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), "p_name", "p_brand"), "query_id")
    shown = models.verify_prompt(F.col("p_name"), F.col("p_brand"), F.array(F.concat(F.lit("K"), F.col("query_id").cast("string"))), F.lit("Ринок"), F.col("candidates"))
    return asked.select("query_id", "chunk", F.md5(shown).alias("prompt"))


@query(
    with_("offer")
    + f""", per AS (SELECT query_id, source, min(source_ord) AS so, count(*) AS n, min(cents) FILTER (conf >= 70) AS lo, max(cents) FILTER (conf >= 70) AS hi, list_sort(coalesce(list(cents) FILTER (conf >= 70), CAST([] AS BIGINT[]))) AS p,
  string_agg('{{"price":"' || cents // 100 || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || '","title":"' || title || '","currency":"' || currency || '","seller":' || seller || ',"url":"' || url || '","confidence":' || CASE WHEN conf % 10 = 0 THEN '0.' || conf // 10 ELSE '0.' || conf END || ',"is_analog":' || is_analog || ',"availability":"' || availability || '"}}', ',' ORDER BY cents, offer_ord) AS offers FROM offer GROUP BY query_id, source),
src AS (SELECT query_id, so, n, '{{"source_ord":' || so || ',"source":"' || source || '","offers_total":' || n || CASE WHEN lo IS NULL THEN '' ELSE ',"min_price":"' || lo // 100 || '.' || lpad(CAST(lo % 100 AS VARCHAR), 2, '0') || '","median_price":"' || ({m._median('p')}) // 100 || '.' || lpad(CAST(({m._median('p')}) % 100 AS VARCHAR), 2, '0') || '","max_price":"' || hi // 100 || '.' || lpad(CAST(hi % 100 AS VARCHAR), 2, '0') || '"' END || ',"offers":[' || offers || ']}}' AS j FROM per)
SELECT query_id, CAST(sum(n) AS BIGINT) AS offers_total, md5('{{"sources":[' || string_agg(j, ',' ORDER BY so) || ']}}') AS report FROM src GROUP BY query_id"""
)
def report_digest(spark, d):
    """The JSON report of every query, by its digest."""
    return market.report(t.offers(spark, d)).select("query_id", "offers_total", F.md5("report").alias("report"))


# --- sources ----------------------------------------------------------------------------------------


def _owned_queries(spark, d):
    """Parts as queries of three workspaces; the listing's own seller is told by its raw data or its export host."""
    k = F.col("p_partkey")
    listing = t.table(spark, d, "part").select(
        k.alias("id"), (k % 3).alias("workspace"), F.array(F.concat(F.lit("AB"), k.cast("string"), F.lit("0012"))).alias("oem_numbers"), F.lit(None).cast("string").alias("sku"), F.lit(None).cast("string").alias("brand"), F.col("p_name").alias("name"),
        F.when(k % 2 == 0, F.concat(F.lit("https://my-shop-cs"), (k % 11).cast("string"), F.lit(".prom.ua/p1-a.html"))).otherwise(F.lit("https://prom.ua/p0-none.html")).alias("url"),
        F.when(k % 5 == 0, F.concat(F.lit(" "), ((k + 1) % 11).cast("string"))).alias("seller_id"), F.when(k % 7 == 0, F.concat(F.lit("Shop-"), ((k + 2) % 11).cast("string"))).alias("seller_slug"),
    )
    return catalog.queries_of(listing)


_OWN_SQL = "own AS (SELECT p_partkey AS k, p_partkey % 3 AS w, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 11 END AS host, CASE WHEN p_partkey % 5 = 0 THEN (p_partkey + 1) % 11 END AS raw, CASE WHEN p_partkey % 7 = 0 THEN 'shop-' || (p_partkey + 2) % 11 END AS slug FROM part)"


@query(
    f"""WITH {m._EXCLUDED}, {_OWN_SQL}, i AS (SELECT k, v FROM own JOIN ids USING (w) UNION SELECT k, CAST(host AS VARCHAR) FROM own WHERE host IS NOT NULL UNION SELECT k, CAST(raw AS VARCHAR) FROM own WHERE raw IS NOT NULL),
s AS (SELECT k, v FROM own JOIN slugs USING (w) UNION SELECT k, slug FROM own WHERE slug IS NOT NULL UNION SELECT k, 'my-shop' FROM own WHERE host IS NOT NULL)
SELECT k AS query_id, (SELECT string_agg(v, ',' ORDER BY v) FROM i WHERE i.k = own.k) AS seller_ids, (SELECT string_agg(v, ',' ORDER BY v) FROM s WHERE s.k = own.k) AS seller_slugs FROM own"""
)
def query_owners(spark, d):
    """House, workspace and the listing's own seller, united for each query."""
    got = offers.owner_lists(_owned_queries(spark, d), m._owners(spark, d))
    return offers.each_query(got.select("queries", F.array_join("seller_ids", ",").alias("seller_ids"), F.array_join("seller_slugs", ",").alias("seller_slugs")))


def _found(spark, d):
    """Search pages: each part finds itself and the next parts of its series, 5 on a page, two pages; part 8 of a series gets a broken second page."""
    place = F.col("p_partkey") % s._SERIES
    rows = t.table(spark, d, "part").withColumn("series", F.floor(F.col("p_partkey") / s._SERIES)).withColumn("place", place)
    listed = rows.groupBy("series", F.floor(F.col("place") / s._ON_PAGE).cast("int").alias("page")).agg(F.array_sort(F.collect_list(s._product())).alias("products"))  # 5 products
    html = listed.select("series", "page", F.replace(s._page_html(F.col("products"), F.lit(None).cast("int")), F.lit("CompanyListingQuery"), F.lit("SearchListingQuery")).alias("html"))
    asked = rows.select(F.col("p_partkey").alias("query_id"), "series", F.floor(F.col("place") / s._ON_PAGE).cast("int").alias("own"), F.col("place").alias("p"), F.explode(F.array(F.lit(0), F.lit(1))).alias("page_ord"))
    got = asked.join(html.hint("merge"), (asked["series"] == html["series"]) & (html["page"] == asked["own"] + asked["page_ord"])).select("query_id", F.lit("term").alias("term"), F.lit(0).alias("term_ord"), F.col("page_ord").alias("page"), F.when((F.col("p") == 8) & (F.col("page_ord") == 1), F.lit("<html>")).otherwise(F.col("html")).alias("html"))
    return got


@query(
    f"""WITH {m._EXCLUDED}, {_OWN_SQL},
i AS (SELECT k, v FROM own JOIN ids USING (w) UNION SELECT k, CAST(host AS VARCHAR) FROM own WHERE host IS NOT NULL UNION SELECT k, CAST(raw AS VARCHAR) FROM own WHERE raw IS NOT NULL),
sl AS (SELECT k, v FROM own JOIN slugs USING (w) UNION SELECT k, slug FROM own WHERE slug IS NOT NULL UNION SELECT k, 'my-shop' FROM own WHERE host IS NOT NULL),
p AS (SELECT p_partkey AS k, p_partkey // {s._SERIES} AS series, p_partkey % {s._SERIES} AS place, p_partkey % {s._SERIES} // {s._ON_PAGE} AS page, p_name, p_size FROM part),
met AS (SELECT q.k AS query_id, o.k AS pk, o.p_name, q.p_name AS q_name, CASE WHEN o.k % 6 = 0 AND o.p_size > 0 THEN round_even(o.p_size * 50, 0) WHEN o.p_size > 0 THEN o.p_size * 100 END::BIGINT AS cents, (o.page - q.page) * {s._ON_PAGE} + o.place % {s._ON_PAGE} AS spot FROM p q JOIN p o ON o.series = q.series AND o.page - q.page IN (0, 1) AND NOT (q.place = 8 AND o.page > q.page)),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spot) - 1 AS place,
  len(list_intersect(string_split(p_name, ' '), string_split(q_name, ' '))) AS i, len(list_distinct(list_concat(string_split(p_name, ' '), string_split(q_name, ' ')))) AS u, least(len(string_split(p_name, ' ')), len(string_split(q_name, ' '))) AS mn FROM met),
sim AS (SELECT *, round_even(CAST(0.5 AS DOUBLE) * i / u + CAST(0.5 AS DOUBLE) * i / mn, 3) AS sim FROM n),
scored AS (SELECT *, CASE WHEN sim >= 0.8 THEN 70 WHEN sim >= 0.7 THEN 55 ELSE 0 END AS conf FROM sim WHERE cents IS NOT NULL AND pk <> 0),
fine AS (SELECT * FROM scored x WHERE conf > 0 AND NOT EXISTS (SELECT 1 FROM i WHERE i.k = x.query_id AND v = CAST(pk % 11 AS VARCHAR)) AND NOT EXISTS (SELECT 1 FROM sl WHERE sl.k = x.query_id AND v = 'shop-' || pk % 11)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pk % 11 ORDER BY cents, place) AS rn FROM fine) WHERE rn = 1)
SELECT query_id, place AS offer_ord, 'Shop ' || pk % 11 AS seller, cents AS price_cents, CAST(conf AS DOUBLE) / 100 AS confidence, CASE WHEN pk % 4 = 0 THEN 'out_of_stock' END AS stock FROM one"""
)
def market_source(spark, d):
    """The marketplace's search, from result pages to offers: names, own shops, effective prices, the cheapest of each seller."""
    got = composed.market_source(_owned_queries(spark, d), _found(spark, d), m._owners(spark, d))
    return got.select("query_id", "offer_ord", "seller", money.cents(F.col("price")).alias("price_cents"), "confidence", "stock")


def _web(spark, d):
    """(queries, results, fetched pages) of a web search: each part finds eight places, which state prices in four ways."""
    k, n = F.col("k"), F.col("n")
    part = t.table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_size")
    queries = part.select(k.alias("query_id"), F.array(F.concat(F.lit("WEB"), k.cast("string"), F.lit("7777"))).alias("oem_numbers"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("brand"), F.concat(F.lit("https://own"), (k % 4).cast("string"), F.lit(".ua/x")).alias("source_url"))
    each = part.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(7))))
    host = F.when(n == 5, F.lit("prom.ua")).when(n == 6, F.lit("shop.com")).when(n == 7, F.concat(F.lit("www.own"), (k % 5).cast("string"), F.lit(".ua"))).otherwise(F.concat(F.lit("shop"), n.cast("string"), F.lit(".ua")))
    link = F.concat(F.lit("https://"), host, F.lit("/"), k.cast("string"), F.lit("-"), n.cast("string"))
    title = F.concat(F.lit("Деталь web "), k.cast("string"), F.lit("7777"))
    results = each.select(k.alias("query_id"), n.alias("ord"), title.alias("title"), link.alias("link"), F.when(n == 4, F.concat(F.lit("Купити за "), (F.col("p_size") + 100).cast("string"), F.lit(" грн"))).otherwise(F.lit("немає")).alias("snippet"))
    price = (F.col("p_size") * 10 + n + 1).cast("string")
    ld = F.concat(F.lit('<script TYPE="application/ld+json; charset=utf-8">{"@graph": [{"@type": "Organization", "logo": "https://logo"}, {"@type": "Product", "image": [{"url": "https://img/'), k.cast("string"), F.lit('"}], "offers": {"@type": "AggregateOffer", "lowPrice": "'), price, F.lit('", "priceCurrency": "usd", "availability": "http://schema.org/OutOfStock/"}}]}</script>'))
    micro = F.concat(F.lit('<div><span class="a" itemprop="price">'), price, F.lit(",50 грн</span></div>"))
    og = F.concat(F.lit('<meta content="'), price, F.lit('" property="og:price:amount">'))
    fetched = each.where("n < 4").select(link.alias("url"), F.when(n == 0, ld).when(n == 1, micro).when(n == 2, og).otherwise(F.lit("<html>nothing</html>")).alias("html"))
    return queries, results, fetched


@query(
    """WITH x AS (SELECT p_partkey AS k, p_size, n FROM part, range(8) r(n))
SELECT k AS query_id, n AS offer_ord, CASE n WHEN 4 THEN (p_size + 100) * 100 WHEN 1 THEN (p_size * 10 + 2) * 100 + 50 WHEN 7 THEN NULL ELSE (p_size * 10 + n + 1) * 100 END::BIGINT AS price_cents, CASE n WHEN 0 THEN 'USD' ELSE 'UAH' END AS currency,
CASE n WHEN 0 THEN 'https://img/' || k END AS image_url, CASE n WHEN 0 THEN 'out_of_stock' END AS stock FROM x WHERE n IN (0, 1, 2, 4)"""
)
def web_source(spark, d):
    """Web offers: JSON-LD, microdata, a meta tag or the snippet; covered, foreign and own sites go."""
    got = composed.web_source(*_web(spark, d))
    return got.select("query_id", F.col("offer_ord").cast("long").alias("offer_ord"), money.cents(F.col("price")).alias("price_cents"), "currency", "image_url", "stock")


@query("SELECT p_partkey AS query_id, 2::BIGINT AS offer_ord, 'exist' AS source, (p_size * 10 + 3) * 100::BIGINT AS price_cents FROM part")
def site_source(spark, d):
    """A search of one site alone."""
    got = composed.web_source(*_web(spark, d), source="exist", only_domains=("shop2.ua",))
    return got.select("query_id", F.col("offer_ord").cast("long").alias("offer_ord"), "source", money.cents(F.col("price")).alias("price_cents"))


@query("SELECT o_orderkey AS day, 'USD' AS code, CAST(o_orderkey % 50 + 1 AS BIGINT) * 10000 AS rate FROM orders WHERE o_orderkey % 10 <> 3 UNION ALL SELECT o_orderkey, 'EUR', 455000 FROM orders WHERE o_orderkey % 10 <> 3 AND o_orderkey % 4 <> 1")
def bank_rates(spark, d):
    """Rates from the bank's JSON of each day: other currencies, zero rates and broken answers give none; the last entry of a code counts."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit('[{"cc": "usd", "rate": 7}, {"cc": "PLN", "rate": 10.2}, {"cc": "USD", "rate": '), (k % 50 + 1).cast("string"), F.lit('}, {"cc": "EUR", "rate": '), F.when(k % 4 == 1, F.lit("0")).otherwise(F.lit('"45.5"')), F.lit("}]"))
    payload = F.when(k % 10 == 3, F.lit('{"message": "busy"}')).otherwise(body)
    return rates.bank_rates(t.table(spark, d, "orders").select(k.alias("day"), payload.alias("payload"))).select("day", "code", (F.col("rate") * 10000).cast("long").alias("rate"))


# --- catalogue, stores, audits ------------------------------------------------------------------------


@query("SELECT 'manual:' || upper(n) AS query_id, CASE WHEN length(n) >= 4 THEN upper(n) ELSE '' END AS numbers, CASE WHEN k % 3 = 0 THEN p_name ELSE n END AS name, CASE WHEN k % 2 = 0 THEN p_brand END AS brand FROM (SELECT p_partkey AS k, 'zx' || p_partkey AS n, p_name, p_brand FROM part)")
def manual_queries(spark, d):
    k = F.col("p_partkey")
    asked = t.table(spark, d, "part").select(F.lit(1).alias("workspace"), F.concat(F.lit(" zx"), k.cast("string"), F.lit(" ")).alias("oem"), F.when(k % 2 == 0, F.col("p_brand")).otherwise(" ").alias("brand"), F.when(k % 3 == 0, F.col("p_name")).alias("name"))
    return catalog.manual_queries(asked).select("query_id", F.array_join("oem_numbers", ",").alias("numbers"), "name", "brand")


@query(with_("listing", "override", "store", "cat") + "SELECT c.id, c.name, l.name AS source_name, l.cents AS source_cents, c.cents AS price_cents, CASE WHEN c.id % 2 = 0 THEN 'https://i/' || c.id END AS image, 'N' || c.id AS numbers, c.id % 7 = 0 AS is_edited FROM cat c JOIN listing l USING (id)")
def listing_views(spark, d):
    """What is shown of each single listing, with its raw data's image and numbers."""
    k = F.col("id")
    rows = t.listings(spark, d).withColumn("image", F.when(k % 2 == 0, F.concat(F.lit(" https://i/"), k.cast("string"))).otherwise(F.lit("data:x"))).withColumn("oem_numbers", F.array(F.concat(F.lit("N"), k.cast("string"))))
    got = catalog.listing_view(rows, t.overrides(spark, d), t.stores(spark, d))
    return got.select("id", "name", "source_name", money.cents(F.col("source_price")).alias("source_cents"), money.cents(F.col("price")).alias("price_cents"), "image", F.array_join("oem_numbers", ",").alias("numbers"), "is_edited")


@query(with_("listing", "override", "store", "cat") + "SELECT id FROM cat WHERE kind = 'owned'")
def owned_listings(spark, d):
    return catalog.owned(catalog.effective(t.listings(spark, d), t.overrides(spark, d), t.stores(spark, d))).select("id")


def _suppliers(spark, d):
    k = F.col("s_suppkey")
    return t.table(spark, d, "supplier").select(k.alias("store_id"), (k % 4).alias("workspace_id"), F.col("s_name").alias("name"), F.timestamp_seconds((k * 7) % 5).alias("created_at"))


@query("SELECT s_suppkey AS store_id, CAST(row_number() OVER (PARTITION BY s_suppkey % 4 ORDER BY s_suppkey * 7 % 5 DESC, s_suppkey) AS INT) AS place FROM supplier")
def store_list(spark, d):
    """Stores of each workspace, the newest first."""
    return stores.listed(_suppliers(spark, d)).select("store_id", "place")


@query(
    """WITH r AS (SELECT event_id AS run_id, user_id % 4 AS w, event_id % 150 AS store_id, ts, event_type FROM events WHERE event_id % 3 <> 0 AND event_type IN ('click', 'view'))
SELECT run_id, s_name AS store_name, CAST(row_number() OVER (PARTITION BY w ORDER BY ts, run_id) AS INT) AS place FROM r LEFT JOIN supplier ON s_suppkey = store_id"""
)
def active_imports(spark, d):
    """Imports that wait or run, in the order of their queue, with their store if it is still there."""
    e = t.table(spark, d, "events")
    kind = F.col("event_type")
    status = F.when(kind == "click", "queued").when(kind == "view", "running").otherwise("completed")
    runs = e.select(F.col("event_id").alias("run_id"), (F.col("user_id") % 4).alias("workspace_id"), (F.col("event_id") % 150).alias("store_id"), F.col("ts").alias("created_at"), status.alias("status"), F.when(F.col("event_id") % 3 == 0, "refresh").otherwise("catalog_import").alias("kind"))
    return stores.active_imports(runs, _suppliers(spark, d)).select("run_id", "store_name", "place")


@query("SELECT s_suppkey AS store_id, w AS workspace_id FROM supplier LEFT JOIN (SELECT user_id, arg_min(event_id % 7, (ts, event_id % 7)) AS w FROM events WHERE event_type = 'signup' GROUP BY user_id) ON user_id = s_suppkey")
def oldest_links(spark, d):
    links = t.table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("store_id"), (F.col("event_id") % 7).alias("workspace_id"), F.col("ts").alias("created_at"))
    return stores.with_oldest_link(_suppliers(spark, d), links).select("store_id", "workspace_id")


def _exclusions(spark, d):
    k = F.col("s_suppkey")
    return t.table(spark, d, "supplier").where("s_suppkey % 2 = 0").select((k % 3).alias("workspace"), F.lit("prom").alias("marketplace"), k.cast("string").alias("external_id"), F.lit("old").alias("slug"), F.col("s_name").alias("name"), k.alias("store_id"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS external_id, CASE WHEN s_suppkey % 3 = 0 THEN 'strasse-' || s_suppkey ELSE 'old' END AS slug, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey END AS store_id FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def exclusion_upsert(spark, d):
    """Shops entered again get the new slug, folded; those of deleted stores stay without the store."""
    k = F.col("s_suppkey")
    entered = t.table(spark, d, "supplier").where("s_suppkey % 3 = 0").select((k % 3).alias("workspace"), F.lit("prom").alias("marketplace"), k.cast("string").alias("external_id"), F.concat(F.lit(" Straße-"), k.cast("string")).alias("slug"), F.col("s_name").alias("name"), k.alias("store_id"), F.lit(1).alias("ord"))
    gone = t.table(spark, d, "supplier").where("s_suppkey % 5 = 0").select(k.alias("store_id"))
    return stores.without_stores(stores.exclude(_exclusions(spark, d), entered), gone).select("external_id", "slug", "store_id")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS external_id, CASE WHEN s_suppkey % 2 = 0 THEN 'old' ELSE 'new' END AS slug FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 5 IN (1, 3)")
def exclusion_backfill(spark, d):
    """Linked stores that are ours and aren't excluded yet."""
    k = F.col("s_suppkey")
    base = t.table(spark, d, "supplier")
    all_ = base.select(k.alias("store_id"), F.lit("prom").alias("marketplace"), k.cast("string").alias("external_id"), F.lit("NEW").alias("slug"), F.col("s_name").alias("name"))
    links = base.where("s_suppkey % 5 IN (1, 2, 3)").select(k.alias("store_id"), (k % 3).alias("workspace"))
    return stores.backfill_exclusions(_exclusions(spark, d), all_, links, F.col("store_id") % 5 != 2).select("external_id", "slug")


@query(f"WITH x AS (SELECT {t.pick_sql(t.TITLES, 'p_partkey')} || CASE WHEN p_partkey % 9 = 0 THEN ' коробка ПЕРЕДАЧ задня' WHEN p_partkey % 9 = 1 THEN ' 2 шт кпп' WHEN p_partkey % 9 = 2 THEN ' внутрішня маточина' ELSE '' END AS name FROM part) SELECT count(*) FILTER (regexp_matches(lower(name), 'комплект|пара|2[[:space:]]*шт')) AS sets, count(*) FILTER (regexp_matches(lower(name), 'лів|прав|лев|перед|задн|внутр|зовніш|внешн')) AS sides, count(*) FILTER (lower(name) LIKE '%передач%') AS gearbox, count(*) FILTER (lower(name) LIKE '%передач%' AND lower(name) LIKE '%задн%') AS gearbox_rear, count(*) FILTER (lower(name) LIKE '%кпп%') AS gearbox_short, count(*) FILTER (regexp_matches(lower(name), 'маточин|ступиц|кришк|крышк')) AS synonyms, count(*) FILTER (lower(name) LIKE '%внутр%') AS inner_side, count(*) FILTER (regexp_matches(lower(name), 'зовніш|внешн')) AS outer_side FROM x")
def name_pathologies(spark, d):
    k = F.col("p_partkey")
    more = F.when(k % 9 == 0, " коробка ПЕРЕДАЧ задня").when(k % 9 == 1, " 2 шт кпп").when(k % 9 == 2, " внутрішня маточина").otherwise("")
    return audit.name_pathologies(t.table(spark, d, "part").select(F.concat(t.pick(t.TITLES, k), more).alias("name")))


@query("WITH n AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'NODIGIT' WHEN 1 THEN 'Ж' || p_partkey WHEN 2 THEN 'A' || p_partkey ELSE repeat('7', 21) || p_partkey END AS number FROM part) SELECT id, number FROM n WHERE id % 4 <> 2 ORDER BY number, id LIMIT 80")
def odd_number_sample(spark, d):
    """A report to read: the first 80 part numbers that look wrong."""
    k = F.col("p_partkey")
    number = F.when(k % 4 == 0, F.lit("NODIGIT")).when(k % 4 == 1, F.concat(F.lit("Ж"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("A"), k.cast("string"))).otherwise(F.concat(F.repeat(F.lit("7"), 21), k.cast("string")))
    return audit.sample(audit.odd_numbers(t.table(spark, d, "part").select(F.lit("sku").alias("origin"), number.alias("number"), k.alias("id"))), "number", "id", most=80).select("id", "number")


@query(with_("offer") + "SELECT DISTINCT 'photo-used:v1:' || sha1(url) AS key FROM offer WHERE seller % 2 = 0 AND url NOT IN (SELECT url FROM offer WHERE seller % 4 = 0)")
def unmatched_photo_keys(spark, d):
    """Cached verdicts that belong to no offer that is left."""
    o = t.offers(spark, d)
    cache = o.where("seller % 2 = 0").select(F.concat(F.lit("photo-used:v1:"), F.sha1("url")).alias("key")).distinct()
    return audit.unmatched_photo_keys(cache, o.where("seller % 4 = 0"))


@query(
    with_("offer")
    + rf""", x AS (SELECT query_id, source, offer_ord, list_distinct(list_filter(regexp_extract_all(lower(title), '[\pL\pN_]+'), lambda w: length(w) >= 2 AND w <> 'новий' AND w <> 'за')) AS tt, list_distinct(string_split(p_name, ' ')) AS tn FROM offer JOIN part ON p_partkey = query_id WHERE conf >= 90)
SELECT query_id, source, offer_ord, CAST(0 AS DOUBLE) AS similarity FROM x WHERE len(list_intersect(tt, tn)) = 0"""
)
def weak_by_name(spark, d):
    """Offers that count by their number alone: Ukrainian titles and English part names, but for the words both have."""
    asked = t.table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("name"))
    return audit.weak_by_name(t.offers(spark, d), asked).where("similarity = 0")


#: The JSON report itself, by the SQL of its digest.
SQL["report_json"] = SQL["report_digest"].replace("md5('{\"sources\"", "('{\"sources\"")


@query(with_("offer") + "SELECT query_id, source, offer_ord FROM offer WHERE availability = 'Немає в наявності' AND seller % 2 = 1 AND conf >= 70")
def gate_failures(spark, d):
    """Offers out of stock that still count where the gate was left out for half of the sellers."""
    o = t.offers(spark, d)
    after = offers.availability_gate(o.where("seller % 2 = 0")).unionByName(o.where("seller % 2 = 1"))
    return audit.demoted(o, after).select("query_id", "source", "offer_ord")


@query(
    """WITH x AS (SELECT p_partkey AS k, p_partkey % 5 AS m FROM part)
SELECT k, CASE m WHEN 0 THEN 'C' || k || 'ZZ' || ';' || 'M' || k || 'YY' || ';7' || k || '000000' WHEN 1 THEN 'C' || k || 'ZZ' || ';7' || k || '000000' WHEN 2 THEN 'C' || k || 'ZZ' || ';AB' || k || '1212' || ';7' || k || '000000' ELSE 'C' || k || 'ZZ' END AS numbers FROM x"""
)
def file_numbers(spark, d):
    """Part numbers of an export row: its own fields, then those among its search phrases; those with a letter first."""
    k = F.col("p_partkey").cast("string")
    m = F.col("p_partkey") % 5
    seven = F.concat(F.lit("7"), k, F.lit("000000"))
    code, mpn = F.concat(F.lit(" c"), k, F.lit(" zz")), F.when(m == 0, F.concat(F.lit("M"), k, F.lit("YY"))).otherwise(F.lit("AUDI 100"))
    first = F.when(m == 1, seven).otherwise(F.lit("--"))
    phrases = F.when(m == 0, F.concat(F.lit("фара, "), seven, F.lit(", 1.6-1.8"))).when(m == 2, F.concat(seven, F.lit(",ab"), k, F.lit("-1212, "), seven)).otherwise(F.lit("peugeot206, кузов"))
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.array_join(text.file_numbers(code, mpn, first, F.lit(None).cast("string"), phrases), ";").alias("numbers"))


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 < 2 THEN CAST(s_suppkey + 1000 AS VARCHAR) END AS id, CASE WHEN s_suppkey % 4 < 2 THEN 'shop-' || s_suppkey END AS slug, CASE WHEN s_suppkey % 4 = 0 THEN 'ua' END AS lang FROM supplier")
def store_urls(spark, d):
    """The shop that a marketplace address names."""
    from ..functions import urls

    k = F.col("s_suppkey").cast("string")
    tail = F.concat(F.lit("c"), (F.col("s_suppkey") + 1000).cast("string"), F.lit("-shop-"), k)
    url = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("https://prom.ua/ua/"), tail, F.lit(".html?x=1"))).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("https://www.prom.ua/"), tail, F.lit(".html"))).when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("https://other.ua/"), tail, F.lit(".html"))).otherwise(F.concat(F.lit("https://prom.ua/"), tail))
    i, slug, lang = urls.store_seller(url)
    return t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), i.alias("id"), slug.alias("slug"), lang.alias("lang"))


@query("SELECT p_partkey AS k, p_partkey || ',' || (p_size + 1000000) AS groups FROM part")
def page_groups(spark, d):
    """Product groups that a page links, each once."""
    from ..functions import urls

    k, s_ = F.col("p_partkey").cast("string"), (F.col("p_size") + 1_000_000).cast("string")
    html = F.concat(F.lit('<a href="/c1?product_group='), k, F.lit('">a</a><a href="/c1?page=2&amp;product_group='), s_, F.lit('">b</a><a href="?x=1&product_group='), k, F.lit('">c</a>product_group=5'))
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.array_join(urls.group_ids(html), ",").alias("groups"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'new' || p_partkey ELSE 'old' END AS a, 'old' AS b, CASE WHEN p_partkey % 2 = 0 THEN 'more' END AS c FROM part")
def raw_data_merge(spark, d):
    """A listing's raw data overlaid by what an import carries; empty values leave the stored ones."""
    from ..operators import merge

    k = F.col("p_partkey")
    stored = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("old"))
    came = F.create_map(F.lit("a"), F.when(k % 3 == 0, F.concat(F.lit("new"), k.cast("string"))).otherwise(F.lit("")), F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.when(k % 2 == 0, F.lit("more")))
    merged = merge.merge_maps(stored, came)
    return t.table(spark, d, "part").select(k.alias("k"), *[merged[c].alias(c) for c in "abc"])


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 6 <> 5 THEN p_name END AS name, CASE WHEN p_partkey % 6 <> 5 AND p_partkey % 2 = 0 THEN p_size END AS seller_count, CASE WHEN p_partkey % 6 <> 5 AND p_partkey % 2 = 0 THEN p_size * 100 + 50 END::BIGINT AS min_cents, p_partkey % 6 = 5 AS failed FROM part")
def product_page_fields(spark, d):
    """Product pages with and without a buy box, and pages without a product."""
    k = F.col("p_partkey")
    box = F.when(k % 2 == 0, F.struct(F.col("p_size").alias("companyCount"), F.concat(F.col("p_size").cast("string"), F.lit(",5 грн")).alias("minPrice"), F.lit("9 999").alias("maxPrice")))
    card = F.struct(F.struct(F.when(k % 6 != 5, s._product()["product"]).alias("product"), box.alias("buyBox")).alias("result"))
    html = F.concat(F.lit("<script>window.ApolloCacheState = "), F.to_json(F.struct(F.create_map(F.lit("ProductCardPageQuery(1)"), card).alias("_FAST_CACHE"))), F.lit(";</script>"))
    got = pages.product_pages(t.table(spark, d, "part").select(k.cast("string").alias("url"), html.alias("html")))
    keep = F.col("error").isNull()
    return got.select(F.col("page_url").cast("long").alias("k"), "name", F.when(keep, F.col("seller_count")).alias("seller_count"), F.when(keep, money.cents(F.col("min_price"))).alias("min_cents"), F.col("error").isNotNull().alias("failed"))
