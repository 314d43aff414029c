"""Catalogue queries over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money, text, urls
from ..operators import audit, catalog, jobs, merge
from ..operators.catalog import CatalogFilter
from . import testbed as t
from .testbed import with_

QUERIES: dict = {}
SQL: dict[str, str] = {}

def _price():
    return money.cents(F.col("price")).alias("price_cents")
_RANKED = with_("listing", "override", "store", "cat", "keyed", "ranked")


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _catalog(spark, d):
    return catalog.effective(t.listings(spark, d), t.overrides(spark, d), t.stores(spark, d))


def _page(name: str, f: CatalogFilter, order: str, where: str = "true", grouped: bool = True):
    source = "ranked" if grouped else "(SELECT *, 1 AS rn FROM cat)"
    sql = f"{_RANKED} SELECT id, name, cents AS price_cents, {'group_size' if grouped else 'CAST(1 AS BIGINT) AS group_size'} FROM {source} WHERE rn = 1 AND {where} ORDER BY {order}, id LIMIT {f.limit} OFFSET {f.offset}"

    def run(spark, d):
        return catalog.page(_catalog(spark, d), f).select("id", "name", _price(), "group_size")

    run.__name__ = name
    query(sql)(run)


_page("catalog_page", CatalogFilter(), "name ASC NULLS LAST")
_page("catalog_page_second", CatalogFilter(offset=60, limit=40), "name ASC NULLS LAST")
_page("catalog_page_price_asc", CatalogFilter(order="price_asc"), "cents ASC NULLS LAST")
_page("catalog_page_price_desc", CatalogFilter(order="price_desc", limit=100), "cents DESC NULLS LAST")
_page("catalog_page_updated", CatalogFilter(order="updated"), "seen DESC NULLS FIRST")
_page("catalog_store_filter", CatalogFilter(store_ids=[1, 2], limit=100), "name ASC NULLS LAST", "store_id IN (1, 2)", grouped=False)


def _selected(name: str, f: CatalogFilter, where: str):
    def run(spark, d):
        return catalog.select(_catalog(spark, d), f).select("id", "name", _price(), "is_available")

    run.__name__ = name
    query(f"{_RANKED} SELECT id, name, cents AS price_cents, is_available FROM ranked WHERE rn = 1 AND ({where})")(run)


_selected("catalog_search", CatalogFilter(query=" Bolt "), "coalesce(name ILIKE '%Bolt%', false) OR coalesce(sku ILIKE '%Bolt%', false) OR coalesce(brand ILIKE '%Bolt%', false)")
_selected("catalog_available", CatalogFilter(available=True), "is_available IS TRUE")
_selected("catalog_unavailable", CatalogFilter(available=False), "is_available IS FALSE")
_selected("catalog_price_range", CatalogFilter(price_min=920, price_max=1000.5), "cents >= 92000 AND cents <= 100050")
_selected("catalog_source_export", CatalogFilter(source="export"), "url ILIKE '%.prom.ua/%'")
_selected("catalog_source_scrape", CatalogFilter(source="scrape"), "NOT url ILIKE '%.prom.ua/%'")


@query(f"{_RANKED} SELECT count(*) AS total FROM ranked WHERE rn = 1")
def catalog_count(spark, d):
    return catalog.count(_catalog(spark, d))


@query(f"{_RANKED} SELECT id, group_key, CAST(rn AS INT) AS rn, group_size FROM ranked")
def catalog_group_rank(spark, d):
    return catalog.ranked(_catalog(spark, d)).select("id", "group_key", "rn", "group_size")


@query(f"{_RANKED} SELECT id, name, sku, brand, cents AS price_cents, is_available, kind, kind = 'owned' AS can_manage, CASE WHEN regexp_matches(url, '^https://[a-z0-9-]+-cs[0-9]+[.]prom[.]ua/') THEN 'export' ELSE 'scrape' END AS source FROM cat")
def catalog_items(spark, d):
    return catalog.items(_catalog(spark, d)).select("id", "name", "sku", "brand", _price(), "is_available", "kind", "can_manage", "source")


@query(
    with_("listing", "override", "store", "cat", "keyed")
    + "SELECT a.id AS of_id, b.id, coalesce(o.cents, l.cents) AS price_cents, CAST(row_number() OVER (PARTITION BY a.id ORDER BY coalesce(o.cents, l.cents) NULLS LAST, b.id) AS INT) AS place FROM keyed a JOIN keyed b ON a.group_key = b.group_key AND a.id <> b.id JOIN listing l ON l.id = b.id LEFT JOIN override o ON o.listing_id = b.id"
)
def siblings(spark, d):
    lists = t.listings(spark, d)
    """The siblings of every listing, among all listings."""
    return catalog.siblings(lists, t.overrides(spark, d), t.stores(spark, d), lists).select("of_id", "id", _price(), "place")


@query(
    with_("listing", "override", "store")
    + "SELECT s.store_id, count(l.id) AS listings, count(l.id) FILTER (regexp_matches(l.url, '-cs[0-9]+[.]prom[.]ua/')) AS from_file FROM store s LEFT JOIN (SELECT * FROM listing WHERE id NOT IN (SELECT listing_id FROM override WHERE is_deleted)) l USING (store_id) GROUP BY s.store_id"
)
def store_counts(spark, d):
    return catalog.store_counts(t.stores(spark, d), t.listings(spark, d), t.overrides(spark, d))


# --- merges ------------------------------------------------------------------------------


def _stored(spark, d):
    return t.listings(spark, d).where("id % 3 <> 0").withColumn("external_id", F.col("id"))


def _incoming(spark, d):
    k = F.col("id")
    return t.listings(spark, d).where("id % 2 = 0").select(
        "store_id", k.alias("external_id"), F.when(k % 5 != 0, F.concat(F.lit("New "), "name")).otherwise(F.col("name")).alias("name"), "url", F.when(k % 4 != 0, F.col("sku")).otherwise("").alias("sku"), F.lit(None).cast("string").alias("brand"),
        F.when(k % 6 == 0, " usd ").when(k % 6 == 2, "").alias("currency"), F.when(k % 8 != 0, (F.col("price") + (k % 3)).cast("decimal(14,2)")).otherwise(F.lit(0).cast("decimal(14,2)")).alias("price"), F.when(k % 10 != 0, k % 4 == 0).alias("is_available"), k.alias("ord"),
    )


def _now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")

_IN_SQL = """stored AS (SELECT * FROM listing WHERE id % 3 <> 0),
incoming AS (SELECT id, store_id, CASE WHEN id % 5 <> 0 THEN 'New ' || name ELSE name END AS name, CASE WHEN id % 4 <> 0 THEN sku END AS sku,
  CASE WHEN id % 6 = 0 THEN 'USD' ELSE 'UAH' END AS currency, CASE WHEN id % 8 <> 0 THEN cents + 100 * (id % 3) END AS cents, CASE WHEN id % 10 <> 0 THEN id % 4 = 0 END AS is_available FROM listing WHERE id % 2 = 0)"""


@query(
    with_("listing", extra=_IN_SQL)
    + """SELECT coalesce(s.id, i.id) AS external_id, coalesce(i.name, s.name) AS name, coalesce(i.sku, s.sku) AS sku, s.brand, coalesce(i.currency, 'UAH') AS currency,
  coalesce(i.cents, s.cents) AS price_cents, coalesce(i.is_available, s.is_available) AS is_available, i.id IS NOT NULL AS seen_now FROM stored s FULL JOIN incoming i ON s.id = i.id"""
)
def upsert_merge(spark, d):
    out = merge.upsert(_stored(spark, d), _incoming(spark, d), _now())
    return out.select("external_id", "name", "sku", "brand", "currency", _price(), "is_available", (F.col("last_seen_at") == _now()).alias("seen_now"))


@query(
    with_("listing", extra=_IN_SQL)
    + """SELECT i.id AS external_id, i.cents AS price_cents, i.currency, i.is_available FROM incoming i LEFT JOIN stored s ON s.id = i.id
WHERE i.cents IS NOT NULL AND (s.id IS NULL OR i.cents IS DISTINCT FROM s.cents OR i.currency <> 'UAH' OR i.is_available IS DISTINCT FROM s.is_available)"""
)
def import_observations(spark, d):
    return merge.observed(_stored(spark, d), _incoming(spark, d), _now()).select("external_id", _price(), "currency", "is_available")


@query(
    with_("listing", "override")
    + "SELECT coalesce(o.listing_id, l.id) AS listing_id, o.name, coalesce(l.id IS NOT NULL, false) OR coalesce(o.is_deleted, false) AS is_deleted FROM override o FULL JOIN (SELECT id FROM listing WHERE name ILIKE '%bolt%') l ON l.id = o.listing_id"
)
def soft_delete(spark, d):
    return merge.soft_delete(t.overrides(spark, d), t.listings(spark, d).where(F.col("name").ilike("%bolt%"))).select("listing_id", "name", "is_deleted")


@query(
    with_("listing", "override")
    + "SELECT listing_id, name, CASE WHEN listing_id % 2 = 0 THEN false ELSE is_deleted END AS is_deleted FROM override WHERE NOT (listing_id % 2 = 0 AND is_deleted AND name IS NULL AND cents IS NULL AND sku IS NULL AND brand IS NULL)"
)
def undelete(spark, d):
    return merge.undelete(t.overrides(spark, d), t.listings(spark, d).where("id % 2 = 0")).select("listing_id", "name", "is_deleted")


@query(with_("listing", "override") + "SELECT listing_id, name FROM override UNION ALL SELECT id, name FROM listing WHERE id % 5 = 0 AND id NOT IN (SELECT listing_id FROM override)")
def seed_overrides(spark, d):
    return merge.seed_overrides(t.overrides(spark, d), t.listings(spark, d), t.listings(spark, d).where("id % 5 = 0")).select("listing_id", "name")


@query(with_("listing") + "SELECT id, url FROM listing WHERE NOT regexp_matches(url, '-cs[0-9]+[.]prom[.]ua/')")
def delete_file_products(spark, d):
    return merge.delete_exports(t.listings(spark, d))[0].select("id", "url")


@query(
    with_("listing", "override")
    + "SELECT listing_id, CASE WHEN listing_id % 2 = 0 THEN 'Page ' || listing_id ELSE name END AS name, CASE WHEN listing_id % 2 = 0 THEN NULL ELSE sku END AS sku, CASE WHEN listing_id % 2 = 0 THEN false ELSE is_deleted END AS is_deleted FROM override"
)
def mirror_pages(spark, d):
    o = t.overrides(spark, d)
    pages = o.where("listing_id % 2 = 0").select("listing_id", F.concat(F.lit("Page "), F.col("listing_id").cast("string")).alias("name"), F.lit(None).cast("string").alias("sku"), "brand", "price", "is_available")
    return merge.mirror_pages(o, pages, _now()).select("listing_id", "name", "sku", "is_deleted")


@query(with_("listing") + "SELECT id, CASE WHEN id % 3 = 0 THEN 'x' ELSE name END AS name, CASE WHEN id % 5 = 0 THEN NULL ELSE brand END AS brand FROM listing")
def partial_update(spark, d):
    rows = t.listings(spark, d).select("id", "name", "brand")
    patches = rows.select("id", F.lit("x").alias("name"), F.lit(None).cast("string").alias("brand"), (F.col("id") % 3 == 0).alias("set_name"), (F.col("id") % 5 == 0).alias("set_brand"))
    return merge.patch(rows, patches, "id", ["name", "brand"])


@query("SELECT s_suppkey AS store_id, CASE WHEN s_suppkey % 2 = 0 THEN 'url2' ELSE 'url1' END AS canonical_url, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 'new' ELSE s_name END AS name FROM supplier")
def store_upsert(spark, d):
    s = t.table(spark, d, "supplier")
    stored = s.where("s_suppkey % 3 <> 0 OR s_suppkey % 2 <> 0").select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("name"), F.lit("url1").alias("canonical_url"))
    rows = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("store_id"), F.lit("new").alias("name"), F.lit("url2").alias("canonical_url"), F.lit(1).alias("ord"))
    return merge.upsert_by(stored, rows, ["store_id"], ["canonical_url"])


# --- jobs, observations and audits -----------------------------------------------------------


@query(
    with_("observation")
    + """SELECT listing_id, seq, price_cents, is_available FROM (SELECT *, lag(price_cents) OVER w AS p, lag(is_available) OVER w AS a, row_number() OVER w AS n FROM observation WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at, seq))
WHERE n = 1 OR price_cents IS DISTINCT FROM p OR is_available IS DISTINCT FROM a"""
)
def observation_changes(spark, d):
    o = t.observations(spark, d).withColumnRenamed("price_cents", "price")
    return merge.changes(o).select("listing_id", "seq", F.col("price").alias("price_cents"), "is_available")


@query(
    with_("observation")
    + "SELECT seq, CAST(row_number() OVER (PARTITION BY listing_id ORDER BY observed_at, seq) AS INT) AS checks_used, listing_id % 5 = 0 OR row_number() OVER (PARTITION BY listing_id ORDER BY observed_at, seq) <= 30 AS allowed FROM observation"
)
def quota(spark, d):
    o = t.observations(spark, d).select(F.col("listing_id").alias("workspace_id"), F.col("seq").alias("check_id"), F.col("observed_at").alias("at"))
    return jobs.quota(o, o.where("workspace_id % 5 = 0")).select(F.col("check_id").alias("seq"), "checks_used", "allowed")


@query(
    """WITH runs AS (SELECT event_id AS run_id, user_id AS workspace_id, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN CASE WHEN event_id % 50 = 0 THEN 'running' ELSE 'completed' END ELSE 'completed' END AS status FROM events)
SELECT workspace_id, arg_min(run_id, ts) AS run_id FROM runs WHERE status = 'queued' AND run_id % 3 <> 0 AND workspace_id NOT IN (SELECT workspace_id FROM runs WHERE status = 'running') GROUP BY workspace_id"""
)
def queue_head(spark, d):
    e = t.table(spark, d, "events")
    kind = F.col("event_type")
    status = F.when(kind == "signup", "queued").when(kind == "error", "failed").when((kind == "purchase") & (F.col("event_id") % 50 == 0), "running").otherwise("completed")
    runs = e.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("workspace_id"), F.col("ts").alias("created_at"), status.alias("status"), F.when(F.col("event_id") % 3 == 0, F.lit("t")).alias("task_id"))
    return jobs.queue_head(runs)


@query("SELECT user_id AS run_id, CASE WHEN bool_or(event_type = 'error') THEN 'cancelled' ELSE arg_max(event_type, ts) END AS status FROM events GROUP BY user_id")
def run_status(spark, d):
    e = t.table(spark, d, "events")
    log = e.select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "cancelled").otherwise(F.col("event_type")).alias("status"))
    return jobs.final_status(log)


@query(with_("observation") + "SELECT seq, listing_id FROM observation WHERE observed_at > TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 21600 SECONDS")
def report_cache_fresh(spark, d):
    return jobs.fresh(t.observations(spark, d), F.lit("2024-01-02 00:00:00").cast("timestamp")).select("seq", "listing_id")


@query(with_("observation") + "SELECT seq FROM observation WHERE observed_at + CASE WHEN is_available IS NULL THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAY END > TIMESTAMP '2024-01-09 00:00:00'")
def photo_verdicts_fresh(spark, d):
    v = t.observations(spark, d).select("seq", F.col("observed_at").alias("at"), F.when(F.col("is_available").isNull(), "unsure").otherwise("used").alias("verdict"))
    return jobs.fresh_verdicts(v, F.lit("2024-01-09 00:00:00").cast("timestamp")).select("seq")


@query(with_("listing") + "SELECT count(*) AS total, count(*) FILTER (cents IS NULL) AS unpriced, count(*) FILTER (cents <= 0) AS not_positive, count(*) FILTER (NOT is_available) AS unavailable FROM listing")
def snapshot_probe(spark, d):
    return audit.snapshot(t.listings(spark, d))


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def key_histogram(spark, d):
    return audit.key_histogram(t.table(spark, d, "events"), "props")


@query(
    """WITH x AS (SELECT p_partkey AS k, p_partkey % 3 AS n FROM part), p AS (SELECT 'id' AS path, 1 AS n FROM x UNION ALL SELECT unnest(['props', 'props.size', 'props.deep', 'props.deep.more']), 1 FROM x WHERE k % 2 = 0
UNION ALL SELECT 'offers', 1 FROM x UNION ALL SELECT unnest(['offers[].price', 'offers[].tags']), n FROM x UNION ALL SELECT 'offers[].tags[].name', 2 * n FROM x)
SELECT path, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY path HAVING sum(n) > 0"""
)
def key_paths(spark, d):
    """Every key of nested JSON by its path; a seventh of the rows is no JSON beside."""
    k = F.col("p_partkey")
    offer = F.struct(F.lit(1).alias("price"), F.array(F.struct(F.lit("a").alias("name")), F.struct(F.lit("b").alias("name"))).alias("tags"))
    props = F.when(k % 2 == 0, F.struct(F.col("p_size").alias("size"), F.struct(F.lit(True).alias("more")).alias("deep")))
    body = F.struct(k.alias("id"), props.alias("props"), F.slice(F.array(offer, offer), F.lit(1), (k % 3).cast("int")).alias("offers"))
    part = t.table(spark, d, "part")
    return audit.key_paths(part.select(F.to_json(body).alias("raw")).unionByName(part.where(k % 7 == 0).select(F.lit("{broken").alias("raw"))), "raw")


@query(f"WITH raw AS (SELECT {t.pick_sql(t.PRICES, 'p_partkey')} AS p FROM part) SELECT count(*) FILTER (p LIKE '%,%') AS comma, count(*) FILTER (p LIKE '%.%') AS dot, count(*) FILTER (p LIKE '%,%' AND p LIKE '%.%') AS both, count(*) FILTER (p LIKE '% %') AS space FROM raw")
def shape_probe(spark, d):
    return audit.price_shapes(t.table(spark, d, "part").select(t.pick(t.PRICES, F.col("p_partkey")).alias("raw_price")))


@query(
    with_("listing")
    + """, n AS (SELECT 'sku' AS origin, sku AS number FROM listing UNION ALL SELECT 'id', CAST(id AS VARCHAR) FROM listing)
SELECT origin, count(*) AS total, count(*) FILTER (regexp_matches(number, '^[0-9]+$')) AS digits, count(*) FILTER (regexp_matches(number, '^[0-9]+$') AND length(number) < 8) AS short_digits, count(*) FILTER (regexp_matches(number, '[A-Za-z]')) AS with_letter, count(*) FILTER (regexp_matches(number, '[^0-9A-Za-z]')) AS with_mark, count(*) FILTER (length(number) < 6) AS short FROM n GROUP BY origin"""
)
def number_probe(spark, d):
    lists = t.listings(spark, d)
    return audit.number_shapes(lists.select(F.lit("sku").alias("origin"), F.col("sku").alias("number")).unionByName(lists.select(F.lit("id").alias("origin"), F.col("id").cast("string").alias("number"))))


@query("SELECT user_id AS item, count(DISTINCT event_type) AS verdicts, count(DISTINCT event_type) > 1 AS drift FROM events GROUP BY user_id")
def drift(spark, d):
    return audit.drift(t.table(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("run"), F.col("event_type").alias("verdict")))


# --- scalar functions over literal vocabularies -------------------------------------------------

_K = "p_partkey"


@query(
    f"""WITH raw AS (SELECT p_partkey, replace(replace({t.pick_sql(t.PRICES, 'p_partkey')}, ' ', ''), ',', '.') AS p FROM part), num AS (SELECT p_partkey, regexp_extract(p, '-?[0-9]+([.][0-9]+)?') AS n FROM raw)
SELECT p_partkey, CASE WHEN n <> '' THEN CAST(round_even(CAST(n AS DECIMAL(18, 6)) * 100, 0) AS BIGINT) END AS price_cents FROM num"""
)
def parse_price(spark, d):
    return t.table(spark, d, "part").select("p_partkey", money.cents(money.parse_price(t.pick(t.PRICES, F.col(_K)))).alias("price_cents"))


@query(f"SELECT p_partkey, ([NULL, 219000, 20400, NULL, NULL, 125050])[CAST(p_partkey % {len(t.SNIPPETS)} AS INT) + 1]::BIGINT AS price_cents FROM part")
def snippet_price(spark, d):
    return t.table(spark, d, "part").select("p_partkey", money.cents(money.price_from_text(t.pick(t.SNIPPETS, F.col(_K)))).alias("price_cents"))


@query(
    f"""WITH raw AS (SELECT p_partkey, upper(regexp_replace({t.pick_sql(t.NUMBERS, 'p_partkey')}, '[[:space:]]+', '', 'g')) AS n FROM part)
SELECT p_partkey, CASE WHEN length(n) >= 4 AND regexp_matches(n, '[0-9A-Z]') AND NOT regexp_matches(n, '^(AUDI|PEUGEOT)[A-Z]{{0,2}}[0-9]{{1,4}}$') THEN n END AS oem FROM raw"""
)
def normalize_oem(spark, d):
    return t.table(spark, d, "part").select("p_partkey", text.normalize_oem(t.pick(t.NUMBERS, F.col(_K))).alias("oem"))


@query(f"SELECT p_partkey, (['062121350', NULL, NULL, NULL, NULL, NULL, '8E0513033', 'VKBA6522', '7700308222', NULL])[CAST(p_partkey % {len(t.NUMBERS)} AS INT) + 1] AS number FROM part")
def part_number(spark, d):
    return t.table(spark, d, "part").select("p_partkey", text.part_number(t.pick(t.NUMBERS, F.col(_K))).alias("number"))


def _without_lookaround(patterns) -> str:
    """Patterns for an engine whose ``\\b`` and ``\\w`` know ASCII only."""
    out = []
    for p in patterns:
        p = "(?:^|[^\\pL\\pN_])" + p[2:] if p.startswith("\\b") else p
        p = p[:-2] + "(?:$|[^\\pL\\pN_])" if p.endswith("\\b") else p
        out.append(p.replace("\\w", "[\\pL\\pN_]").replace("\\s", "[[:space:]]").replace("[[[:space:]]-]", "[[:space:]-]"))
    return "(?i)" + "|".join(f"(?:{p})" for p in out)


def _matches(column: str, patterns) -> str:
    return f"regexp_matches({column}, '{_without_lookaround(patterns)}')"


from ..functions import vocab  # noqa: E402

_TEXTS = f"texts AS (SELECT p_partkey, {t.pick_sql(t.TITLES, 'p_partkey')} AS title, {t.pick_sql(t.STOCKS, 'p_partkey')} AS stock FROM part)"


def _texts(spark, d):
    return t.table(spark, d, "part").select("p_partkey", t.pick(t.TITLES, F.col(_K)).alias("title"), t.pick(t.STOCKS, F.col(_K)).alias("stock"))


@query(
    f"""WITH {_TEXTS} SELECT p_partkey, {_matches('title', vocab.USED)} AS used, {_matches('title', vocab.ON_REQUEST)} OR {_matches('stock', vocab.ON_REQUEST_STOCK)} AS on_request,
{_matches('title', vocab.USED)} OR {_matches('stock', vocab.USED)} OR {_matches('title', vocab.ON_REQUEST)} OR {_matches('stock', vocab.ON_REQUEST_STOCK)} AS junk,
CASE WHEN {_matches('title', vocab.USED)} OR {_matches('stock', vocab.USED)} THEN 'used' WHEN {_matches('title', vocab.NEW)} THEN 'new' END AS condition FROM texts"""
)
def used_gate(spark, d):
    title, stock = F.col("title"), F.col("stock")
    return _texts(spark, d).select("p_partkey", text.is_used(title).alias("used"), text.is_price_on_request(title, stock).alias("on_request"), text.is_junk(title, stock).alias("junk"), text.condition_of(title, stock).alias("condition"))


@query(
    f"""WITH {_TEXTS} SELECT p_partkey, CASE {' '.join(f"WHEN lower(trim(stock)) = '{k}' THEN '{v}'" for k, v in vocab.STOCK_CODES.items())} WHEN {_matches('stock', vocab.OUT_OF_STOCK)} THEN 'out_of_stock' WHEN {_matches('stock', vocab.ON_ORDER)} THEN 'on_order' WHEN {_matches('stock', vocab.IN_STOCK)} THEN 'in_stock' END AS stock FROM texts"""
)
def stock_class(spark, d):
    return _texts(spark, d).select("p_partkey", text.stock_of(F.col("stock")).alias("stock"))


_STOP = ", ".join(f"'{w}'" for w in vocab.STOP_WORDS)


def _tokens(c: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({c}), '[\pL\pN_]+'), lambda w: length(w) >= 2 AND NOT list_contains([{_STOP}], w))"


@query(f"WITH {_TEXTS} SELECT p_partkey, array_to_string({_tokens('title')}, ' ') AS tokens FROM texts")
def name_tokens(spark, d):
    return _texts(spark, d).select("p_partkey", F.array_join(text.name_tokens(F.col("title")), " ").alias("tokens"))


_PAIR_SQL = f"""WITH {_TEXTS}, tok AS (SELECT DISTINCT title, list_distinct({_tokens('title')}) AS ts FROM texts),
pair AS (SELECT a.title AS a, b.title AS b, a.ts AS ta, b.ts AS tb, len(list_intersect(a.ts, b.ts)) AS i, len(list_distinct(list_concat(a.ts, b.ts))) AS u, least(len(a.ts), len(b.ts)) AS m FROM tok a, tok b)"""


@query(_PAIR_SQL + " SELECT a, b, CAST(round_even(CAST(0.5 AS DOUBLE) * i / u + CAST(0.5 AS DOUBLE) * i / m, 3) AS DOUBLE) AS similarity FROM pair WHERE i > 0 AND round_even(CAST(0.5 AS DOUBLE) * i / u + CAST(0.5 AS DOUBLE) * i / m, 3) >= 0.3")
def token_similarity_pairs(spark, d):
    from ..operators import offers

    names = _texts(spark, d).select("title").distinct().select(F.col("title").alias("id"), F.col("title").alias("name"))
    return offers.similar_names(names, names, 0.3).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), "similarity")


def _side_sql(ts: str, side) -> str:
    return "(" + " OR ".join(f"len(list_filter({ts}, lambda w: starts_with(w, '{p}'))) > 0" for p in side) + ")"


def _conflict_sql() -> str:
    parts = []
    for first, second in vocab.SIDES:
        a = f"CASE WHEN {_side_sql('ta', first)} THEN 0 WHEN {_side_sql('ta', second)} THEN 1 END"
        b = f"CASE WHEN {_side_sql('tb', first)} THEN 0 WHEN {_side_sql('tb', second)} THEN 1 END"
        parts.append(f"coalesce(({a}) <> ({b}), false)")
    return " OR ".join(parts)


@query(_PAIR_SQL + f" SELECT a, b, {_conflict_sql()} AS conflict FROM pair WHERE i > 0")
def laterality(spark, d):
    names = _texts(spark, d).select("title").distinct().select("title", F.array_distinct(text.name_tokens(F.col("title"))).alias("ts"))
    a = names.select(F.col("title").alias("a"), F.col("ts").alias("ta"), F.explode("ts").alias("w"))
    b = names.select(F.col("title").alias("b"), F.col("ts").alias("tb"), F.explode("ts").alias("w"))
    return a.join(b, "w").select("a", "b", "ta", "tb").distinct().select("a", "b", text.laterality_conflict(F.col("ta"), F.col("tb")).alias("conflict"))


@query(
    with_("listing")
    + "SELECT id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, nullif(regexp_extract(url, '-cs([0-9]+)[.]prom[.]ua/', 1), '') AS seller_id, CASE WHEN id % 2 = 0 THEN 'shop' END AS slug, CASE WHEN id % 2 = 0 THEN 'https://prom.ua/ua/p' || id || '-x.html' ELSE url END AS canonical, CAST(id AS VARCHAR) AS product_id FROM listing"
)
def seller_from_url(spark, d):
    url = F.col("url")
    slug, seller = urls.export_seller(url)
    return t.listings(spark, d).select("id", urls.host(url).alias("host"), seller.alias("seller_id"), slug.alias("slug"), urls.canonical_product(url).alias("canonical"), urls.product_id(url).alias("product_id"))


@query(r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages")
def url_host(spark, d):
    return t.table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


@query(
    with_("listing")
    + "SELECT id, 'competitor-prices:v12:' || id || ':' || sha1(upper(sku) || '|' || brand || '|' || name) AS cache_key FROM listing"
)
def cache_key_sha1(spark, d):
    q = catalog.queries_of(t.listings(spark, d))
    none = F.array().cast("array<string>")
    return q.select(F.col("query_id").alias("id"), text.cache_key(F.col("query_id"), F.col("oem_numbers"), F.col("brand"), F.col("name"), none, none).alias("cache_key"))


@query(with_("listing") + "SELECT id, upper(sku) || ';' || array_to_string(list_filter(string_split(lower(name), ' '), lambda w: length(w) >= 2), ' ') AS terms FROM listing")
def search_terms(spark, d):
    q = catalog.queries_of(t.listings(spark, d))
    return q.select(F.col("query_id").alias("id"), F.array_join(text.search_terms(F.col("oem_numbers"), F.col("name")), ";").alias("terms"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'A' || p_partkey || ';' || p_partkey || ';0' || p_size ELSE 'B0' || p_size || ';' || p_partkey END AS numbers FROM part")
def order_numbers(spark, d):
    p = t.table(spark, d, "part")
    k, s = F.col(_K).cast("string"), F.concat(F.lit("0"), F.col("p_size").cast("string"))
    raw = F.when(F.col(_K) % 2 == 0, F.array(k, F.concat(F.lit("A"), k), s, k)).otherwise(F.array(k, F.concat(F.lit("B"), s), k))
    return p.select("p_partkey", F.array_join(text.order_numbers(raw), ";").alias("numbers"))


_CURRENCIES = ("грн", " грн. ", "₴", "", "usd", " EUR ", "uah", "gbpound")
_SYMBOLS = ("грн", "$", "€", "?")
_IMAGES = (" https://i.ua/a.jpg ", "ftp://i.ua", "", "http://i.ua/b", "data:x")


@query(
    f"""WITH c AS (SELECT p_partkey, {t.pick_sql(_CURRENCIES, 'p_partkey')} AS c, {t.pick_sql(_SYMBOLS, 'p_partkey')} AS s FROM part)
SELECT p_partkey, CASE WHEN upper(trim(c)) IN ('', 'ГРН', 'ГРН.', '₴') THEN 'UAH' ELSE upper(trim(c)) END AS label, CASE WHEN trim(c) = '' THEN 'UAH' ELSE substr(upper(trim(c)), 1, 3) END AS code, CASE s WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' ELSE 'UAH' END AS symbol FROM c"""
)
def currencies(spark, d):
    c, s = t.pick(_CURRENCIES, F.col(_K)), t.pick(_SYMBOLS, F.col(_K))
    return t.table(spark, d, "part").select("p_partkey", money.currency_label(c).alias("label"), money.currency_code(c).alias("code"), money.currency_of_symbol(s).alias("symbol"))


@query(f"WITH c AS (SELECT p_partkey, trim({t.pick_sql(_IMAGES, 'p_partkey')}) AS i FROM part) SELECT p_partkey, CASE WHEN i LIKE 'http://%' OR i LIKE 'https://%' THEN i END AS image FROM c")
def image_url(spark, d):
    return t.table(spark, d, "part").select("p_partkey", urls.image_url(t.pick(_IMAGES, F.col(_K))).alias("image"))


@query(
    """WITH p AS (SELECT p_partkey, p_partkey % 2 = 0 AS has, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS discounted, CASE WHEN p_partkey % 5 > 0 THEN p_size * 2 ELSE 0 END AS price, CASE WHEN p_partkey % 7 > 0 THEN p_size * 3 END AS original FROM part)
SELECT p_partkey, CAST(100 * coalesce(CASE WHEN has AND discounted > 0 THEN discounted END, CASE WHEN price > 0 THEN price END, CASE WHEN original > 0 THEN original END) AS BIGINT) AS price_cents FROM p"""
)
def effective_price(spark, d):
    k, size = F.col(_K), F.col("p_size").cast("decimal(14,2)")
    price = money.effective_price(F.when(k % 5 > 0, size * 2).otherwise(F.lit(0)), F.when(k % 7 > 0, size * 3), F.when(k % 3 > 0, size), k % 2 == 0)
    return t.table(spark, d, "part").select("p_partkey", money.cents(price).alias("price_cents"))


@query(
    """SELECT o_orderkey, replace(CASE WHEN o_orderkey % 2 = 0 THEN format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) ELSE format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || '.50' END, ',', ' ') AS shown,
day(o_orderdate) || ' ' || (['січня', 'лютого', 'березня', 'квітня', 'травня', 'червня', 'липня', 'серпня', 'вересня', 'жовтня', 'листопада', 'грудня'])[month(o_orderdate)] || ' ' || year(o_orderdate) || ' о ' || strftime(o_orderdate, '%H:%M') AS day FROM orders"""
)
def display_formats(spark, d):
    whole = F.floor("o_totalprice").cast("decimal(14,2)")
    price = F.when(F.col("o_orderkey") % 2 == 0, whole).otherwise((whole + F.lit("0.50").cast("decimal(14,2)")).cast("decimal(14,2)"))
    return t.table(spark, d, "orders").select("o_orderkey", money.display_price(price).alias("shown"), money.display_date(F.col("o_orderdate").cast("timestamp")).alias("day"))


@query(
    """WITH v AS (SELECT p_partkey AS item, r.run, (['same', 'analog', 'no'])[CAST(p_partkey * r.run % 3 AS INT) + 1] AS verdict FROM part, (SELECT unnest(range(3)) AS run) r)
SELECT CAST(a.run AS INT) AS run_a, CAST(b.run AS INT) AS run_b, round_even(CAST(count(*) FILTER (a.verdict <> b.verdict) AS DOUBLE) / count(*), 4) AS rate FROM v a JOIN v b ON a.item = b.item AND a.run < b.run GROUP BY a.run, b.run"""
)
def run_disagreement(spark, d):
    runs = t.table(spark, d, "part").select(F.col(_K).alias("item"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("run"))
    return audit.disagreement(runs.withColumn("verdict", t.pick(("same", "analog", "no"), F.col("item") * F.col("run"))))


@query(with_("observation") + "SELECT date_trunc('hour', observed_at) AS start, listing_id, count(*) AS n, min(price_cents) AS low, max(price_cents) AS high FROM observation GROUP BY ALL")
def price_windows(spark, d):
    from ..streaming import observations

    w = observations.windowed(t.observations(spark, d))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "listing_id", "n", "low", "high")


_TOPIC = _PAIR_SQL + """, s AS (SELECT a, b, list_distinct(list_transform(list_filter(ta, lambda w: length(w) >= 4), lambda w: substr(w, 1, 4))) AS sa, list_distinct(list_transform(list_filter(tb, lambda w: length(w) >= 4), lambda w: substr(w, 1, 4))) AS sb FROM pair WHERE i > 0)
SELECT a, b, len(list_intersect(sa, sb)) > 0 AS topic FROM s"""


@query(_TOPIC)
def topic_overlap(spark, d):
    names = _texts(spark, d).select("title").distinct().select("title", F.array_distinct(text.name_tokens(F.col("title"))).alias("ts"))
    a = names.select(F.col("title").alias("a"), F.col("ts").alias("ta"), F.explode("ts").alias("w"))
    b = names.select(F.col("title").alias("b"), F.col("ts").alias("tb"), F.explode("ts").alias("w"))
    return a.join(b, "w").select("a", "b", "ta", "tb").distinct().select("a", "b", text.topic_overlap(F.col("ta"), F.col("tb")).alias("topic"))


_OURS = "Фара ліва передня BMW"
_HIT_SQL = f"""WITH x AS (SELECT p_partkey, {t.pick_sql(t.TITLES, 'p_partkey')} AS name, (['', ' 77-00-308-222', ' 1300115', ' KX 12'])[CAST(p_partkey // 16 % 4 AS INT) + 1] AS code, (['Bosch', ' kemp ', '', NULL])[CAST(p_partkey // 64 % 4 AS INT) + 1] AS theirs, (['BOSCH', 'KEMP', 'Valeo', NULL])[CAST(p_partkey % 4 AS INT) + 1] AS ours FROM part),
tok AS (SELECT *, list_distinct({_tokens(f"'{_OURS}'")}) AS ta, list_distinct({_tokens("name || code")}) AS tb, list_distinct({_tokens("name")}) AS tn, regexp_replace(upper(name || code), '[^0-9A-ZА-ЯІЇЄЁҐ]', '', 'g') AS flat FROM x),
s AS (SELECT *, ({_conflict_sql()}) AS conflict, contains(flat, '7700308222') AS clear, contains(flat, '1300115') AS unclear,
  len(list_intersect(list_transform(list_filter(ta, lambda w: length(w) >= 4), lambda w: substr(w, 1, 4)), list_transform(list_filter(tb, lambda w: length(w) >= 4), lambda w: substr(w, 1, 4)))) > 0 AS topic,
  lower(trim(coalesce(CASE WHEN lower(trim(ours)) = 'kemp' THEN NULL ELSE ours END, ''))) AS bo, lower(trim(coalesce(theirs, ''))) AS bt,
  round_even(CAST(0.5 AS DOUBLE) * len(list_intersect(ta, tn)) / len(list_distinct(list_concat(ta, tn))) + CAST(0.5 AS DOUBLE) * len(list_intersect(ta, tn)) / least(len(ta), len(tn)), 3) AS alike FROM tok)
SELECT p_partkey, CASE WHEN conflict THEN 0 WHEN (bo = '' OR bt = '' OR bo = bt) AND (clear OR (unclear AND topic)) THEN 0.9 WHEN alike >= 0.8 THEN 0.7 WHEN alike >= 0.7 THEN 0.55 ELSE 0 END::DOUBLE AS score FROM s"""


@query(_HIT_SQL)
def match_scores(spark, d):
    """Scores where brands agree or differ and codes are clear, ambiguous or too short."""
    k = F.col(_K)
    at = lambda values, key: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (key % 4 + 1).cast("int"))
    name = t.pick(t.TITLES, k)
    said = F.concat(name, at(("", " 77-00-308-222", " 1300115", " KX 12"), F.floor(k / 16)))
    score = text.match_score(F.array(F.lit("77 00 308 222"), F.lit("1300115"), F.lit("KX12")), F.lit(_OURS), at(("BOSCH", "KEMP", "Valeo", None), k), said, name, at(("Bosch", " kemp ", "", None), F.floor(k / 64)))
    return t.table(spark, d, "part").select("p_partkey", score.alias("score"))
