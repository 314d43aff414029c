"""The offer pipeline: gates, dedupe, top-k, verdicts, currencies, outliers, availability.

An offer has query_id, source, source_ord, offer_ord (its place in the source's list), title,
price DECIMAL(14,2), currency, seller, url, availability, condition, image_url, confidence,
is_analog, stock.  Every stage is a DataFrame transformation over all queries at once.
Stages that look at a whole query group by ``query_id`` alone, so one exchange serves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, text, urls, vocab
from . import market
from .matching import containing_code, similar_names  # noqa: F401  (they are looked for here too)

#: Tasks that queries are dealt to by their lists of shops; some ten different lists of 100 KB are a Parquet dictionary.
OWNER_PARTS = 200


def drop_junk(offers: DataFrame) -> DataFrame:
    """Without used parts and prices on request.  Comes before the dedupe."""
    return offers.where(~text.is_junk(F.col("title"), F.col("availability")))


def drop_own_sellers(offers: DataFrame, owned: DataFrame, key: str = "seller") -> DataFrame:
    """Without offers of owned sellers (a column named as ``key`` in ``owned``)."""
    return offers.join(owned.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def owner_identity(workspaces: DataFrame, exclusions: DataFrame, own=vocab.OWN_SELLERS) -> DataFrame:
    """(workspace, seller_ids, seller_slugs): the marketplace shops that are a workspace's own, sorted, with the house's ``own`` (id, slug).

    ``exclusions``: workspace, marketplace, external_id, slug, a row for each shop that somebody entered (some dozens a workspace).
    """
    mine = exclusions.where(F.lower("marketplace") == "prom")
    found = mine.groupBy("workspace").agg(F.collect_set(text.present(F.col("external_id"))).alias("_ids"), F.collect_set(text.fold(text.present(F.col("slug")))).alias("_slugs"))
    none = F.array().cast("array<string>")
    merged = lambda name, at: F.array_sort(F.array_distinct(F.concat(F.coalesce(F.col(name), none), F.array(*[F.lit(o[at]) for o in own]).cast("array<string>"))))
    joined = workspaces.select("workspace").distinct().join(found, "workspace", "left")
    return joined.select("workspace", merged("_ids", 0).alias("seller_ids"), merged("_slugs", 1).alias("seller_slugs"))


def _own_seller(queries: DataFrame) -> tuple[Column, Column]:
    """(ids, slugs) of the seller of a query's own listing, as far as ``queries`` has them."""
    own = lambda *names: F.array_compact(F.array(*[text.present(F.col(c).cast("string")) for c in names if c in queries.columns]).cast("array<string>"))
    return own("seller_id", "owner_seller_id"), F.transform(own("seller_slug", "owner_seller_slug"), text.fold)


def query_owners(queries: DataFrame, owners: DataFrame) -> DataFrame:
    """(query_id, seller_ids, seller_slugs): the workspace's own shops (`owner_identity`) united with the listing's own seller; both tables as `owner_lists` has them."""
    return each_query(owner_lists(queries, owners))


def each_query(lists: DataFrame) -> DataFrame:
    """Rows of `owner_lists` for each query, query_id in place of ``queries``."""
    # The transform's lambda keeps the step out of generated code, which would hold all rows of a list, each with its copy of it, before the first goes on.
    return lists.select(F.explode(F.transform("queries", lambda q: q["query_id"])).alias("query_id"), *[c for c in lists.columns if c != "queries"])


def owner_lists(queries: DataFrame, owners: DataFrame, parts: int = OWNER_PARTS) -> DataFrame:
    """(queries, seller_ids, seller_slugs): `query_owners` for queries of a workspace whose listings have the same seller, taken together.

    ``queries`` has query_id, workspace and, as far as they are known, seller_id and seller_slug (of the listing's
    raw data), owner_seller_id and owner_seller_slug (of its export host).  Lists are as long as a workspace has shops, so they are
    made once for many queries and not moved afterwards.  ``parts`` tasks take the queries in the order of their lists: rows of one list
    lie together, and a file that keeps repeated values once (as Parquet does) grows with the different lists, not with their rows.
    """
    none = F.array().cast("array<string>")
    ids, slugs = _own_seller(queries)
    # A part of a list's queries, so that no list of queries is long and no task has all of a frequent list.
    dealt = queries.select("query_id", "workspace", ids.alias("_ids"), slugs.alias("_slugs")).repartition("query_id")  # the order is found by a look at all queries, which aren't made twice for it
    asked = dealt.select(F.struct("query_id").alias("query"), "workspace", *[F.sort_array(F.array_distinct(c)).alias(c) for c in ("_ids", "_slugs")], F.pmod(F.xxhash64("query_id"), F.lit(max(parts // 8, 1))).alias("_part"))
    key = ("workspace", "_ids", "_slugs", "_part")
    same = asked.repartitionByRange(parts, *key).groupBy(*key).agg(F.collect_list("query").alias("queries"))
    listed = owners.select("workspace", *[F.sort_array(F.array_distinct(F.array_compact(F.coalesce(c, none)))).alias(c) for c in ("seller_ids", "seller_slugs")])

    def both(name, more):
        had = F.coalesce(F.col(name), none)
        new = F.filter(more, lambda x: ~F.array_contains(had, x))
        return F.when(F.size(new) == 0, had).otherwise(F.sort_array(F.concat(had, new))).alias(name)

    return same.join(listed, "workspace", "left").select("queries", both("seller_ids", "_ids"), both("seller_slugs", "_slugs"))


def drop_own_products(offers: DataFrame, owners: DataFrame, key: str = "workspace") -> DataFrame:
    """Without a workspace's own products: by the seller's id, the seller's slug, the id in the url's host, or the listing itself.

    ``offers`` has ``key``, seller_id, seller_slug, url and source_url (the listing that is asked for); ``owners`` as `owner_identity`
    or `query_owners` (with key query_id) gives it.  Titles are not looked at, since they change.  Shops are looked up as rows, so
    that the work doesn't grow with the length of a workspace's list.
    """
    said = {"_id": text.present(F.col("seller_id").cast("string")), "_slug": text.fold(text.present(F.col("seller_slug"))), "_host": urls.host_seller_id(F.col("url"))}
    kept = offers.where(~urls.same_product(F.col("source_url"), F.col("url"))).withColumns(said)
    for at, name in (("_id", "seller_ids"), ("_slug", "seller_slugs"), ("_host", "seller_ids")):
        kept = kept.join(owners.select(key, F.explode(name).alias(at)).distinct(), [key, at], "left_anti")
    return kept.select(*offers.columns)


def from_products(products: DataFrame, queries: DataFrame, owners: DataFrame) -> DataFrame:
    """Marketplace products found for queries as offers: scored, without own products and junk, the cheapest of each seller, the best 60 of a query.

    ``products``: query_id, place (of the product among all pages and terms of its query), term, name, sku, brand, ``effective_price`` (as product pages
    give it; else price, as text), currency, url, seller_id, seller_slug, seller_name, presence, is_available, image.  ``queries``: query_id, workspace, oem_numbers, brand, name,
    source_url, and the listing's own seller as `query_owners` reads it.  Products that match nothing, or without price or url, go.  Junk goes before the dedupe, or a seller's cheapest would be junk.
    """
    ids, slugs = _own_seller(queries)
    asked = queries.select("query_id", F.col("workspace").alias("_workspace"), ids.alias("_ids"), slugs.alias("_slugs"), "source_url", F.col("oem_numbers").alias("_numbers"), F.col("brand").alias("_brand"), F.col("name").alias("_name"))
    joined = products.join(asked.hint("merge"), "query_id")  # as many rows as queries, however small they look
    said = F.concat_ws(" ", F.nullif("name", F.lit("")), F.nullif("sku", F.lit("")))
    score = text.match_score(F.col("_numbers"), F.col("_name"), F.col("_brand"), said, F.col("name"), F.col("brand"))
    price = F.col("effective_price") if "effective_price" in products.columns else money.parse_price(F.col("price"))
    scored = joined.withColumn("confidence", score).withColumn("_price", price).where((F.col("confidence") > 0) & F.col("_price").isNotNull() & (F.col("url") != ""))
    # A query's own sellers are in its row, its workspace's are looked up: no list is made for each query.
    has = lambda name, value: F.coalesce(F.array_contains(name, value), F.lit(False))
    own = has("_ids", text.present(F.col("seller_id").cast("string"))) | has("_slugs", text.fold(text.present(F.col("seller_slug")))) | has("_ids", urls.host_seller_id(F.col("url")))
    foreign = scored.where(~own & ~text.is_junk(F.col("name"), F.col("presence")))
    fine = drop_own_products(foreign, owners.withColumnRenamed("workspace", "_workspace"), "_workspace")
    none = F.lit(None).cast("string")
    made = fine.select(
        "query_id", F.lit("prom").alias("source"), F.lit(0).alias("source_ord"), F.col("place").alias("offer_ord"), F.coalesce(F.nullif("name", F.lit("")), F.nullif("sku", F.lit("")), "term").alias("title"),
        F.col("_price").cast(money.MONEY).alias("price"), F.coalesce(F.nullif("currency", F.lit("")), F.lit("UAH")).alias("currency"), F.col("seller_name").alias("seller"), "url", F.col("presence").alias("availability"),
        text.condition_of(F.col("name"), none).alias("condition"), F.col("image").alias("image_url"), "confidence", (F.col("confidence") < vocab.OEM_HIT).alias("is_analog"),
        F.when(~F.col("is_available"), F.lit("out_of_stock")).alias("stock"),
    )
    one = cheapest_per(made.withColumn("_key", F.coalesce(F.nullif("seller", F.lit("")), "url")), "query_id", "_key").drop("_key")
    return top_per_source(one)


def drop_own_domains(offers: DataFrame) -> DataFrame:
    """Web offers without those of own or covered domains, or outside the market's top-level domain."""
    domain = urls.host(F.col("url"))
    return offers.where((domain != "") & ~urls.is_own_domain(domain) & ~urls.is_covered(domain) & domain.endswith(vocab.ALLOWED_TLD))


def cheapest_per(offers: DataFrame, *keys: str) -> DataFrame:
    """The cheapest offer of each key; the first seen of equals."""
    w = Window.partitionBy(*keys).orderBy("price", "source_ord", "offer_ord")
    return offers.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_source(offers: DataFrame, k: int | None = None) -> DataFrame:
    """The first k of each query and source by confidence, then price, then position; k by source if not given."""
    w = Window.partitionBy("query_id", "source").orderBy(F.col("confidence").desc(), "price", "offer_ord")
    most = F.lit(k) if k else F.coalesce(F.create_map(*[F.lit(x) for kv in vocab.SOURCE_MOST.items() for x in kv])[F.col("source")], F.lit(60))
    ranked = offers.withColumn("_rn", F.row_number().over(w))
    return ranked.where(F.col("_rn") <= (k if k else most)).drop("_rn")


def refine(offers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """First model pass: ``no`` drops, ``same`` lifts the confidence, ``analog`` marks an analogue.

    ``verdicts``: query_id, source, offer_ord, verdict.  Sources without verdicts stay as they are.
    """
    v = verdicts.select("query_id", "source", "offer_ord", F.col("verdict").alias("_v"))
    joined = offers.join(v, ["query_id", "source", "offer_ord"], "left")
    lifted = F.when(F.col("_v") == "same", F.greatest(F.col("confidence"), F.lit(vocab.SAME))).when(F.col("_v") == "analog", F.lit(vocab.ANALOG)).otherwise(F.col("confidence"))
    analog = F.when(F.col("_v") == "same", F.lit(False)).when(F.col("_v") == "analog", F.lit(True)).otherwise(F.col("is_analog"))
    return joined.where(F.coalesce(F.col("_v") != "no", F.lit(True))).withColumn("confidence", lifted).withColumn("is_analog", analog).drop("_v").select(*offers.columns)


def to_uah(offers: DataFrame, rates: DataFrame) -> DataFrame:
    """Prices with a rate become hryvnias; ``rates`` (code, rate) has a row for each currency there is."""
    r = F.broadcast(rates.select(F.col("code").alias("currency"), F.col("rate").cast("decimal(12,4)").alias("_rate")))  # ISO codes: some 200
    joined = offers.join(r, "currency", "left")
    price = F.when(F.col("_rate").isNotNull(), F.bround(F.col("price") * F.col("_rate"), 2).cast(money.MONEY)).otherwise(F.col("price"))
    return joined.withColumn("price", price).withColumn("currency", F.when(F.col("_rate").isNotNull(), F.lit("UAH")).otherwise(F.col("currency"))).select(*offers.columns)


def single_currency(offers: DataFrame) -> DataFrame:
    """Each query in one currency: UAH if any offer has it, else the most frequent, the first seen of equals.

    Offers of a currency are peers in their query's order, so one exchange and one sort serve all of it.
    """
    by_query = Window.partitionBy("query_id")
    peers = by_query.orderBy(F.col("currency").asc_nulls_last()).rangeBetween(Window.currentRow, Window.currentRow)
    counted = offers.withColumn("_n", F.count(F.lit(1)).over(peers)).withColumn("_seen", F.min(F.struct("source_ord", "offer_ord")).over(peers))
    order = F.struct((F.col("currency") != "UAH").alias("a"), (-F.col("_n")).alias("b"), F.col("_seen").alias("c"), F.col("currency").alias("main"))
    return counted.withColumn("_main", F.min(order).over(by_query)).where(F.col("currency").eqNullSafe(F.col("_main.main"))).select(*offers.columns)


def drop_implausible(offers: DataFrame, single: bool = False) -> DataFrame:
    """Without prices of 0 and, in queries of four offers or more, those eight times off the median strong price.

    Where each query has a ``single`` currency, rows in the order of currency and price stand by price.
    """
    both = market.with_anchor(offers.where("price > 0"), least=1, order=("currency", "price") if single else ())
    checked = (F.col("n_offers") >= vocab.OUTLIER_MIN_OFFERS) & F.col("anchor").isNotNull() & (F.col("anchor") > 0)
    inside = (F.col("price") * vocab.OUTLIER_FACTOR >= F.col("anchor")) & (F.col("price") <= F.col("anchor") * vocab.OUTLIER_FACTOR)
    return both.where(~checked | inside).select(*offers.columns)


def availability_gate(offers: DataFrame, enabled: bool = True) -> DataFrame:
    """Offers out of stock stay visible and fall below the confidence that counts; a source's own signal goes before the text."""
    if not enabled:
        return offers
    read = offers.withColumn("_said", text.stock_of(F.col("availability")))
    said, own = F.col("_said"), F.col("stock")
    out = F.coalesce(F.coalesce(own, said) == "out_of_stock", F.lit(False))
    label = out & F.coalesce(own == "out_of_stock", F.lit(False)) & F.coalesce(said != "out_of_stock", F.lit(True))
    confidence = F.when(out, F.least(F.col("confidence"), F.lit(vocab.UNVERIFIED))).otherwise(F.col("confidence"))
    shown = F.when(label, F.lit(vocab.OUT_OF_STOCK_LABEL)).otherwise(F.col("availability"))
    return read.select(*[{"confidence": confidence, "availability": shown}.get(c, F.col(c)).alias(c) for c in offers.columns])


def suspicious() -> Column:
    """Cheaper than the anchor by the factor, without a division; false without an anchor."""
    return F.coalesce(F.col("price") * F.lit(vocab.SUSPICIOUS).cast("decimal(3,1)") < F.col("anchor"), F.lit(False))


_PLACE = ("price", "source_ord", "offer_ord")


def _verify_marked(offers: DataFrame) -> DataFrame:
    """All offers with ``anchor`` and, of those for the second model pass, their ``position`` in the query."""
    both = market.with_anchor(offers).withColumn("_for", F.col("anchor").isNotNull() & (market.strong() | suspicious()))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("_for").desc(), *_PLACE)) - 1
    return both.withColumn("position", turn).withColumn("position", F.when(F.col("_for") & (F.col("position") < vocab.VERIFY_MOST), F.col("position"))).drop("_for", "n_offers")


def verify_pick(offers: DataFrame) -> DataFrame:
    """Offers for the second model pass, with ``anchor`` and ``position``: strong or suspiciously cheap ones, the 40 cheapest of a query."""
    return _verify_marked(offers).where("position IS NOT NULL")


def _said_by(marked: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """``marked`` with the verdict (``_v``) on its ``key``; ``verdicts`` (query_id, key, verdict) become one small map for each query, so offers stay where they are."""
    one = verdicts.where(F.col(key).isNotNull()).groupBy("query_id", key).agg(F.max("verdict").alias("v"))
    maps = one.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct(key, "v"))).alias("_said"))
    return marked.join(maps, "query_id", "left").withColumn("_v", F.col("_said")[F.col(key)]).drop("_said")


def verify_apply(offers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Second pass: ``drop`` removes; anything but ``ok`` demotes what is suspiciously cheap.  ``verdicts``: query_id, position (below 40), verdict."""
    asked = verdicts.where(F.col("position").between(0, vocab.VERIFY_MOST - 1)).select("query_id", "position", "verdict")
    said = _said_by(_verify_marked(offers), asked, "position")
    mine = F.col("position").isNotNull()
    act = F.when(mine & F.coalesce(F.col("_v") == "drop", F.lit(False)), F.lit("drop")).when(mine & F.coalesce(F.col("_v") != "ok", F.lit(True)) & suspicious(), F.lit("demote"))
    return _act(said.withColumn("_act", act), offers.columns)


def _act(marked: DataFrame, columns: list[str]) -> DataFrame:
    low = F.when(F.col("_act").isin("demote", "used"), F.least(F.col("confidence"), F.lit(vocab.UNVERIFIED))).otherwise(F.col("confidence"))
    condition = F.when(F.col("_act") == "used", F.lit("used")).otherwise(F.col("condition")) if "condition" in columns else None
    new = {"confidence": low, "condition": condition}
    return marked.where(F.coalesce(F.col("_act") != "drop", F.lit(True))).select(*[(new[c] if new.get(c) is not None else F.col(c)).alias(c) for c in columns])


def _photo_marked(offers: DataFrame) -> DataFrame:
    """All offers with ``anchor``, and ``photo``: the url, where its photo is looked at."""
    both = market.with_anchor(offers).drop("n_offers")
    seen = F.col("anchor").isNotNull() & (F.coalesce(F.col("image_url"), F.lit("")) != "")
    both = both.withColumn("_cheap", seen & market.strong() & F.col("condition").isNull())
    by_query = Window.partitionBy("query_id")
    both = both.withColumn("_rn", F.row_number().over(by_query.orderBy(F.col("_cheap").desc(), *_PLACE)))
    both = both.withColumn("_chosen", (F.col("_cheap") & (F.col("_rn") <= vocab.PHOTO_CHEAPEST)) | (seen & suspicious()))
    own = F.min(F.when(F.col("_chosen"), F.struct(*_PLACE))).over(Window.partitionBy("query_id", "url"))
    placed = both.withColumn("_first", F.when(F.col("_chosen"), own))
    turn = F.dense_rank().over(by_query.orderBy(F.col("_first").asc_nulls_last()))
    return placed.withColumn("photo", F.when(F.col("_chosen") & (turn <= vocab.PHOTO_MOST), F.col("url"))).drop("_cheap", "_rn", "_chosen", "_first")


def photo_pick(offers: DataFrame) -> DataFrame:
    """Offers whose photo is looked at: the three cheapest strong ones of unknown condition and all suspicious ones, four urls at most."""
    return _photo_marked(offers).where("photo IS NOT NULL").drop("photo")


def photo_apply(offers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``used`` removes a suspicious offer and demotes another; ``unsure`` demotes a suspicious one.  ``verdicts``: url, verdict.

    Offers are marked once and meet the verdicts by url; those whose photo isn't looked at are dealt out by place, so that nothing gathers.
    """
    said = verdicts.where(F.col("url").isNotNull()).groupBy(F.col("url").alias("_url")).agg(F.max("verdict").alias("_v"))
    marked = _photo_marked(offers).withColumn("_key", F.coalesce("photo", F.concat_ws(" ", "query_id", "source_ord", "offer_ord")))
    said = marked.join(said, (F.col("_key") == F.col("_url")) & F.col("photo").isNotNull(), "left")
    v = F.col("_v")
    act = F.when((v == "used") & suspicious(), F.lit("drop")).when(v == "used", F.lit("used")).when((v == "unsure") & suspicious(), F.lit("demote"))
    return _act(said.withColumn("_act", act), offers.columns)


def collect(offers: DataFrame, rates: DataFrame, verdicts: DataFrame | None = None, checked: DataFrame | None = None, photos: DataFrame | None = None, gate: bool = True) -> DataFrame:
    """All stages after the sources, in the order that results depend on."""
    out = refine(offers, verdicts) if verdicts is not None else offers
    # One sort serves the choice of a currency and the median in it.
    sorted_ = to_uah(out, rates).repartition("query_id").sortWithinPartitions("query_id", F.col("currency").asc_nulls_last(), F.col("price").asc_nulls_last())
    out = availability_gate(drop_implausible(single_currency(sorted_), single=True), gate)
    out = verify_apply(out, checked) if checked is not None else out
    return photo_apply(out, photos) if photos is not None else out


def status(offers: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, source, status): what ``sources`` (query_id, source, status) reported, ok turned to empty where nothing is left."""
    n = offers.groupBy("query_id", "source").agg(F.count("*").alias("offers_total"))
    joined = sources.join(n, ["query_id", "source"], "left").withColumn("offers_total", F.coalesce("offers_total", F.lit(0)))
    return joined.withColumn("status", F.when((F.col("status") == "ok") & (F.col("offers_total") == 0), F.lit("empty")).otherwise(F.col("status")))


# --- joins of listings and offers -----------------------------------------------------------


def cross_source_duplicates(offers: DataFrame) -> DataFrame:
    """(query_id, title, price, sources, offers) of equal titles and prices in more than one source."""
    key = F.regexp_replace(F.lower(F.trim("title")), r"\s+", " ")
    groups = offers.groupBy("query_id", key.alias("title"), "price").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("offers"))
    return groups.where("sources > 1")
