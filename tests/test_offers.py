"""The offer pipeline on small cases."""

import json
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelark.functions import vocab
from pricelark.operators import market, models, offers
from pricelark.plans import testbed as t

SCHEMA = "query_id long, source string, source_ord int, offer_ord long, title string, price decimal(14,2), currency string, seller string, url string, availability string, condition string, image_url string, confidence double, is_analog boolean, stock string"


def make(spark, *rows):
    out = []
    for i, r in enumerate(rows):
        d = {"query_id": 1, "source": "prom", "source_ord": 0, "offer_ord": i, "title": f"t{i}", "currency": "UAH", "seller": f"s{i}", "url": f"https://x{i}.ua/p", "confidence": 0.9, "is_analog": False} | r
        d["price"] = D(str(d["price"]))
        out.append(tuple(d.get(c.split()[0]) for c in SCHEMA.split(", ")))
    return spark.createDataFrame(out, SCHEMA)


def prices(df):
    return sorted(float(r["price"]) for r in df.collect())


def test_stats_and_thin_market(spark):
    s = market.stats(make(spark, *[{"price": p} for p in (100, 200, 300)]), "query_id").first()
    assert (s["min_price"], s["median_price"], s["max_price"], s["recommended_price"], s["thin_market"]) == (100, D("200.00"), 300, 94, False)
    weak = [{"price": p, "confidence": 0.5} for p in (50, 100, 120)]
    s = market.stats(make(spark, {"price": 500}, {"price": 520}, *weak), "query_id").first()
    assert (s["thin_market"], s["recommended_price"], s["min_price"], s["max_price"], s["offers_total"]) == (True, None, 500, 520, 5)


def test_single_currency(spark):
    df = make(spark, {"price": 200}, {"price": 240}, {"price": 50, "currency": "USD", "source": "google", "source_ord": 2})
    assert prices(offers.single_currency(df)) == [200, 240]
    assert prices(offers.single_currency(make(spark, {"price": 1, "currency": "USD"}, {"price": 2, "currency": "USD"}, {"price": 3}))) == [3]
    assert prices(offers.single_currency(make(spark, {"price": 1, "currency": "EUR"}, {"price": 2, "currency": "USD"}))) == [1]


def test_fx(spark):
    rates = spark.createDataFrame([("USD", "41.5")], "code string, rate string")
    got = offers.to_uah(make(spark, {"price": 50, "currency": "USD"}, {"price": 5, "currency": "PLN"}), rates).collect()
    assert sorted((r["price"], r["currency"]) for r in got) == [(D("5.00"), "PLN"), (D("2075.00"), "UAH")]


def test_implausible(spark):
    assert prices(offers.drop_implausible(make(spark, *[{"price": p} for p in (190, 200, 210, 3_000_000)]))) == [190, 200, 210]
    assert prices(offers.drop_implausible(make(spark, *[{"price": p} for p in (0, 1, 200, 3000)]))) == [1, 200, 3000]


def test_availability(spark):
    df = make(spark, {"price": 100, "availability": "Немає в наявності"}, {"price": 180}, {"price": 210}, {"price": 240}, {"price": 90, "stock": "out_of_stock", "availability": "В наявності"})
    got = offers.availability_gate(df)
    s = market.stats(got, "query_id").first()
    assert (s["offers_total"], s["min_price"], s["median_price"]) == (5, 180, D("210.00"))
    assert {r["availability"] for r in got.where("price = 90").collect()} == {"Немає в наявності"}
    assert offers.availability_gate(df, enabled=False) is df


def test_cheapest_first_seen(spark):
    got = offers.cheapest_per(make(spark, {"price": 300, "seller": "B"}, {"price": 200, "seller": "B"}, {"price": 200, "seller": "B"}, {"price": 250, "seller": "C"}), "query_id", "seller")
    assert sorted((r["seller"], r["offer_ord"]) for r in got.collect()) == [("B", 1), ("C", 3)]


def test_refine(spark):
    df = make(spark, *[{"price": p, "confidence": 0.55} for p in (1, 2, 3, 4)])
    v = spark.createDataFrame([(1, "prom", 0, "no"), (1, "prom", 1, "same"), (1, "prom", 2, "analog")], "query_id long, source string, offer_ord long, verdict string")
    assert [(float(r["price"]), r["confidence"], r["is_analog"]) for r in offers.refine(df, v).orderBy("price").collect()] == [(2, 0.95, False), (3, 0.75, True), (4, 0.55, False)]


def test_verify(spark):
    df = make(spark, {"price": 100}, {"price": 1000}, {"price": 1100}, {"price": 1200})
    assert [r["position"] for r in offers.verify_pick(df).orderBy("price").collect()] == [0, 1, 2, 3]
    none = spark.createDataFrame([], "query_id long, position int, verdict string")
    assert [r["confidence"] for r in offers.verify_apply(df, none).orderBy("price").collect()] == [0.5, 0.9, 0.9, 0.9]
    v = spark.createDataFrame([(1, 0, "ok"), (1, 3, "drop")], "query_id long, position int, verdict string")
    assert [(float(r["price"]), r["confidence"]) for r in offers.verify_apply(df, v).orderBy("price").collect()] == [(100, 0.9), (1000, 0.9), (1100, 0.9)]


def test_photo(spark):
    rows = [{"price": p, "image_url": "https://i", "url": f"https://u{p}"} for p in (1400, 2500, 3487, 6941, 7482, 8420)]
    df = make(spark, *rows)
    v = spark.createDataFrame([("https://u1400", "used")], "url string, verdict string")
    assert prices(offers.photo_apply(df, v)) == [2500, 3487, 6941, 7482, 8420]
    v = spark.createDataFrame([("https://u2500", "used")], "url string, verdict string")
    got = {float(r["price"]): (r["condition"], r["confidence"]) for r in offers.photo_apply(df, v).collect()}
    assert got[2500] == ("used", 0.5) and got[1400] == (None, 0.9) and len(got) == 6


def test_stage_order(spark):
    """An out-of-stock bargain still shows and doesn't set the recommendation."""
    df = make(spark, {"price": 100, "availability": "Закінчився"}, *[{"price": p} for p in (500, 520, 540)])
    rates = spark.createDataFrame([("USD", "41.5")], "code string, rate string")
    s = market.stats(offers.collect(df, rates), "query_id").first()
    assert (s["offers_total"], s["recommended_price"]) == (4, 470)


def test_no_product_of_sides(spark):
    q = spark.createDataFrame([(1, ["7700308222"])], "query_id long, oem_numbers array<string>")
    o = spark.createDataFrame([(1, "Радіатор 77 00 308 222"), (2, "Радіатор 7700308223"), (3, "x")], "offer_id long, title string")
    got = offers.containing_code(q, o)
    assert [r["offer_id"] for r in got.collect()] == [1]
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_models(spark):
    c = spark.createDataFrame([(1, "prom", i, f"t{i}") for i in range(27)], "query_id long, source string, position int, title string")
    assert sorted((r["chunk"], len(r["titles"])) for r in models.batches(c).collect()) == [(0, 25), (1, 2)]
    a = spark.createDataFrame([(1, "prom", 0, '{"verdicts":[{"index":0,"verdict":"same"},{"index":40,"verdict":"no"}]}'), (1, "prom", 1, "broken")], "query_id long, source string, chunk int, response string")
    got = {r["position"]: r["verdict"] for r in models.verdicts(c, a).collect()}
    assert got == {0: "same"} | {i: "no" for i in range(1, 25)}
    p = spark.range(1).select(models.prompt(F.lit("Фара"), F.lit(None).cast("string"), F.array(F.lit("A1")), F.array(F.lit("x"), F.lit("y"))))
    assert p.first()[0] == "Наша деталь: Фара\nКаталожні номери: A1\n\nКандидати:\n0. x\n1. y"


@pytest.mark.parametrize(("price", "band"), [(100, "best"), (150, "optimal"), (240, "expensive"), (210, "above")])
def test_bands(spark, price, band):
    df = spark.range(1).select(market.position_band(F.lit(D(price)), F.lit(D(100)), F.lit(D(200))))
    assert df.first()[0] == band


PRODUCT = "query_id long, place long, term string, name string, sku string, brand string, price string, currency string, url string, seller_id string, seller_slug string, seller_name string, presence string, is_available boolean, image string"


def test_products_become_offers(spark):
    """Own products, junk, strangers and what has no price go; then each seller's cheapest stays; a name alone is an analogue."""
    given = [
        {"name": "Фара ліва AB123456", "price": "1200", "seller_name": "one"},
        {"name": "Фара ліва AB123456 нова", "price": "1 000,50", "seller_name": "one", "is_available": False},
        {"name": "Фара ліва AB123456 б/у", "price": "10", "seller_name": "one"},
        {"name": "Фара ліва AB123456", "price": "900", "seller_id": "77"},
        {"name": "Фара ліва AB123456", "price": "900", "seller_slug": "Mine_Shop"},
        {"name": "Фара ліва AB123456", "price": "900", "url": "https://some_shop-cs77.prom.ua/p8-x.html"},
        {"name": "Фара ліва AB123456", "price": "900", "url": "https://prom.ua/ua/p5-x.html"},
        {"name": "Ківі свіжі", "price": "900"},
        {"name": "Фара ліва AB123456", "price": "договірна"},
        {"name": "Фара ліва передня", "price": "700", "currency": "USD", "seller_name": "two"},
        {"name": None, "sku": "AB-123456", "price": "1100", "seller_name": None, "term": "AB123456"},
    ]
    rows = []
    for i, r in enumerate(given):
        full = {"query_id": 1, "place": i, "url": f"https://prom.ua/p{100 + i}-x.html", "is_available": True} | r
        rows.append(tuple(full.get(c.split()[0]) for c in PRODUCT.split(", ")))
    queries = spark.createDataFrame([(1, 3, ["AB123456"], None, "Фара ліва передня", "https://prom.ua/p5-old.html")], "query_id long, workspace long, oem_numbers array<string>, brand string, name string, source_url string")
    entered = spark.createDataFrame([(3, "PROM", " 77 ", " mine_shop "), (3, "exist", "1", "one")], "workspace long, marketplace string, external_id string, slug string")
    owners = offers.owner_identity(queries, entered, own=())
    got = {r["offer_ord"]: r for r in offers.from_products(spark.createDataFrame(rows, PRODUCT), queries, owners).collect()}
    assert sorted(got) == [1, 9, 10]
    assert (got[1]["price"], got[1]["stock"], got[1]["condition"], got[1]["is_analog"]) == (D("1000.50"), "out_of_stock", "new", False)
    assert (got[9]["currency"], got[9]["is_analog"], got[9]["stock"]) == ("USD", True, None)
    assert got[10]["title"] == "AB-123456"
    assert offers.owner_identity(queries, entered.limit(0)).first()["seller_ids"] == sorted(i for i, _ in vocab.OWN_SELLERS)


def test_stages_move_offers_once(spark):
    """Anchors, currencies and ranks are windows over one exchange by query; offers are neither joined with themselves nor gathered in lists."""
    o = t.offers(spark, "/root/testdata/sf0.001")
    said = spark.createDataFrame([(1, 0, "ok")], "query_id long, position int, verdict string")
    photos = spark.createDataFrame([("u", "used")], "url string, verdict string")
    for name, df, most in (
        ("single_currency", offers.single_currency(o), 1), ("drop_implausible", offers.drop_implausible(o), 1), ("verify_apply", offers.verify_apply(o, said), 1), ("stats", market.stats(o, "query_id"), 2),
        ("photo_apply", offers.photo_apply(o, photos), 2), ("levels", market.levels(o), 2),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and ("query_id" in line)]
        of_offers = [line for line in moved if "_n" not in line]
        assert len(of_offers) <= most + 2, (name, plan)  # the verdicts' own exchanges are among them
        assert "collect_list(price" not in plan, name


def test_levels_are_the_two_statistics(spark):
    o = t.fine_offers(spark, "/root/testdata/sf0.001").cache()
    both = market.levels(o)
    columns = ["offers_total", "strong_total", "min_price", "median_price", "max_price", "recommended_price"]
    assert sorted(map(str, both.where("NOT of_source").select("query_id", *columns).collect())) == sorted(map(str, market.stats(o, "query_id").select("query_id", *columns).collect()))
    assert sorted(map(str, both.where("of_source").select("query_id", "source", *columns).collect())) == sorted(map(str, market.stats(o, "query_id", "source").select("query_id", "source", *columns).collect()))


def test_report_moves_offers_once(spark):
    """A report's statistics are those of `stats`, null sources and prices included, and nothing but the offers is shuffled."""
    odd = make(spark, {"price": 1}, {"price": 5, "source": None, "confidence": None}, {"price": 7, "query_id": 2, "confidence": 0.5}).withColumn("price", F.when(F.col("price") != 1, F.col("price")))
    o = t.fine_offers(spark, "/root/testdata/sf0.001").withColumn("seller", F.col("seller").cast("string")).select(*odd.columns).unionByName(odd)
    got = market.report(o)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    columns = market.stats(o, "query_id").columns
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, market.stats(o, "query_id").collect()))
    of_source = {(r["query_id"], r["source"]): r for r in market.stats(o, "query_id", "source").collect()}
    for r in got.collect():
        for s in json.loads(r["report"])["sources"]:
            one = of_source[r["query_id"], s.get("source")]
            assert (s["offers_total"], len(s["offers"])) == (one["offers_total"],) * 2
            assert [s.get(f"{c}_price") for c in ("min", "median", "max")] == [None if one[f"{c}_price"] is None else str(one[f"{c}_price"]) for c in ("min", "median", "max")]


def test_photos_mark_offers_once(spark):
    """Offers are read and marked once, not again for the verdicts' join; of several verdicts on a url the last in order counts, null urls have none."""
    o = t.fine_offers(spark, "/root/testdata/sf0.001")
    photos = o.select("url", F.when(F.col("seller") % 2 == 0, "used").otherwise("unsure").alias("verdict")).distinct().toPandas()
    photos = spark.createDataFrame([*photos.itertuples(index=False, name=None), (None, "used")], "url string, verdict string")
    got = offers.photo_apply(o, photos)
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    asked = {(r["query_id"], r["url"]): r["seller"] for r in offers.photo_pick(o).collect()}
    used = {(r["query_id"], r["url"]) for r in got.where("condition = 'used'").collect()}
    assert used and used <= {k for k, seller in asked.items() if seller % 2 == 0}


def test_own_shops_are_looked_up_as_rows(spark):
    """No list of a workspace's shops is searched for each offer, or made for each query."""
    cols = "query_id long, workspace long, seller_id string, seller_slug string, url string, source_url string"
    rows = [(1, 0, "7", None, "https://a.ua/p1-x", ""), (2, 0, " 8 ", " SHOP ", "https://a.ua/p2-x", ""), (3, 0, None, None, "https://s-cs7.prom.ua/p3-x", ""), (4, 0, "8", None, "https://a.ua/p4-x", "https://b.ua/p4-y"), (5, 0, "8", None, None, None), (6, 9, "7", None, "https://a.ua/p6-x", ""), (7, None, "7", None, "https://a.ua/p7-x", "")]
    owners = spark.createDataFrame([(0, ["4", "7"], ["shop"]), (1, ["8"], [])], "workspace long, seller_ids array<string>, seller_slugs array<string>")
    got = offers.drop_own_products(spark.createDataFrame(rows, cols), owners)
    assert got.columns == [c.split()[0] for c in cols.split(", ")]
    assert sorted(r["query_id"] for r in got.collect()) == [5, 6, 7]
    assert "array_contains" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_owners_of_queries(spark):
    q = spark.createDataFrame([(1, 0, " 5", "Z", "4", None), (2, 0, "4", None, None, "a"), (3, 9, "b", None, "a", None), (4, None, None, None, None, None)], "query_id long, workspace long, seller_id string, seller_slug string, owner_seller_id string, owner_seller_slug string")
    owners = spark.createDataFrame([(0, ["9", "4"], ["a", "c"])], "workspace long, seller_ids array<string>, seller_slugs array<string>")
    got = offers.query_owners(q, owners)
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == {1: (["4", "5", "9"], ["a", "c", "z"]), 2: (["4", "9"], ["a", "c"]), 3: (["a", "b"], []), 4: ([], [])}
    assert "array_sort(" not in got._jdf.queryExecution().optimizedPlan().toString(), "a sort by a compared lambda for each query"


@pytest.mark.parametrize("name", ["code_by_rarest_gram", "code_inside_title", "market_source", "web_source"])
def test_nothing_that_grows_is_broadcast(spark, name):
    """Tables made of few columns look small; as many rows as queries, texts or grams don't go through the driver."""
    from pricelark import catalogue

    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    kept = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "[workspace#" not in line and "LeftAnti" not in line]  # shops of a workspace may be
    assert not kept


def test_verdicts_meet_their_lists(spark):
    """Offers of the second pass stay where their list's window put them; answers given twice, out of range or empty count as before (F19)."""
    w = Window.partitionBy("query_id").orderBy("price")
    offers_ = spark.range(60).select((F.col("id") % 2).alias("query_id"), F.col("id").alias("price"))
    picked = offers_.withColumn("position", F.row_number().over(w) - 1)
    say = lambda *x: '{"verdicts": [' + ", ".join(f'{{"index": {i}, "verdict": "{v}"}}' for i, v in x) + "]}"
    said = spark.createDataFrame([(0, 0, say((1, "ok"), (12, "drop"))), (0, 0, say((1, "drop"), (1, "unsure"))), (0, 1, say((12, "ok"))), (1, 1, say((11, "drop"))), (1, 2, "?"), (2, 0, say((0, "ok")))], "query_id long, chunk int, response string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = models.verify_verdicts(picked, said)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {(r["query_id"], r["position"]): r["verdict"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {**{(0, p): "unsure" for p in range(12)}, (0, 1): "unsure", **{(1, p): "unsure" for p in range(12, 24)}, (1, 23): "drop"}
    assert not [x for x in plan.splitlines() if "Exchange" in x and "chunk" in x]


def test_legacy_medians_share_a_sort(spark):
    """Medians of strong prices and of all come from one order of prices (F17)."""
    rows = [(q, "a", D(p), c) for q, p, c in ((1, 5, 0.9), (1, 3, 0.9), (1, 4, 0.1), (1, 9, 0.8), (1, 9, 0.1), (2, 7, 0.9), (2, 1, 0.1), (2, 4, 0.2))]
    out = market.legacy_stats(spark.createDataFrame([*rows, (2, "a", None, 0.9)], "query_id int, source string, price decimal(14,2), confidence double"), "query_id")
    assert out._jdf.queryExecution().executedPlan().toString().count(" Sort [") == 1
    got = {r["query_id"]: (r["strong_total"], r["min_price"], r["median_price"], r["max_price"]) for r in out.collect()}
    assert got == {1: (3, 3, 5, 9), 2: (1, 1, 4, 7)}


def test_currency_and_median_share_a_sort(spark):
    """One order of currency and price serves both stages (F18); the first currency's prices are no outliers of the other's."""
    rows = [{"price": p, "currency": c} for p, c in ((100, "UAH"), (110, "UAH"), (120, "UAH"), (2000, "UAH"), (1, "XXX"), (3, "XXX"))]
    out = offers.collect(make(spark, *rows), t.rates(spark))
    assert out._jdf.queryExecution().executedPlan().toString().count(" Sort [") == 1
    assert sorted(int(r["price"]) for r in out.collect()) == [100, 110, 120]


def test_queries_of_one_list_lie_together(spark, tmp_path):
    """However many queries share a list of shops, it is made and kept once or a few times, and no query is lost (F2)."""
    shops = [f"{i:06d}" for i in range(1500)]
    owners = spark.createDataFrame([(0, shops, shops[:9])], "workspace long, seller_ids array<string>, seller_slugs array<string>")
    asked = [(i, 0, f"own-{i % 30}") for i in range(1800)] + [(None, 0, "own-1"), (5, 0, "own-5"), (7, 3, None), (8, None, "x")]
    got = offers.query_owners(spark.createDataFrame(asked, "query_id long, workspace long, seller_id string"), owners)
    joined = got.select("query_id", F.array_join("seller_ids", ",").alias("seller_ids"))
    want = {(q, ",".join((shops if w == 0 else []) + ([s] if s else []))) for q, w, s in asked}
    rows = [tuple(r) for r in joined.collect()]
    assert len(rows) == len(asked) and set(rows) == want
    steps = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode" in line]
    assert steps and not any("*(" in line for line in steps), "all rows of a list would be held at once"
    plain = sum(len(ids) for _, ids in rows)
    joined.write.option("parquet.dictionary.page.size", 131072).option("compression", "none").parquet(f"{tmp_path}/owners")
    assert sum(p.stat().st_size for p in (tmp_path / "owners").glob("*.parquet")) < plain / 4
