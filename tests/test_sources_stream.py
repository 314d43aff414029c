"""Parsers, file sources, sinks and streams."""

import base64
import gzip
import hashlib
import json
import zipfile
from decimal import Decimal as D

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pricelark.operators import merge
from pricelark.sources import archive, crawl, pages, sinks, xlsx
from pricelark.streaming import observations


def _state(**cache):
    return f'<script>window.ApolloCacheState = {json.dumps({"_FAST_CACHE": cache}, ensure_ascii=False)};</script> tail }}'


RAW = {
    "id": 5, "name": "Фара {ліва} \"x\"", "sku": "A", "price": "0", "priceOriginal": "200", "presence": {"presence": "avail", "isAvailable": True}, "manufacturerInfo": {"name": "Bosch"},
    "newModelId": "m1", "company": {"id": 7, "slug": "s"}, "image": "https://i", "urlText": "fara", "attributes": [{"name": "Код запчастини", "values": [{"value": "312783, 77648805, слово"}]}],
}


def test_listing_pages(spark):
    html = _state(**{"CompanyListingQuery(1)": {"result": {"listing": {"page": {"products": [{"product": RAW}, {}], "total": 40}}}}})
    df = spark.createDataFrame([("u", html), ("v", "<html>"), ("w", _state(Other={}))], "url string, html string")
    (r,) = pages.listing_products(df).collect()
    assert (r["id"], r["total"], r["brand"], r["model_id"], r["seller_id"], r["effective_price"], r["url"]) == (5, 40, "Bosch", "m1", 7, D("200.00"), "https://prom.ua/ua/p5-fara.html")
    assert r["name"] == 'Фара {ліва} "x"' and r["oem_numbers"] == ["312783", "77648805"]
    errors = {x["url"]: x["error"] for x in pages.records(df, "CompanyListingQuery").collect()}
    assert errors["u"] is None and errors["v"] and errors["w"] is None


def test_product_pages(spark):
    html = _state(**{"ProductCardPageQuery": {"result": {"product": RAW, "buyBox": {"companyCount": 3, "minPrice": "10", "maxPrice": 20}}}})
    df = spark.createDataFrame([("u", html), ("w", _state(ProductCardPageQuery={"result": {}}))], "url string, html string")
    rows = {r["page_url"]: r for r in pages.product_pages(df).collect()}
    assert (rows["u"]["seller_count"], rows["u"]["min_price"], rows["u"]["max_price"]) == (3, D("10.00"), D("20.00")) and rows["w"]["error"] == "no product"


def test_structured_price(spark):
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"Product","image":[{"url":"https://i"}],"offers":{"@type":"AggregateOffer","lowPrice":"193","priceCurrency":"грн","availability":"http://schema.org/InStock"}}]}</script>'
    rows = [("a", ld), ("b", '<span itemprop="price">1 250,5 грн</span>'), ("c", '<meta property="og:price:amount" content="77">'), ("d", "none"), ("e", None)]
    got = {r["url"]: (r["price"], r["currency"], r["image"], r["stock"]) for r in pages.structured_prices(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {"a": (D("193.00"), "UAH", "https://i", "in_stock"), "b": (D("1250.50"), "UAH", None, None), "c": (D("77.00"), "UAH", None, None), "d": (None,) * 4, "e": (None,) * 4}


def test_feed(spark):
    row = '<tr data-interactive-feed-item-element="true" data-wh-id="w1" data-is-boost-position="1" %s><td data-type="maker"><b>VAG</b></td><td data-type="code" title="8E0 &amp; 5" href="/part-1/"></td><td title="опис"><span class="ap-feed__table__descr"></span></td><td data-type="delivery" data-city="Київ" data-tooltip-content="в наявності"></td><td data-type="price" data-value="%s"><b data-type="currency">$</b></td></tr>'
    html = '<div class="ap-feed">' + row % ('data-bu="1"', "12.5") + row % ("", "0") + '<a data-token="tok&amp;1">'
    df = spark.createDataFrame([("u", html), ("v", "<html>")], "url string, html string")
    (r,) = pages.feed_offers(df).collect()
    assert (r["maker"], r["code"], r["part_uri"], r["description"], r["city"], r["price"], r["currency"], r["used"], r["boosted"]) == ("VAG", "8E0 & 5", "/part-1/", "опис", "Київ", D("12.50"), "USD", True, True)
    assert {x["url"]: (x["token"], x["error"]) for x in pages.feed_pages(df).collect()} == {"u": ("tok&1", None), "v": (None, "no feed")}


def test_suggestions(spark):
    item = lambda brand, uri: {"Title": f"{brand} x", "Uri": f"/s?uri={uri}", "FoundPart": {"Part": {"Brand": {"Name": brand}}}}
    payload = json.dumps({"Suggestions": [item("China", "%2Fpart-1%2F"), item("VAG/VW", "%2Fpart-2%2F"), item("Zzz", "%2Fcategory%2F")]})
    found = pages.suggestions(spark.createDataFrame([(1, payload), (2, payload), (3, payload)], "query_id int, payload string"))
    assert found.where("query_id = 1").count() == 2
    q = spark.createDataFrame([(1, "vw", None), (2, None, "Фара China"), (3, "Kia", "none")], "query_id int, brand string, name string")
    assert {r["query_id"]: r["part_uri"] for r in pages.pick_suggestion(found, q).collect()} == {1: "/part-2/", 2: "/part-1/"}
    assert pages.pick_suggestion(found, q, fallback=True).count() == 3


def test_web_source(spark):
    results = spark.createDataFrame(
        [(1, 0, "Радіатор Kangoo 7700308222", "https://a.ua/1", "Купити за 204 грн"), (1, 1, "Радіатор Kangoo 7700308222", "https://prom.ua/p", "1 грн"), (1, 2, "Радіатор Kangoo 7700308222", "https://b.com/1", "1 грн"), (1, 3, "Куртка", "https://c.ua", "5 грн"), (1, 4, "Радіатор Kangoo 7700308222", "https://d.ua/2", "")],
        "query_id int, ord int, title string, link string, snippet string",
    )
    q = spark.createDataFrame([(1, ["7700308222"], "Радіатор Kangoo", None, "https://own.ua")], "query_id int, oem_numbers array<string>, name string, brand string, source_url string")
    c = pages.web_candidates(results, q)
    html = '<script type="application/ld+json">{"@type":"Offer","price":193}</script>'
    got = pages.web_offers(c, spark.createDataFrame([("https://d.ua/2", html)], "url string, html string"))
    assert sorted((r["url"], r["price"]) for r in got.collect()) == [("https://a.ua/1", D("204.00")), ("https://d.ua/2", D("193.00"))]


def test_crawl(spark):
    first = spark.createDataFrame([("a", 45, 20, ["1"]), ("b", 20_000, 20, ["7", "8"])], "url string, total long, page_size int, groups array<string>")
    assert sorted((r["url"], r["page"]) for r in pages.crawl_plan(first).collect()) == [("a", 2), ("a", 3), ("b?product_group=7", 1), ("b?product_group=8", 1)]


def _xlsx(path, rows):
    def cell(i, v):
        return "" if v is None else f'<c r="{chr(65 + i)}1" t="inlineStr"><is><t>{v}</t></is></c>'

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="Export Products Sheet" r:id="x1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData>" + "".join("<row>" + "".join(cell(i, v) for i, v in enumerate(r)) + "</row>" for r in rows) + "</sheetData></worksheet>")


def test_xlsx(spark, tmp_path):
    head = ["Код_товару", "Назва_позиції", "Ціна", "Унікальний_ідентифікатор", "Продукт_на_сайті", "Пошукові_запити", "Наявність", "Назва_Характеристики", "Значення_Характеристики", "Назва_Характеристики", "Значення_Характеристики"]
    rows = [head, ["115070", "Фара", "10,5", "1", "https://u", "93818439, audi100", "-", "Код запчастини", "77643", "Код запчастини", "x"], [None] * 11, ["1", "no id", "1", "abc", "u"]]
    _xlsx(tmp_path / "a.xlsx", rows)
    (r,) = xlsx.products(xlsx.read(spark, str(tmp_path / "a.xlsx"))).collect()
    assert (r["id"], r["parsed_price"], r["is_available"], r["oem_numbers"], r["currency"]) == (1, D("10.50"), False, ["115070", "77643", "93818439"], "UAH")


def test_archive(spark, tmp_path):
    body = "<html>так</html>".encode()
    entry = {"requested_url": "u", "status_code": 200, "body": base64.b64encode(gzip.compress(body)).decode(), "body_sha256": hashlib.sha256(body).hexdigest()}
    (tmp_path / "a.json").write_text(json.dumps({"entries": [entry]}))
    assert archive.pages(spark, str(tmp_path / "a.json")).first()[:] == ("u", 200, "<html>так</html>", True)


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"])], "id int, l array<string>")
    sinks.export(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()[:] == ("1", '["a"]')
    sinks.export(df, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).first()["l"] == ["a"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k % 7, i, [100, 100, 200, None][(i // 7) % 4], "UAH", bool(i % 3), i) for i in range(140) for k in [i]]
    df = spark.createDataFrame(rows, "listing_id long, seq long, price_cents long, currency string, is_available boolean, t long").withColumn("observed_at", F.timestamp_seconds("t")).drop("t")
    for part in range(2):
        df.where(f"seq div 70 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = observations.changes(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["seq"] for r in merge.changes(df.withColumnRenamed("price_cents", "price")).collect()}
    assert got == want and got


def test_windows(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, 0), (1, 7, 1800), (1, 9, 4000)], "listing_id long, price_cents long, t long").withColumn("observed_at", F.timestamp_seconds("t"))
    assert sorted((r["n"], r["low"], r["high"]) for r in observations.windowed(df).collect()) == [(1, 9, 9), (2, 5, 7)]


def _crawl(spark, rows):
    """rows: series, page, attempt, ids (None: no catalogue on the page), total."""
    made = []
    for series, page, attempt, ids, total in rows:
        state = {"CompanyListingQuery(x)": {"result": {"listing": {"page": {"products": [{"product": {**RAW, "id": i}} for i in ids], "total": total}}}}} if ids is not None else {}
        made.append((series, page, attempt, _state(**state)))
    return crawl.listing_pages(spark.createDataFrame(made, "series string, page int, attempt int, html string"))


def test_catalogues_end_at_an_empty_or_repeated_page(spark):
    read = _crawl(spark, [("a", 1, 0, [1, 2], None), ("a", 2, 0, [3, 4], None), ("a", 3, 0, [1, 2], None), ("a", 4, 0, [5], None), ("b", 1, 0, [1, 2], None), ("b", 2, 0, [2, 1], None), ("b", 3, 0, [], 0), ("b", 4, 0, [9], None), ("c", 1, 0, [], 0), ("c", 2, 0, [7], None), ("c", 3, 0, [7], None)])
    got = sorted((r["series"], r["page"]) for r in crawl.until_end(read, "series").collect())
    assert got == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("c", 2)]  # the order of ids counts; a first page is never an end


def test_a_page_without_a_catalogue_is_loud(spark):
    read = _crawl(spark, [("a", 1, 0, [1], 9), ("a", 2, 0, None, None), ("a", 2, 1, [2], 9), ("a", 3, 0, None, None), ("a", 3, 1, None, None)])
    pages_ = crawl.settled(read, "series")
    with pytest.raises(Exception, match="no catalogue on page 3 of a"):
        crawl.strict(pages_, "series").select("page").collect()
    assert crawl.strict(pages_.where("page < 3"), "series").count() == 2
    seen = Observation()
    good, bad = crawl.parted(pages_, seen)
    assert sorted(r["page"] for r in good.select("page").collect()) == [1, 2]
    assert seen.get == {"pages": 3, "unreadable": 1}
    assert [(r["page"], r["error"]) for r in bad.select("page", "error").collect()] == [(3, "neither a total nor products")]


def test_feeds_are_followed_by_pointers(spark):
    tok = lambda i: json.dumps({"n": i, "a": 1})
    start = spark.createDataFrame([("x", tok(1)), ("y", tok(50)), ("z", None), ("w", "no json"), ("loop", tok(90)), ("gone", tok(404))], "q string, token string")
    links = [(json.dumps({"a": 1, "n": i}, separators=(",", ":")), tok(i + 1), None) for i in range(1, 20)] + [(tok(50), tok(51), None), (tok(51), tok(52), "401"), (tok(52), None, None), (tok(90), tok(90), None)]
    more = spark.createDataFrame(links, "token string, next string, error string")
    for most, want in ((1, {}), (2, {"x": 1, "y": 1, "loop": 1}), (4, {"x": 3, "y": 1, "loop": 3}), (7, {"x": 6, "y": 1, "loop": 6}), (40, {"x": 19, "y": 1, "loop": 39})):
        got = crawl.follow(start, more, most).collect()
        assert {q: max(r["page"] for r in got if r["q"] == q) for q in {r["q"] for r in got}} == want
        assert len(got) == sum(want.values())  # every page once, in a row


def test_feeds_read_each_table_of_links_once(spark):
    """Every step joins the same links: pages aren't parsed again for each."""
    start = spark.createDataFrame([("x", "1")], "q string, token string")
    more = spark.createDataFrame([(str(i), str(i + 1), None) for i in range(1, 9)], "token string, next string, error string")
    got = crawl.follow(start, more.mapInArrow(lambda batches: batches, more.schema), 4)
    assert sorted(r["page"] for r in got.collect()) == [1, 2, 3]
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 1 and plan.count("ReusedExchange") == 2


def test_pages_are_held_in_slices():
    """However large an Arrow batch is, a worker holds ``HELD`` pages as Python texts at most (F20)."""
    import pyarrow as pa

    from pricelark.sources import crawl

    cut = list(crawl._slices([pa.RecordBatch.from_pydict({"html": [str(i) for i in range(n)]}) for n in (600, 0, 1)]))
    assert max(b.num_rows for b in cut) <= crawl.HELD and [x for b in cut for x in b.column("html").to_pylist()] == [*map(str, range(600)), "0"]


def test_feed_pages_are_read_once(spark):
    """First pages and continuations are read once each, for their links and their rows (F1)."""
    from pricelark.operators import composed

    tok = lambda q, i: json.dumps({"q": q, "n": i})
    row = '<tr data-interactive-feed-item-element="true" data-wh-id="w"><td data-type="maker"><b>VAG</b></td><td data-type="code" title="%s" href=""></td><td data-type="price" data-value="5"><b data-type="currency">$</b></td></tr>'
    page = lambda code, token: '<div class="ap-feed">' + row % code + f'<a data-token="{token.replace(chr(34), "&quot;")}">'
    found = spark.createDataFrame([(q, f"/part-{q}/") for q in range(3)], "query_id int, part_uri string")
    first = spark.createDataFrame([(f"/part-{q}/", page(f"{q}-0", tok(q, 0))) for q in range(3)], "url string, html string")
    more = spark.createDataFrame([(tok(q, n), page(f"{q}-{n + 1}", tok(q, n + 1)), "401" if (q, n) == (1, 1) else None) for q in range(3) for n in range(6)], "token string, html string, error string")
    rows = composed.feed_rows(found, first, more)
    assert sorted((r["query_id"], r["page"], r["code"]) for r in rows.collect()) == [(q, n, f"{q}-{n}") for q in range(3) for n in range(4) if q != 1 or n < 2]
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 2


def test_feed_rows_are_dealt_out_once(spark):
    """Rows that pass the gates move once, by query: the dedupe, part numbers, the best and the first number need no more (F3)."""
    from pricelark.operators import composed

    row = '<tr data-interactive-feed-item-element="true"><td data-type="maker">%s</td><td data-type="code" title="%s" href=""></td><td data-type="price" data-value="%s"><b data-type="currency">$</b></td></tr>'
    page = '<div class="ap-feed">' + "".join(row % r for r in (("A", "x 1", 9), ("A", "X1", 5), ("B", "x1", 7), ("", "y", 4), ("A", "y", 0)))
    said = lambda n: json.dumps({"Suggestions": [{"Title": "t", "Uri": f"/s?uri=%2Fpart-{n}%2F"}]})
    queries = spark.createDataFrame([(1, ["x-1", "z"], False), (2, [], False), (3, ["q", "w"], None)], "query_id long, oem_numbers array<string>, manual boolean").selectExpr("*", "string(null) AS brand", "string(null) AS name")
    suggested = spark.createDataFrame([(1, 0, said(1)), (1, 1, said(2)), (2, 0, said(1)), (3, 0, said(9)), (3, 1, said(2))], "query_id long, rank int, payload string")
    first = spark.createDataFrame([("/part-1/", page + '<a data-token="1">'), ("/part-2/", page.replace("x", "z"))], "url string, html string")
    got = composed.feed_source(queries, suggested, first, spark.createDataFrame([("1", '<div class="ap-feed">' + row % ("B", "Z", 99), None)], "token string, html string, error string"))
    rows = sorted((r["query_id"], r["rank"], r["offer_ord"], r["title"], str(r["price"]), r["condition"], r["is_analog"]) for r in got.collect())
    assert rows == [(1, 0, 1, "A X1", "5.00", "new", False), (1, 0, 2, "B x1", "7.00", "new", False), (1, 0, 3, "B Z", "99.00", "new", False), (1, 0, 4, "y", "4.00", "new", True), (3, 1, 1, "y", "4.00", "new", True), (3, 1, 2, "A X1", "5.00", "new", True), (3, 1, 3, "B z1", "7.00", "new", True), (3, 1, 4, "A z 1", "9.00", "new", True)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan[: plan.index("Union")].count("Exchange ") == 1
