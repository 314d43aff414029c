"""Scalar functions against fixed cases."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from pricelark.operators import market
from pricelark.functions import money, text, urls, vocab


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column).collect()]


def test_tokens_and_similarity(spark):
    assert values(spark, ["Фара для BMW і X", None], text.name_tokens(F.col("x"))) == [["фара", "bmw"], []]
    sim = text.token_similarity(F.split("x", " "), F.split("y", " "))
    assert values(spark, [("a b", "a b c d"), ("a b", "b a")], sim, "x string, y string") == [0.75, 1.0]
    empty = F.filter(F.split("x", " "), lambda t: t != "")
    assert values(spark, [""], text.token_similarity(empty, empty)) == [0.0]


def test_laterality(spark):
    c = text.laterality_conflict(text.name_tokens(F.col("x")), text.name_tokens(F.col("y")))
    rows = [("фара ліва", "фара права"), ("фара ліва", "фара"), ("бампер передній", "бампер задній"), ("фара левая", "фара ліва")]
    assert values(spark, rows, c, "x string, y string") == [True, False, True, False]


def test_numbers(spark):
    got = values(spark, ["062 121 350", " w914/2 ", "12", "---", None, "Audi 100", "PEUGEOT206"], text.normalize_oem(F.col("x")))
    assert got == ["062121350", "W914/2", None, None, None, None, None]
    models = values(spark, ["AUDI100", "VITOW638", "RENAULT19", "VKBA6522", "JHQ047", "8E0513033"], text.is_car_model(F.col("x")))
    assert models == [True] * 3 + [False] * 3
    assert values(spark, ["1.6-1.8-2.0", "94-06", "8E0 513 033", "Ford"], text.part_number(F.col("x"))) == [None, None, "8E0513033", None]
    assert values(spark, ["77643,93818439,8E0513033,77643"], text.order_numbers(F.split("x", ","))) == [["8E0513033", "77643", "93818439"]]
    assert values(spark, ["ab-12 KEMP", "---"], text.group_key(F.col("x"), F.lit(7))) == ["AB12", "7"]


def test_prices(spark):
    got = values(spark, ["1 234,56", "1,234.56", "1.234", "-15%", "x", None, "2.345", "2.355"], money.parse_price(F.col("x")))
    assert got == [D("1234.56"), D("1.23"), D("1.23"), D("-15.00"), None, None, D("2.34"), D("2.36")]
    got = values(spark, ["від 365 ₴ x 6 ; від 365 ₴", "від 199 грн/міс від", "Ціна 2190 грн. Або від 365 ₴ x 6", "Купити за 204 грн"], money.price_from_text(F.col("x")))
    assert got == [None, None, D("2190.00"), D("204.00")]


@pytest.mark.parametrize(("prices", "median"), [(["100", "200", "300"], "200.00"), (["3926.51", "3926.52"], "3926.52"), (["180", "240"], "210.00"), ([], None)])
def test_median(spark, prices, median):
    rows = [(1, "prom", D(p), 0.9) for p in prices] + [(1, "prom", D("5"), 0.5), (1, "web", D("7"), 0.5)]
    got = market.stats(spark.createDataFrame(rows, "query_id long, source string, price decimal(14,2), confidence double"), "query_id").first()
    assert (got.median_price, got.strong_total, got.offers_total, got.sources_total) == (median and D(median), len(prices), len(prices) + 2, 2)


def test_recommended(spark):
    df = spark.createDataFrame([(D("100"), 3), (D("0.30"), 3), (D("25"), 3), (D("75"), 3), (D("500"), 2)], "x decimal(14,2), n int")
    assert [r[0] for r in df.select(money.recommended(F.col("x"), F.col("n"))).collect()] == [94, 1, 24, 70, None]


def test_gates(spark):
    used = ["Амортизатор б/у", "стартер Б.В", "двигун з розборки", "контрактний двигун, контрактний", "second hand", "вживаний"]
    fresh = ["ЕБУ двигуна Bosch", "Бушинг стабілізатора", "бампер", "буксир"]
    assert values(spark, used + fresh, text.is_used(F.col("x"))) == [True] * 6 + [False] * 4
    stock = ["Немає в наявності", "не в наявності", "В наявності", "Під замовлення", "Отправка товара завтра из г. Киев", "Отправка товара через 5 дней из г. Киев", "not_avail", None]
    assert values(spark, stock, text.stock_of(F.col("x"))) == ["out_of_stock", "out_of_stock", "in_stock", "on_order", "in_stock", None, "out_of_stock", None]
    request = values(spark, [("Фара, ціна договірна", None), ("Фара", "Дзвоніть, уточнюйте наявність"), ("Фара", "договірна")], text.is_price_on_request(F.col("x"), F.col("y")), "x string, y string")
    assert request == [True, False, True]


@pytest.mark.parametrize(
    ("numbers", "name", "brand", "title", "offer_brand", "score"),
    [
        (["7700308222"], "Радіатор охолодження Kangoo", "KEMP", "Радіатор охолодження 77 00 308 222 Kangoo", None, 0.9),
        (["7700308222"], "Радіатор охолодження Kangoo", "Bosch", "Радіатор охолодження Kangoo 7700308222", "Other", 0.7),
        (["7700308222"], "Радіатор охолодження Kangoo", None, "Фільтр масляний", None, 0.0),
        (["1300115"], "Радіатор", None, "Пакети для сміття 1300115", None, 0.0),
        (["1300115"], "Радіатор", None, "Радіатор 1300115", None, 0.9),
        (["93740944"], "Радіатор", None, "Щось 93740944", None, 0.9),
        (["93740944"], "Фара ліва", None, "Фара права 93740944", None, 0.0),
    ],
)
def test_match_score(spark, numbers, name, brand, title, offer_brand, score):
    df = spark.createDataFrame([(numbers, name, brand, title, offer_brand)], "n array<string>, name string, brand string, title string, ob string")
    bare = F.regexp_replace("title", "7700308222", "")
    got = df.select(text.match_score(F.col("n"), F.col("name"), F.col("brand"), F.col("title"), name=F.trim(bare), brand=F.col("ob"))).first()[0]
    assert got == score


def test_urls(spark):
    u = F.col("x")
    slug, seller = urls.export_seller(u)
    assert values(spark, ["https://kemp-cs2847093.prom.ua/p1-a.html", "https://u@My_shop-cs12.prom.ua:443/p1", "https://prom.ua/c1-a.html", "nonsense", None], F.struct(slug, seller)) == [("kemp", "2847093"), ("my_shop", "12"), (None, None), (None, None), (None, None)]
    sid, sslug, lang = urls.store_seller(u)
    assert values(spark, ["https://prom.ua/ua/c12-some-shop.html", "https://x.ua/c12-a.html"], F.struct(sid, sslug, lang)) == [("12", "some-shop", "ua"), (None, None, None)]
    same = urls.same_product(F.col("x"), F.col("y"))
    rows = [("https://prom.ua/ua/p12-a.html", "https://prom.ua/p12-b.html"), ("https://a.ua/x/", "https://www.a.ua/ua/x"), ("https://a.ua/x", "https://a.ua/y"), (None, "https://a.ua")]
    assert values(spark, rows, same, "x string, y string") == [True, True, False, False]
    assert values(spark, ["https://www.kemp.ua/a", "https://shop.kemp.ua", "https://notkemp.ua"], urls.is_own_domain(urls.host(u))) == [True, True, False]
    assert values(spark, ["http://schema.org/OutOfStock/", "https://schema.org/InStock"], urls.schema_stock(u)) == ["out_of_stock", "in_stock"]


def test_patterns_are_tried_at_their_first_letters(spark):
    """Patterns under their first letters find what they find one after the other; alternatives outside of brackets stay as they are (F1)."""
    said = ["", None, "б/у", "Б - в", "клубу", "(БУ)", "абу б", "вживана", "used", "unused", "second hand", "ціна по запиту", "цена  по запросу", "подзвоніть", "дзвоніть!", "Донор", "під  відновлення", "нова", "оновлена", "new", "anew", "price on request", "контрактний", "після ДТП"]
    df = spark.createDataFrame([(x,) for x in said], "t string")
    for patterns in (vocab.USED, vocab.ON_REQUEST, vocab.ON_REQUEST_STOCK, vocab.NEW, vocab.IN_STOCK, (r"\bнова|used", r"б"), (r"а?б", r"\bnew")):
        plain = F.coalesce(F.lower("t").rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))
        assert df.where(text.any_of(F.col("t"), patterns) != plain).count() == 0
    assert text._one_of(vocab.USED).startswith("(?=[") and not text._one_of(vocab.IN_STOCK).startswith("(?=[")
