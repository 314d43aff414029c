"""Merges and the catalogue on small cases."""

from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from pricelark import catalogue
from pricelark.operators import catalog, jobs, merge
from pricelark.operators.catalog import CatalogFilter

STORED = "store_id int, external_id long, name string, url string, sku string, brand string, currency string, price decimal(14,2), is_available boolean, last_seen_at timestamp"
IN = STORED.replace(", last_seen_at timestamp", ", ord int")
NOW = datetime(2026, 1, 1)


def test_upsert(spark):
    old = datetime(2025, 1, 1)
    stored = spark.createDataFrame([(1, 1, "a", "u", "s", "b", "UAH", D(10), True, old), (1, 2, "z", "u", "s", "b", "UAH", D(10), True, old)], STORED)
    new = spark.createDataFrame([(1, 1, "x", "u", "", None, " usd", D(0), None, 0), (1, 1, "y", "u", "", None, " usd", D(0), None, 1), (1, 3, "n", "u3", None, None, None, D(5), False, 0), (1, None, "bad", "u", None, None, None, D(5), False, 0)], IN)
    rows = {r["external_id"]: r for r in merge.upsert(stored, new, F.lit(NOW)).collect()}
    assert set(rows) == {1, 2, 3}
    assert (rows[1]["name"], rows[1]["sku"], rows[1]["brand"], rows[1]["currency"], rows[1]["price"], rows[1]["is_available"], rows[1]["last_seen_at"]) == ("y", "s", "b", "USD", D("10.00"), True, NOW)
    assert rows[2]["last_seen_at"] == old and rows[3]["currency"] == "UAH"
    again = merge.upsert(merge.upsert(stored, new, F.lit(NOW)), new, F.lit(NOW))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.values()))
    seen = merge.observed(stored, new, F.lit(NOW)).collect()
    assert [(r["external_id"], r["price"]) for r in seen] == [(3, D("5.00"))]


def test_maps(spark):
    df = spark.sql("SELECT map('a', '1', 'b', '2') AS s, map('b', '', 'c', '3', 'a', '9') AS i")
    assert df.select(merge.merge_maps(F.col("s"), F.col("i"))).first()[0] == {"a": "9", "b": "2", "c": "3"}


OVER = "listing_id long, name string, sku string, brand string, price decimal(14,2), is_available boolean, is_deleted boolean, updated_at timestamp"


def test_tombstones(spark):
    o = spark.createDataFrame([(1, None, None, None, None, None, True, NOW), (2, "n", None, None, None, None, True, NOW), (3, "m", None, None, None, None, False, NOW)], OVER)
    ids = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    back = {r["listing_id"]: r["is_deleted"] for r in merge.undelete(o, ids).collect()}
    assert back == {2: False, 3: False}
    gone = {r["listing_id"]: r["is_deleted"] for r in merge.soft_delete(o, ids).collect()}
    assert gone == {1: True, 2: True, 3: False, 9: True}


def _catalog(spark):
    listings = spark.createDataFrame(
        [(1, 1, "bolt", "AB-1", "x", D(10), True, "u", NOW), (2, 1, "bolt b", "ab1 KEMP", "x", D(5), None, "u", NOW), (3, 2, "nut", None, "x", None, False, "u", NOW), (4, 9, "other", "q", "x", D(1), True, "u", NOW), (5, 2, "gone", "g", "x", D(1), True, "u", NOW)],
        "id long, store_id int, name string, sku string, brand string, price decimal(14,2), is_available boolean, url string, last_seen_at timestamp",
    )
    over = spark.createDataFrame([(2, "renamed", "AB1", None, None, None, None, NOW), (5, None, None, None, None, None, True, NOW)], OVER)
    stores = spark.createDataFrame([(1, "owned"), (2, "competitor")], "store_id int, kind string")
    return listings, over, stores


def test_catalog(spark):
    c = catalog.effective(*_catalog(spark))
    rows = {r["id"]: r for r in c.collect()}
    assert set(rows) == {1, 2, 3}
    assert (rows[2]["name"], rows[2]["price"], rows[2]["brand"]) == ("renamed", None, None), "an override's nulls count"
    reps = {r["id"]: r["group_size"] for r in catalog.representatives(c).collect()}
    assert reps == {1: 2, 3: 1}, "priced before unpriced"
    assert [r["id"] for r in catalog.page(c, CatalogFilter(query="renamed")).collect()] == [], "groups are ranked before filters"
    assert [r["id"] for r in catalog.page(c, CatalogFilter(store_ids=[1], order="price_desc")).collect()] == [1, 2]
    assert [r["id"] for r in catalog.page(c, CatalogFilter(available=False)).collect()] == [3]
    listings, over, stores = _catalog(spark)
    sib = catalog.siblings(listings, over, stores, listings.where("id = 1")).collect()
    assert [(r["id"], r["price"]) for r in sib] == [(2, D("5.00"))]


@pytest.mark.parametrize("bad", [{"query": "x" * 201}, {"price_min": -1}, {"source": "ftp"}, {"limit": 0}, {"offset": -1}, {"order": "id"}, {"store_ids": list(range(51))}])
def test_filter_validation(bad):
    with pytest.raises(ValueError):
        CatalogFilter(**bad)


def test_jobs(spark):
    checks = spark.createDataFrame([(1, i, i) for i in range(32)], "workspace_id int, check_id int, at int")
    assert jobs.quota(checks).where("NOT allowed").count() == 2
    runs = spark.createDataFrame([(1, 1, "queued", None, 5), (1, 2, "queued", None, 3), (2, 3, "running", "t", 1), (2, 4, "queued", None, 2)], "workspace_id int, run_id int, status string, task_id string, created_at int")
    assert [(r["workspace_id"], r["run_id"]) for r in jobs.queue_head(runs).collect()] == [(1, 2)]


def test_siblings_of_all_listings(spark):
    """Every listing is asked for, and each gets its siblings' order by price without itself."""
    rows = [(r["of_id"], r["id"], r["place"]) for r in catalogue.queries()["siblings"](spark, "/root/testdata/sf0.001").collect()]
    assert {(b, a) for a, b, _ in rows} == {(a, b) for a, b, _ in rows}
    assert any(a % 20 for a, _, _ in rows)
    for of in {a for a, _, _ in rows}:
        places = sorted(p for a, _, p in rows if a == of)
        assert places == list(range(1, len(places) + 1))
