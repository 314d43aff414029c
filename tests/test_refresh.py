"""Verdict caches, chunked refreshes and merges of touched files."""

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricelark.operators import merge
from pricelark.streaming import folders, refresh, verdicts
from tests.test_sources_stream import RAW, _state

START = datetime.datetime(2026, 1, 1)


def plain_cache(requests):
    """What the cache answers, request by request."""
    out, state = {}, {}
    for url, seq, at, answer in sorted(requests, key=lambda r: (r[2], r[1])):
        verdict, ends = state.get(url, (None, None))
        cached = ends is not None and at < ends
        if not cached:
            verdict, ends = answer, None if answer is None else at + datetime.timedelta(days=1 if answer == "unsure" else 7)
            state[url] = verdict, ends
        out[seq] = (url, verdict, cached, ends)
    return out


def test_verdict_stream_equals_plain_at_any_clock(spark, tmp_path):
    rng = random.Random(2)
    requests = [(f"u{rng.randrange(12)}", i, START + datetime.timedelta(hours=i * 2, seconds=rng.randrange(3600)), rng.choice(["used", "not_used", "unsure", "unsure", None])) for i in range(300)]
    requests += [("u1", 1000, requests[7][2], "used"), ("u1", 1001, requests[7][2], None)]  # ties in time
    frame = spark.createDataFrame(requests, "url string, seq long, at timestamp, answer string")
    for k in range(4):  # micro-batches in the order of time
        frame.where(f"at >= timestamp'{START}' + interval {k * 150} hours AND at < timestamp'{START}' + interval {(k + 1) * 150} hours").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with folders.setting(spark, verdicts.STORE, verdicts.ROCKS):
        source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        verdicts.answered(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        batch = {r.seq: (r.url, r.verdict, r.cached, r.expires_at) for r in verdicts.answered(frame).collect()}
    out = spark.read.parquet(str(tmp_path / "out"))
    want = plain_cache(requests)
    assert {r.seq: (r.url, r.verdict, r.cached, r.expires_at) for r in out.collect()} == want == batch
    for hours in (0, 30, 100, 299, 500, 700, 900):
        now = START + datetime.timedelta(hours=hours)
        live = {}
        for url, verdict, _, ends in (want[s] for _, s, at, _ in sorted(requests, key=lambda r: (r[2], r[1])) if at <= now):
            live[url] = (verdict, ends)
        got = {r.url: r.verdict for r in verdicts.live(out, F.lit(now)).collect()}
        # A url whose model failed last has no entry of its own, but an older one may live on only if it hadn't ended: it had.
        assert got == {u: v for u, (v, e) in live.items() if e is not None and e > now}


def _pages(spark, n, bad=()):
    html = lambda i: "<html>" if i in bad else _state(ProductCardPageQuery={"result": {"product": {**RAW, "id": i}}})
    return spark.createDataFrame([(i, html(i)) for i in range(n)], "listing_id long, html string")


def test_a_repeated_chunk_is_written_once(spark, tmp_path):
    root = str(tmp_path)
    write = refresh.chunk_writer(root, F.col("error").isNotNull(), refresh.read_products)
    write(_pages(spark, 6, {2, 4}), 0)
    write(_pages(spark, 6, {2, 4}), 0)  # the same batch again
    files = sorted(p.name for p in (tmp_path / "rows").rglob("*.parquet"))
    write(_pages(spark, 4), 1)
    assert set(files) <= {p.name for p in (tmp_path / "rows").rglob("*.parquet")}
    assert sorted((r.batch_id, r.done, r.failed) for r in refresh.log(spark, root).collect()) == [(0, 6, 2), (1, 4, 0)]
    assert refresh.rows(spark, root).count() == 10
    # A batch that broke off before its log doesn't show, and is whole once it is run again.
    refresh.read_products(_pages(spark, 2)).write.parquet(f"{root}/rows/batch_id=2")
    assert refresh.rows(spark, root).count() == 10
    write(_pages(spark, 5, {0}), 2)
    assert refresh.rows(spark, root).where("batch_id = 2").count() == 5
    p = refresh.progress(refresh.log(spark, root)).first()
    assert (p.total, p.done, p.refreshed, p.failed, p.message) == (15, 15, 12, 3, "Не вдалося оновити 3 з 15 товарів")
    assert refresh.progress(refresh.log(spark, str(tmp_path / "none"))).first()[:] == (0, 0, 0, 0, None)


def test_numbers_come_from_the_page_only_where_there_are_none(spark):
    listings = spark.createDataFrame([(0, ["A1"]), (1, []), (2, None), (3, []), (9, None)], "id long, oem_numbers array<string>")
    got = {r.id: r.oem_numbers for r in refresh.backfill(listings, refresh.read_products(_pages(spark, 4, {3}))).collect()}
    assert got == {0: ["A1"], 1: ["312783", "77648805"], 2: ["312783", "77648805"], 3: [], 9: []}


def _files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path, now = str(tmp_path / "t"), F.lit("2026-01-01 00:00:00").cast("timestamp")
    stored = spark.range(400).select(F.lit("s").alias("store_id"), F.col("id").cast("string").alias("external_id"), F.concat(F.lit("n"), "id").alias("name"), F.lit("u").alias("url"), F.lit("k").alias("sku"), F.lit("b").alias("brand"), F.lit("UAH").alias("currency"),
                                    F.lit(10).cast("decimal(14,2)").alias("price"), F.lit(True).alias("is_available"), F.lit("2025-01-01 00:00:00").cast("timestamp").alias("last_seen_at"))
    merge.create(path, stored, 32)
    before = _files(path)
    new = stored.where("external_id IN ('5', '17')").drop("last_seen_at").withColumn("name", F.lit("new")).withColumn("ord", F.lit(1)).unionByName(stored.limit(1).drop("last_seen_at").withColumn("external_id", F.lit("x")).withColumn("ord", F.lit(1)))
    touched = merge.merge_into(path, new, now, 32)
    after = _files(path)
    assert 1 <= len(touched) <= 3
    assert {f: m for f, m in before.items() if int(f.split("=")[1].split("/")[0]) not in touched} == {f: m for f, m in after.items() if int(f.split("=")[1].split("/")[0]) not in touched}
    want = sorted(map(str, merge.upsert(stored, new, now).select("external_id", "name", "price", "last_seen_at").collect()))
    assert sorted(map(str, spark.read.parquet(path).select("external_id", "name", "price", "last_seen_at").collect())) == want
    assert merge.merge_into(path, new.limit(0), now, 32) == [] and _files(path) == after
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        merge.create(path, stored, 32)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folders.shared(Cluster, "x")
