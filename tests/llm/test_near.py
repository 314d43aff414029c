"""Similarity join, paragraph dedup, classifier and pipeline against plain versions."""

from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricelark.llm import jaccard, links, paragraphs, quality
from tests.llm.conftest import make, prose


def sets_of(rows, n):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()))
    return out


def plain_components(rows, n, t):
    sets = sets_of(rows, n)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and len(a & b) * t.denominator >= t.numerator * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for k in range(len(sets)):
        groups[find(k)].append(k)
    named = {}
    for members in groups.values():
        ids = [sets[k][0] for k in members if sets[k][0] is not None]
        for k in members:
            named[k] = min(ids, default=None) if sets[k][1] else sets[k][0]
    return sorted((str(sets[k][0]), len(sets[k][1]), str(named[k])) for k in range(len(sets)))


@pytest.mark.parametrize(("which", "n", "t"), [("hard", 3, Fraction(9, 10)), ("hard", 5, Fraction(4, 5)), ("corpus", 3, Fraction(9, 10)), ("corpus", 5, Fraction(4, 5)), ("empty", 3, Fraction(9, 10))])
def test_components(which, n, t, request):
    docs = request.getfixturevalue(which)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.near_components(docs, n, float(t)).collect())
    assert got == plain_components([(r["doc_id"], r["text"]) for r in docs.collect()], n, t)


def test_near_copies_of_near_copies(spark):
    """Chains and a hub whose copies do not link with each other: components must come out whole."""
    base = prose(42, 100).split(" ")
    rows = [(0, " ".join(base), "a")]
    for k in range(60):
        w = list(base)
        w[(k * 7) % 98 + 1] = f"edit{k}"
        w[(k * 13 + 5) % 98 + 1] = f"other{k}"
        rows.append((k + 1, " ".join(w), "a"))
    chain = list(base)
    for k in range(12):
        chain = list(chain)
        chain[k * 8] = f"link{k}"
        rows.append((100 + k, " ".join(chain), "a"))
    docs = make(spark, rows)
    for n, t in ((3, Fraction(9, 10)), (5, Fraction(4, 5))):
        got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.near_components(docs, n, float(t)).collect())
        assert got == plain_components([(i, x) for i, x, _ in rows], n, t)


def test_links_counted(spark):
    """Every link counts once, in groups of any size; copies of a text have its number."""
    base = prose(21, 220).split(" ")
    rows = []
    for k in range(80):
        w = list(base)
        w[(k * 7) % 215 + 2] = f"edit{k}"
        if k % 4 == 0:
            w[(k * 11) % 213 + 3] = f"other{k}"
        rows.append((k, " ".join(w), "a"))
    rows += [(100 + k, rows[k][1], "b") for k in range(5)] + [(200, prose(22, 60), "a"), (201, None, "a")]
    sets = sets_of([(i, t) for i, t, _ in rows], 3)
    distinct = {frozenset(x) for _, x in sets if x}
    want = {i: sum(x != y and len(x & y) * 10 >= 9 * len(x | y) for y in distinct) if x else 0 for i, x in sets}
    assert max(want.values()) > 60 and len(set(want.values())) > 3
    assert {r["doc_id"]: r["n_links"] for r in jaccard.near_components(make(spark, rows), 3, 0.9).collect()} == want


def test_links_of_large_buckets(spark):
    """Buckets above the bound, in several blocks, with most sets far from the pivot: no link or component is lost."""
    sets = {k: list(range(k, k + 20)) for k in range(600) if k % 50 < 40}
    elements = spark.createDataFrame(list(sets.items()), "node long, elements array<long>")
    nodes = spark.createDataFrame([(k, 20, 0, bytearray(links.sketch(jaccard.mix(np.array(v, np.uint64))))) for k, v in sets.items()], "node long, size int, shown int, sketch binary")
    members = spark.createDataFrame([(b, k) for b in (1, 2) for k in sets] + [(3, 5), (3, 6)], "bucket long, node long")
    fetch = lambda asked: elements.join(asked, "node", "left_semi")
    classes = links.link(members, nodes, fetch, Fraction(4, 5), "test", most=7)
    assert {r["node"]: r["comp"] for r in classes.collect()} == {k: k - k % 50 for k in sets}
    want = {x: sum(0 < abs(x - y) <= 2 for y in sets) for x in sets}  # 18 of 22 and more are 4 in 5
    for most, room in ((256, 1_000_000), (7, 1_000_000), (256, 90)):
        assert {r["node"]: r["n_links"] for r in links.degrees(classes, fetch, Fraction(4, 5), "test", most, room).collect()} == want


def test_sketches_never_exclude_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 1500))).astype(np.uint64))
        y = np.unique(np.concatenate([x[int(rng.integers(0, len(x) + 1)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 200))).astype(np.uint64)]))
        apart = links._apart(*(links._bits(pa.array([links.sketch(v)], pa.binary())) for v in (x, y)))[0]
        assert apart <= len(np.setxor1d(x, y))


def test_pigeonhole():
    """Any two sets at the threshold share an entry, whatever their sizes."""
    rng = np.random.default_rng(5)
    for t in (Fraction(9, 10), Fraction(4, 5)):
        for _ in range(400):
            size = int(rng.integers(2, 400))
            x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            most = int(2 * len(x) * (1 - t) / (1 + t))
            drop, add = (int(v) for v in rng.integers(0, most // 2 + 1, 2))
            y = np.unique(np.concatenate([x[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if len(y) and both * t.denominator >= t.numerator * (len(x) + len(y) - both) and not np.array_equal(x, y):
                (one, shown), (two, shown2) = jaccard.entries(x, t), jaccard.entries(y, t)
                assert len(np.intersect1d(one, two)) >= max(1, min(shown, shown2) - jaccard.differences(len(x), len(y), t))


def test_one_deletion():
    """Segments that may lose an element meet although they differ by one."""
    t = Fraction(9, 10)
    assert jaccard.allocate(t, int(np.searchsorted(jaccard.bands(t), 11, "right")) - 1)[1]
    x = np.sort(np.arange(1, 12, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert all(len(np.intersect1d(jaccard.entries(x, t)[0], jaccard.entries(np.delete(x, k), t)[0])) for k in range(11))


def test_keep_first(hard):
    out = jaccard.keep_first(hard, 5, 0.8)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == hard.columns and 4 in ids and 5 not in ids and 6 not in ids and None in ids and 1 in ids


def test_links_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 200)]
    got = {r["node"]: r["comp"] for r in links.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert links.components(spark.createDataFrame([], "a long, b long"), "test").count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 3000)], "a long, b long").repartition(7)
    assert [tuple(r) for r in links.components(chain, "test").groupBy("comp").count().collect()] == [(0, 3001)]


# --- paragraphs --------------------------------------------------------------------------


def test_bands():
    bands, rows = paragraphs.tune_bands(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_repeats(spark, empty):
    passage = prose(77, 55)
    near = passage.split(" ")
    near[20] = "edited"
    rows = [
        (1, prose(1, 50) + "\n" + passage + "\n" + prose(2, 50), "a"), (2, prose(3, 40) + "\n" + " ".join(near), "a"), (3, "clean " + prose(4, 90), "a"),
        (4, prose(5, 30) + " " + passage + " " + prose(6, 30), "b"), (5, None, "a"), (6, "", "a"), (7, "short line\n" + prose(8, 60), "a"), (8, "short line\n" + prose(9, 60), "a"),
    ]
    docs = make(spark, rows)
    got = defaultdict(list)
    for r in paragraphs.repeat_report(docs).collect():
        got[r["doc_id"]].append((r["start"], r["end"], r["removed"], r["first_doc"]))
    assert set(got) == {1, 2, 4}
    assert any(s == 50 and e == 105 and not x for s, e, x, _ in got[1])
    assert got[2] == [(40, 95, True, 1)], "an edited paragraph"
    assert all(x and s >= 30 and e <= 85 for s, e, x, _ in got[4]) and got[4], "inside a longer line"
    out = {r["doc_id"]: r for r in paragraphs.remove(docs).collect()}
    assert out[1]["text"] == rows[0][1] and out[3]["text"] == rows[2][1] and out[2]["text"] == prose(3, 40)
    assert out[2]["n_chars"] == len(prose(3, 40)) and len(out[4]["text"].split()) < 115 and 5 in out and 6 in out
    assert paragraphs.repeat_report(empty).count() == 0 and paragraphs.remove(empty).count() == 0
    assert paragraphs.remove(docs).columns == docs.columns


def test_repeats_exact(spark):
    """Passages inside longer lines go up to their true ends, whichever earlier document has them."""
    one, two, part = prose(77, 55), prose(78, 200), prose(79, 120).split(" ")
    rows = [
        (1, prose(1, 40) + " " + one + " " + prose(2, 40), "a"), (2, prose(3, 30) + " " + one + " " + prose(4, 30), "a"),
        (3, prose(5, 95) + " " + two + " " + prose(6, 35), "a"), (4, two + " " + prose(7, 93), "a"), (5, prose(8, 91) + " " + two, "a"), (None, prose(9, 67) + " " + two + " " + prose(10, 67), "a"),
        # The windows of part[10:40] stand first in 6, those around them in 7: in 8 the passage goes as a whole.
        (6, prose(11, 30) + " " + " ".join(part[10:40]) + " " + prose(12, 30), "a"), (7, prose(13, 20) + " " + " ".join(part) + " " + prose(14, 20), "a"), (8, prose(15, 25) + " " + " ".join(part) + " " + prose(16, 25), "a"),
    ]
    docs = make(spark, rows)
    got = {(r["doc_id"], r["start"], r["end"], r["n_words"], r["removed"]) for r in paragraphs.repeat_report(docs).collect()}
    want = {(1, 40, 95, 55, False), (2, 30, 85, 55, True), (3, 95, 295, 200, False), (4, 0, 200, 200, True), (5, 91, 291, 200, True), (None, 67, 267, 200, True), (8, 25, 145, 120, True)}
    assert {x for x in got if x[0] not in (6, 7)} == want
    out = {r["doc_id"]: r["text"] for r in paragraphs.remove(docs).collect()}
    assert out[2] == prose(3, 30) + " " + prose(4, 30) and out[4] == prose(7, 93) and out[5] == prose(8, 91) and out[None] == prose(9, 67) + " " + prose(10, 67) and out[8] == prose(15, 25) + " " + prose(16, 25)
    assert all(out[k] == t for k, t, _ in rows if k in (1, 3, 6))


def test_any_run_goes_whole(spark):
    """Each word of a run of 50 words and more that an earlier document has too goes; what goes stands in an earlier one."""
    pool = [prose(k + 500, 70).split(" ") for k in range(6)]
    rows = []
    for k in range(40):
        words = []
        for j in range(3):
            piece = pool[(k * 5 + j * 7) % 6]
            words += prose(k * 10 + j + 7000, 5 + k % 4).split(" ") + piece[(k * 3 + j) % 20 : 70 - (k * 7 + j) % 15]
        rows.append((k, " ".join(words), "a"))
    texts = [t.split(" ") for _, t, _ in rows]
    gone = defaultdict(set)
    for r in paragraphs.repeats(make(spark, rows)).where("NOT kept AND words > 0").collect():
        gone[r["doc_id"]] |= set(range(r["at"], r["at"] + r["words"]))
    for d, x in enumerate(texts):
        runs = {least: set() for least in (20, 50)}
        for e in range(d):
            before = [0] * (len(texts[e]) + 1)
            for i, w in enumerate(x):
                now = [0] + [before[j] + 1 if v == w else 0 for j, v in enumerate(texts[e])]
                for least in runs:
                    if max(now) >= least:
                        runs[least] |= set(range(i + 1 - max(now), i + 1))
                before = now
        assert runs[50] <= gone[d] <= runs[20]


def test_any_passage_of_fifty_words():
    """Wherever a passage of 50 words stands, a window inside it is a unit in both texts."""
    for k in range(300):
        passage = prose(k + 1000, 50)
        texts = [prose(k + 2000, 7 * k % 60 + 1) + " " + passage + " " + prose(k + 3000, 30), "", prose(k + 4000, 20), passage + " " + prose(k + 5000, 5 * k % 70 + 1)]
        c = paragraphs.Cut(texts, 20, 5)
        units = [{int(w) for w, t in zip(c.window, c.window_text) if t == i} for i in range(4)]
        assert units[0] & units[3] and not units[1] | units[2]
        whole = len(texts[0].split())
        assert all(0 <= a <= whole - paragraphs.WINDOW for a, t in zip(c.window_at, c.window_text) if t == 0)
        alone = paragraphs.Cut(texts[:1], 20, 5)
        assert sorted(alone.window.tolist()) == sorted(c.window[c.window_text == 0].tolist()), "the batch plays no part"


def test_paragraph_links_exact(corpus):
    """Paragraphs at Jaccard 0.8 and more are found as a plain comparison finds them, but for the banding's share."""
    seen = {}
    for r in corpus.collect():
        at = 0
        for line in (r["text"] or "").encode().lower().split(b"\n"):
            w = line.split()
            if len(w) >= 20:
                seen.setdefault(tuple(w), []).append((r["doc_id"], at))
            at += len(w)
    units = [(k, {k[i : i + 5] for i in range(len(k) - 4)}) for k in seen]
    want = set()
    by = defaultdict(list)
    for u, (_, s) in enumerate(units):
        for g in s:
            by[g].append(u)
    for us in by.values():
        for x in us:
            for y in us:
                if x < y and len(units[x][1] & units[y][1]) * 5 >= 4 * len(units[x][1] | units[y][1]):
                    want.add((x, y))
    found = defaultdict(set)
    for r in paragraphs.repeats(corpus).collect():
        found[r["doc_id"], r["at"]].add(r["component"])
    ok = 0
    for x, y in want:
        a, b = seen[units[x][0]][0], seen[units[y][0]][0]
        ok += bool(found[a] & found[b]) if a[0] != b[0] else 0
    pairs = [p for p in want if seen[units[p[0]][0]][0][0] != seen[units[p[1]][0]][0][0]]
    assert ok >= 0.95 * len(pairs)
    for places in seen.values():
        if len({d for d, _ in places}) > 1:
            assert all(found[p] for p in places)


def test_hot_passage(spark):
    """A passage in every document, and a group of edited ones: a row a place, nothing squared."""
    passage = prose(5, 60)
    rows = []
    for k in range(150):
        w = passage.split(" ")
        w[k % 60] = f"edit{k}"
        rows.append((k, prose(k + 100, 40) + "\n" + passage + "\n" + " ".join(w), "a"))
    out = paragraphs.repeat_report(make(spark, rows)).collect()
    assert {r["doc_id"] for r in out if r["removed"]} == set(range(1, 150)) and {r["first_doc"] for r in out if r["removed"]} == {0}
    assert all(r["first_doc"] == r["doc_id"] for r in out if not r["removed"]) and len(out) < 10 * 150


def test_removed_alone(spark):
    """`remove` asks for removed spans alone: the same ones, a row a place and no rows made from it."""
    passage = prose(5, 60).split(" ")
    docs = make(spark, [(k, prose(k + 100, 40) + " " + " ".join(passage[k % 4 : 60 - k % 3]) + " " + prose(k % 5, 30), "a") for k in range(40)])
    cells = ("doc_id", "text_key", "at", "words", "component", "first_doc")
    rows = lambda df: sorted(tuple(r[c] for c in cells) for r in df.collect())
    alone = paragraphs.repeats(docs, removed=True)
    assert rows(alone) == rows(paragraphs.repeats(docs).where("NOT kept")) and rows(alone)
    assert "Generate" not in alone._jdf.queryExecution().optimizedPlan().toString()


# --- classifier ------------------------------------------------------------------------------


def test_classifier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 40 and (got.predicted == got.quality).mean() > 0.95
    again = quality.score(docs, quality.train(docs.repartition(5), labels)).toPandas().sort_values("doc_id")
    assert np.allclose(again.score, quality.score(docs, model).toPandas().sort_values("doc_id").score, atol=1e-6)


def test_held_out(spark):
    import zlib

    got = spark.range(200).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_classifier_edges(spark, hard, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(hard, none) is None
    rows = quality.score(hard, None).collect()
    assert len(rows) == hard.count() and {r["score"] for r in rows} == {0.5}
    some = spark.createDataFrame([(i, 1, 0) for i in (4, 6, 7, 9)] + [(12, 0, 0), (None, 1, 0), (14, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(hard, some)
    assert all(0 <= r["score"] <= 1 for r in quality.score(hard, model).collect())
    assert quality.score(empty, model).count() == 0 and quality.keep(hard, model).columns == hard.columns


def test_quality_sample_bounds_rows(spark, monkeypatch):
    """An id with a third of the rows adds one row to what is fitted; which one doesn't depend on their order."""
    from tests.llm.conftest import make, prose

    rows = [(i, prose(i, 40), "a") for i in range(200)] + [(7, prose(1000 + i, 20), "a") for i in range(100)]
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_pu", lambda p, u, prior: seen.append((len(p), len(u), p.sum())))
    for order in (rows, rows[::-1]):
        quality.train(make(spark, order).repartition(3), labels)
    held = {r.id for r in spark.range(200).where(quality.held_out(F.col("id"))).collect()}
    assert [s[:2] for s in seen] == [(len(set(range(100)) - held), len(set(range(100, 200)) - held))] * 2
    assert seen[0][2] == pytest.approx(seen[1][2])


def test_risk_is_not_negative():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (400, quality.FEATURES)), rng.normal(-1, 1, (400, quality.FEATURES))
    model = quality.fit_pu(good[:200], np.concatenate([good[200:], bad[:200]]), 0.5, steps=300)
    assert (model.score(good) > 0.5).mean() > 0.95 and (model.score(bad) < 0.5).mean() > 0.95


# --- pipeline --------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline
    from pricelark.llm import mixing, packing
    from pricelark.llm.queries import table, tokenizer_path

    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "substring_dedup", "source_mix", "best_fit_packing"]
    docs = table(spark, sf, "documents")
    model = quality.train(docs, table(spark, sf, "labels"))
    good = docs.join(quality.score(docs, model).where("predicted = 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    first = [r for r in good.collect()]
    comp = plain_components([(r["doc_id"], r["text"]) for r in first], 5, Fraction(4, 5))
    keep = {int(d) for d, _, c in comp if d == c}
    kept = good.where(F.col("doc_id").isin(*keep))
    cleaned = paragraphs.remove(kept)
    plan = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix_report(cleaned).collect()}
    want = packing.pack(mixing.mix(cleaned), tokenizer_path("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in want)
    assert {r["doc_id"] for r in rows} <= {d for d, (taken, size) in plan.items() if taken or not size}


def test_pipeline_hands_workers_small_batches(spark):
    """A stage's tasks get 1,024 whole texts at a time at most, not 10,000; fewer where fewer are set."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    try:
        for own, most in (("10000", 1024), ("0", 1024), ("100", 100)):
            spark.conf.set(key, own)
            corpus_pipeline._begin(spark, corpus_pipeline._SCOPES[0])
            got = spark.range(0, 5000, 1, 1).mapInArrow(rows, "n long").agg(F.max("n"), F.sum("n")).first()
            assert tuple(got) == (most, 5000)
    finally:
        spark.conf.set(key, before)


def test_quality_drops_what_other_stages_keep():
    from pricelark.llm import common, jaccard, quality, tokens

    jaccard.shingles("some words of another stage", 3)
    tokens._encoders["x"] = object()
    quality._make_room()
    assert not jaccard._words and not tokens._encoders
    common.give_back()
