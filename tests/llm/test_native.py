"""Licence scan, URL filters, line rules and mixing against plain versions."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pricelark.llm import license_scan, line_rules, mixing, url_rules
from tests.llm.conftest import make, prose

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def plain_license(text):
    ws = LICENSE_WORD.findall(ascii_lower(text or ""))
    found = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(i, label) for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(ws), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


@pytest.mark.parametrize("which", ["hard", "corpus"])
def test_license(which, request):
    docs = request.getfixturevalue(which)
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in license_scan.license_report(docs).collect())
    want = sorted((r["doc_id"] or -1, *plain_license(r["text"])) for r in docs.collect())
    assert list(map(str, got)) == list(map(str, want))


def test_license_templates(spark, empty):
    texts = ["Licensed under the Apache License, Version 2.0.", "GNU General Public License version 3 and GNU Lesser General Public License", "mit\nlicense", "MIT-License x MIT License", "Redistribution and use in source and binary forms, with or without modification", "gnu lesser public license"]
    rows = {r["doc_id"]: r for r in license_scan.license_report(make(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [rows[i]["labels"] for i in range(6)] == ["apache,apache-2.0", "gpl,gpl-3.0,lgpl", "mit", "mit", "bsd", ""]
    assert rows[3]["n_base"] == 2 and rows[1]["n_base"] == 2 and all(0 <= r["score"] <= 1 for r in rows.values())
    assert license_scan.license_report(empty).count() == 0
    with pytest.raises(ValueError):
        license_scan._postings((("x", "x", ("absent",), "some words"),))


def plain_labels(text):
    """Labels of all templates whose key phrases stand whole at one place of the text."""
    ws, found = LICENSE_WORD.findall(ascii_lower(text or "")), set()
    for _, label, keys, run in license_scan.TEMPLATES:
        run, must = run.split(), {}
        for key in map(str.split, keys):
            at = next(i for i in range(len(run) - len(key) + 1) if run[i : i + len(key)] == key)
            must |= {at + k: w for k, w in enumerate(key)}
        if any(all(0 <= p + i < len(ws) and ws[p + i] == w for i, w in must.items()) for p in range(-len(run), len(ws))):
            found.add(label)
    return ",".join(sorted(found))


def test_license_optional_words(spark, corpus):
    """An optional word of a template, rarer than the mandatory ones and out of place, hides nothing."""
    usual = "general public license version 3 version 2 lesser affero hereby granted free of charge"
    texts = [
        "GNU tools under the General Public License version 3", "the GNU project; General Public License, version 2", "GNU: the Lesser General Public License", "GNU or the Affero General Public License",
        "on obtaining it, permission is hereby granted free of charge to any person", "with redistribution in source or binary forms without modification", "gnu version 3", *[usual] * 40,
    ]
    rows = {r["doc_id"]: r["labels"] for r in license_scan.license_report(make(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert rows == {i: plain_labels(t) for i, t in enumerate(texts)}
    assert [rows[i] for i in range(5)] == ["gpl,gpl-3.0", "gpl,gpl-2.0", "gpl,lgpl", "agpl,gpl", "mit-text"]
    want = sorted(plain_labels(r["text"]) for r in corpus.collect())
    assert sorted(r["labels"] for r in license_scan.license_report(corpus).collect()) == want


def plain_lines(text):
    text = text or ""
    ws = SPACE_WORD.findall(text)
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {i + k for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["hard", "corpus"])
def test_line_rules(which, request):
    docs = request.getfixturevalue(which)
    rows = line_rules.judge(docs).collect()
    got = sorted((r["doc_id"] or -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert got == sorted((r["doc_id"] or -1, *plain_lines(r["text"])) for r in docs.collect())
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_line_rules_repeated_rows(spark):
    """A row that is there three times loses its words once."""
    line = prose(900, 30)
    rows = [(k, line + "\n" + prose(k, 60), "a") for k in range(25)] + [(3, line + "\n" + prose(3, 60), "a")] * 2
    got = {(r["doc_id"], r["removed_words"], r["kept"]) for r in line_rules.judge(make(spark, rows)).collect()}
    assert got == {(k, 30, True) for k in range(25)}


def test_frequent_lines(spark, empty):
    own = [(i, "Shared  banner 12 text\n" + prose(i + 1, 60), "h") for i in range(30)]
    thin = [(100 + i, ("shared banner 7 TEXT\n" * 40) + prose(200 + i, 30), "h") for i in range(3)]
    copies = [(200 + i, prose(900, 70), "h") for i in range(40)]
    docs = make(spark, own + thin + copies)
    kept = {r["doc_id"]: (r["kept"], r["removed_words"]) for r in line_rules.judge(docs).collect()}
    assert all(kept[i] == (True, 4) for i in range(30))
    assert not any(kept[100 + i][0] for i in range(3))
    assert all(kept[200 + i] == (True, 0) for i in range(40)), "exact copies are one document"
    cleaned = {r["doc_id"]: r["text"] for r in line_rules.clean(docs).collect()}
    assert cleaned[0] == prose(1, 60) and cleaned[200] == prose(900, 70)
    assert line_rules.judge(empty).count() == 0 and line_rules.clean(docs).columns == docs.columns


def plain_targets(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, fixed = dict(sizes), {}
    total = share * sum(sizes.values())
    while True:
        rest = total - sum(fixed.values())
        w = sum(weight[s] for s in left)
        target = {s: rest * weight[s] / w for s in left} if w else {}
        over = [s for s in left if target[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | target
        for s in over:
            fixed[s] = cap * left.pop(s)


@pytest.mark.parametrize("which", ["hard", "corpus"])
def test_mixing(which, request):
    docs = request.getfixturevalue(which)
    rows = mixing.mix_report(docs).collect()
    src = Counter()
    for r in docs.collect():
        src[r["source"]] += len(SPACE_WORD.findall(r["text"] or ""))
    want = plain_targets(src)
    by_size = {(r["source_size"], round(r["target"], 6)) for r in rows}
    assert by_size == {(src[s], round(want[s], 6)) for s in src}
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_report(docs).collect()))
    if which == "corpus":
        taken = Counter()
        for r in rows:
            taken[r["source_size"], r["target"]] += r["taken"]
        for (_, target), t in taken.items():
            assert abs(t - target) < 0.2 * target


def test_mix_emits(hard, empty):
    out = mixing.mix(hard)
    assert out.columns == hard.columns
    assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in hard.collect()}
    got, want = Counter(), Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(SPACE_WORD.findall(r["text"] or ""))
    for r in mixing.mix_report(hard).collect():
        want[r["doc_id"]] += r["taken"]
    assert got == want or {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 19, 20, 21, 40])
def test_a_host_is_judged_alike_at_every_size(spark, n):
    """Documents that are mostly one banner go from three on, whether a host has 3 of them or 40."""
    banner = "\n".join(prose(k, 30) for k in range(4))
    docs = make(spark, [(i, banner + "\n" + prose(100 + i, 40), "h") for i in range(n)] + [(1000 + i, prose(500 + i, 80), "other") for i in range(5)])
    got = {r["doc_id"]: (r["kept"], r["removed_words"]) for r in line_rules.judge(docs).collect()}
    assert all(got[i] == ((False, 120) if n >= 3 else (True, 0)) for i in range(n))
    assert all(got[1000 + i] == (True, 0) for i in range(5))
    cleaned = {r["doc_id"]: r["text"] for r in line_rules.clean(docs).collect()}
    assert all(cleaned[i] == (prose(100 + i, 40) if n >= 3 else banner + "\n" + prose(100 + i, 40)) for i in range(n))


URLS = ["http://A.org/x", "https://www.example.org/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://x.com/fr/?q", "http://com/de/", "http://notexample.net/", None, "no scheme", "x://h#a", "a://b://c/d", "http://sub.com/de/x"]


def plain_url(u):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
    host, path = (ascii_lower(m[1]), m[2]) if m else ("", "")
    best = None
    for v, h, p in url_rules.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = v, h + p
    return host, path, best


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "", 1) for i, u in enumerate(URLS * 3)], "page_id long, url string, html string, `row` int")
    for r in url_rules.judge(pages).collect():
        host, path, best = plain_url(URLS[r["page_id"] % len(URLS)])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert r["verdict"] == best[0] if best else r["verdict"] in ("allow", "block")
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_urls_mine(spark):
    rows = [(i, f"http://a{i}.org/casino/{i}") for i in range(40)] + [(100 + i, f"http://b{i}.com/de/shop") for i in range(40)] + [(200, "http://c.net/casino/1"), (201, "http://d.net/de/shop")]
    got = {r["page_id"]: (r["verdict"], r["mined"]) for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[200][0] == "allow" and got[201][0] == "block" and got[201][1]


def test_urls_with_one_sided_labels(spark):
    """Where 97 of 100 labels say block, urls alike are blocked and so are those that nothing speaks for."""
    rows = [(i, f"http://a{i}.com/de/bad/{i}") for i in range(970)] + [(2000 + i, f"http://b{i}.org/fine/{i}") for i in range(30)] + [(5000, "http://c.net/de/bad/1"), (5001, "http://d.net/other"), (5002, None)]
    got = {r["page_id"]: (r["verdict"], r["mined"]) for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[5000][0] == "block" and got[5000][1] and got[5001][0] == "block" and got[5002] == ("block", None)
    strict = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string"), confidence=0.999, support=0.5, longest=1, default="allow")
    assert {r["page_id"]: r["verdict"] for r in strict.collect()}[5002] == "allow"


def test_urls_that_share_a_deep_path(spark):
    """Twenty parts that always come together are one item: mining doesn't see their 2^20 subsets."""
    import time

    deep = "/".join(f"part{chr(97 + k)}" for k in range(20))
    rows = [(i, f"http://a{i}.com/de/{deep}/{i}") for i in range(200)] + [(1000 + i, f"http://b{i}.org/x/{i}") for i in range(200)] + [(5000, f"http://c.net/{deep}"), (5001, "http://c.net/partc"), (None, f"http://c.net/{deep}"), (5002, "http://c.net/" + "long/" * 20_000)]
    rows += [(5000, f"http://c.net/{deep}")] * 2
    began = time.monotonic()
    got = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert time.monotonic() - began < 60
    said = {r["page_id"]: r["verdict"] for r in got}
    assert len(got) == len(rows) and said[5000] == said[5001] == said[None] == "block"


def test_no_python_in_native_plans(corpus):
    pages = corpus.sparkSession.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for df in (license_scan.license_report(corpus), line_rules.judge(corpus), mixing.mix_report(corpus), url_rules.judge(pages)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_sql_agrees(spark):
    import duckdb

    from pricelark.llm import queries
    from tests.test_oracle import DIR, TABLES, rows

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    for name, sql in queries.SQL.items():
        assert rows(queries.QUERIES[name](spark, DIR).toPandas()) == rows(con.execute(sql).df()), name


def test_partition_boundaries_do_not_matter(corpus):
    many = corpus.repartition(7, F.col("doc_id"))
    assert sorted(map(str, mixing.mix_report(many).collect())) == sorted(map(str, mixing.mix_report(corpus).collect()))
