"""op11 to op13 against plain versions written from their definitions."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from pricelark.llm import chat, periodic, queries, spelling, templates
from pricelark.llm.common import WORD

from .conftest import make, prose

# --- chat ------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "\\", "###", "####", "#\\#", "</turn>", "<</turn></turn>\n", "a: b::  c", "\\### Assistant: </turn> ok", "\n### user: x</turn>\n"])
def test_escape(text):
    shown = templates.escape(text, (*chat.CONTROLS, ": "))
    assert templates.unescape(shown) == text
    assert not any(c in shown for c in ("###", "</turn>", ": "))


def test_template_language():
    t = templates.Template(
        "{# note #}{{ bos ~ '!' }}{% if bos == 'B' %}x{% else %}y{% endif %}{% for m in messages -%}  {% if loop.first and m.role != 'system' %}({{ loop.index }}){% elif not loop.last %}-{% else %}.{% endif %}"
        "{{ m['content'] | trim | upper }}{{ ' ' if not loop.last else 1 + 2 }}{% endfor %}",
        constants={"bos": "B"},
    )
    assert t.tree[0] == ("text", "B!x")  # folded
    assert t.render({"role": "user", "content": c} for c in (" a ", "b", "c")) == "B!x(1)A -B .C3"
    assert t.render([]) == "B!x"


def test_constants_shadowed_by_assignments_are_not_folded():
    t = templates.Template("{% for m in messages %}{{ k }}{% set k = m.content %}{{ k }}{% endfor %}", constants={"k": "0"})
    assert t.render([{"content": "a"}], k="0") == "0a"
    assert templates.Template("{% for m in messages %}{% generation %}{{ 'a' }}b{% endgeneration %}{% endfor %}").tree[0][3] == [("mark", [("text", "ab")])]


@pytest.mark.parametrize(
    "source",
    ["{% for m in messages %}", "{{ x.__class__ }}", "{{ _x }}", "{% for m in messages %}{% endfor %}" * 2, "{{ messages | length }}", "{{ messages[0] }}", "{{ 1 + 'a' }}", "{% include 'x' %}", "{{ x | nope }}", "{{ f(1) }}",
     "{{ " + "(" * 80 + "1" + ")" * 80 + " }}", "{{ a b }}", "{{ a", "{% if x %}" * 70, "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}"],
)
def test_refused(source):
    with pytest.raises(templates.TemplateError):
        templates.Template(source)


def test_sandbox_has_dict_keys_only():
    t = templates.Template("{% for m in messages %}[{{ m.content.upper }}{{ m.keys }}{{ m.content[0] }}]{% endfor %}")
    assert t.render([{"content": "ab"}]) == "[a]"
    with pytest.raises(templates.TemplateError):
        templates.Template("{% for c in 'abc' %}{% endfor %}").render([])


def plain_chat(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


@pytest.mark.parametrize("part_chars", [1, 200, 1 << 20])
def test_chat_round_trip(spark, part_chars):
    odd = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "s"), (1, 1, "user", odd), (1, 2, "assistant", odd), (1, 2, "assistant", odd), (2, 5, "assistant", None), (2, None, None, "x: y"), (3, 0, "a: b\n###", ""), (None, 0, "user", "q"), (None, 1, "assistant", "漢字 𝒳\n"),
            (4, 0, "assistant", "long " * 60_000)] + [(5, i, "assistant" if i % 2 else "user", f"{i} ###") for i in range(400)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, loss string")
    parts = chat.format_conversations(frame, part_chars=part_chars)
    got = {r.conv_id: r for r in chat.read_back(parts).collect()}
    want = plain_chat(rows)
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == want
    sizes = {r.conv_id: r.n for r in parts.groupBy("conv_id").agg({"text": "count"}).withColumnRenamed("count(text)", "n").collect()}
    assert sizes[5] == (400 if part_chars == 1 else sizes[5]) and sizes[1] == (4 if part_chars == 1 else 1)
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


# --- spelling --------------------------------------------------------------------------------


def is_near(u, v):
    u, v = sorted((u, v), key=len)
    if u == v or len(v) - len(u) > 1:
        return False
    k = next((k for k, (a, b) in enumerate(zip(u, v)) if a != b), len(u))
    return u[k + 1 :] == v[k + 1 :] if len(u) == len(v) else u[k:] == v[k + 1 :]


def plain_words(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def plain_variants(words):
    out = {}
    for w, n in words.items():
        near = [v for v in words if is_near(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = [n, len(near), form, words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row.append(root)
    return {w: tuple(r) for w, r in out.items()}


def test_spelling_on_documents(spark, corpus):
    docs = corpus.select("doc_id", "text").limit(120)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(docs).collect()}
    assert got == plain_variants(plain_words([tuple(r) for r in docs.collect()]))


@pytest.mark.parametrize("most", [2, 8, 4096])
def test_spelling_of_crowded_prefixes(spark, most):
    """One prefix holds most words; small partitions force halving down to single places.  Chains of forms lead on."""
    words = ["abcabca" + x + y for x in "abcde" for y in "abcdefgh"] + ["abcabca", "abcabcab", "babcabca", "abcabc" + "é", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa"]
    text = " ".join(words * 2) + " " + "abcabcaz " * 30 + "abcabcazz " * 400 + "Abcabcyzz " * 5000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([text, None, "", "ab 12"])], "doc_id long, text string")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(docs, most=most).collect()}
    assert got == plain_variants(plain_words([(r.doc_id, r.text) for r in docs.collect()]))
    assert any(r[2] and r[4] != r[2] for r in got.values())


def test_spelling_edges(spark, hard, empty):
    assert spelling.spelling_variants(empty).count() == 0
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(hard).collect()}
    assert got == plain_variants(plain_words([(r.doc_id, r.text) for r in hard.collect()]))
    with pytest.raises(ValueError):
        spelling.spelling_variants(empty, times=1)


# --- periodic runs ---------------------------------------------------------------------------


def plain_runs(words):
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q):
                part = words[i : i + length]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found)


def plain_periodic(doc_id, text):
    words = re.findall(WORD, text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(left))


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic_runs_on_documents(spark, corpus):
    docs = corpus.select("doc_id", "text").where("length(text) < 12000")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in periodic.periodic_runs(docs, plant=True).collect()}
    assert got == {r.doc_id: plain_periodic(r.doc_id, r.text) for r in docs.collect()}
    assert sum(r[0] for r in got.values()) > 10


@pytest.mark.parametrize("most_chars", [1, 1 << 20])
def test_periodic_runs_edges(spark, hard, empty, most_chars):
    assert periodic.periodic_runs(empty).count() == 0
    texts = ["a " * 23, "a " * 24, "a b c " * 12, "a b a b c " * 9, " ".join(["x y"] * 15 + ["z"] + ["x y"] * 15), "w " * 40 + "v u " * 20 + prose(3, 200), "a a b " * 200, prose(4, 40) * 3 + " tail"]
    docs = make(spark, [(100 + i, t, "a") for i, t in enumerate(texts)] + [(None, "q r " * 30, None)]).unionByName(hard)
    got = sorted((str(r.doc_id), *map(str, (r[c] for c in COLUMNS))) for r in periodic.periodic_runs(docs, plant=True, most_chars=most_chars).collect())
    assert got == sorted((str(r.doc_id), *map(str, plain_periodic(r.doc_id, r.text))) for r in docs.collect())


def test_lag_counts_of_frequent_words_are_exact():
    import numpy as np

    rng = np.random.default_rng(3)
    codes = np.concatenate([np.where(rng.random(9000) < 0.6, 0, rng.integers(1, 3000, 9000)), rng.integers(0, 4, 500), np.zeros(0, np.int64)])
    sizes = np.array([9000, 500, 0])
    counts, first = periodic.lag_counts(codes, np.repeat(np.arange(3), sizes), sizes)
    for d, (a, n) in enumerate(((0, 9000), (9000, 500))):
        own = codes[a : a + n]
        assert counts[first[d] + 1 : first[d] + n // 3 + 1].tolist() == [int((own[p:] == own[:-p]).sum()) for p in range(1, n // 3 + 1)]


def test_new_queries_run(spark):
    for name in ("op11_chat_format", "op12_spelling_variants", "op13_periodic_runs"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
