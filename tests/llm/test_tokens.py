"""Token files, packing and fingerprints: exact round trips and plain versions."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pricelark.llm import fingerprint, packing, rans, tokens
from pricelark.llm.queries import tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def direct(path, texts):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def parted(path, texts):
    ids, each = tokens.encoder(path).encode(pa.array(texts, pa.string()))
    to = np.cumsum(each)
    return [ids[b - n : b].tolist() for b, n in zip(to.tolist(), each.tolist())]


TRICKY = ["a  b", "a\n b", "a \nb", "a\n \nb", " a", "a ", "a\n ", "\n", "", "  ", "a\t b", "don't 's <|endoftext|> x", "e\u0301 b \u0301c", "x" * 300, " \n x", None, "Ġ Ġx", "<| a <|x", "x\n\ny", "q\n", "a\u00a0 b", "\u2028 x y", "1 2 3,4", "</w> a</w>"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder(path):
    assert parted(path, TRICKY) == direct(path, TRICKY)
    assert all(parted(path, [t]) == direct(path, [t]) for t in TRICKY)
    assert parted(path, []) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab ,.'\n\tÉ漢1<|</w>Ġ\u0301\u00a0", max_size=40), max_size=5))
def test_encoder_any_text(texts):
    for path in (BYTE, WORD):
        assert parted(path, texts) == direct(path, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(1, 5))
def test_rans_round_trip(ids, skew):
    ids = np.array(ids, np.int64) // skew
    counts = np.bincount(ids, minlength=400)
    freq = rans.frequencies(counts)
    assert not len(ids) or freq.sum() == 1 << rans.BITS
    assert ((freq > 0) == (counts > 0)).all()
    coder = rans.Coder(freq)
    assert (coder.decode(coder.encode(ids)) == ids).all()


def test_rans_segments_and_damage():
    ids = np.arange(rans.LANES * rans.STEP * 2 + 77) % 991
    coder = rans.Coder(rans.frequencies(np.bincount(ids)))
    data = coder.encode(ids)
    n = rans.LANES * rans.STEP
    for k in range(3):
        assert (coder.decode(data, k) == ids[k * n : (k + 1) * n]).all()
    assert len(data) < 1.4 * len(ids)
    broken = bytearray(data)
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        coder.decode(bytes(broken))


def plain_files(docs):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    out, at = [], 0
    for r, ids in zip(rows, direct(BYTE, [r["text"] for r in rows])):
        ids = np.array([*ids, 0], "<u4")
        out.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("which", ["hard", "corpus", "empty"])
def test_token_files(which, request):
    docs = request.getfixturevalue(which)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rans.report(docs.repartition(3), BYTE).collect())
    assert got == [(s, d, n, c) for d, s, n, c in plain_files(docs)]


def test_bounds():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 400):
        x = rng.integers(1, 101, n)
        which, offset, fill = packing.best_fit_decreasing(x, 100)
        assert packing.lower_bound(x, 100) <= len(fill)
        assert all(x[which == b].sum() == fill[b] <= 100 for b in range(len(fill)))
        for b in range(len(fill)):
            at = np.argsort(offset[which == b])
            assert (np.cumsum(x[which == b][at]) - x[which == b][at] == offset[which == b][at]).all()
    assert packing.lower_bound(np.array([51] * 10), 100) == 10, "no two fit: more than the sum tells"
    assert packing.lower_bound(np.array([34] * 9), 100) == 5, "two of three fit"


@pytest.mark.parametrize("which", ["hard", "corpus", "empty"])
def test_packing(which, request):
    docs = request.getfixturevalue(which)
    rows = packing.pack(docs, WORD, 512).collect()
    want = []
    for r, ids in zip(docs.collect(), direct(WORD, [r["text"] for r in docs.collect()])):
        ids = np.array([*ids, 0], "<u4")
        want += [(r["doc_id"] or -1, k, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes())) for k, at in enumerate(range(0, len(ids), 512))]
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512
    if which == "corpus":
        assert len(by) <= -(-sum(r["length"] for r in rows) // 512) + 3


def test_sequences(hard):
    out = packing.sequences(hard, WORD, 256).collect()
    assert all(0 < r["n_tokens"] <= 256 and len(r["ids"]) == 4 * r["n_tokens"] for r in out)


def test_boundaries_follow_content():
    import random

    rng = random.Random(3)
    data = bytes(rng.choices(b"abcdefgh ", k=20_000))
    a = fingerprint.boundaries(data)
    assert a[-1] == len(data) and all(0 < y - x <= fingerprint.MOST for x, y in zip([0, *a], a))
    moved = b"inserted text" + data
    same = {x + 13 for x in a} & set(fingerprint.boundaries(moved))
    assert len(same) > 0.95 * len(a)
    # The rolled hash is the plain one.
    h = 0
    for k, b in enumerate(data[:100]):
        h = ((h << 1) + int(fingerprint.GEAR[b])) & 0xFFFFFFFF
        if k >= fingerprint.LEAST and k + 1 in a[:1]:
            assert h & int(fingerprint.LOOSE) == 0


def test_likeness():
    a, b = fingerprint.chunks(b"x" * 500), fingerprint.chunks(b"")
    assert fingerprint.likeness(a, a) == 1 and fingerprint.likeness(a, b) == 0 and fingerprint.likeness(b, b) == 1
    assert fingerprint.from_text(fingerprint.to_text(a)) == a


@pytest.mark.parametrize("which", ["hard", "corpus", "empty"])
def test_fingerprints(which, request):
    docs = request.getfixturevalue(which)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for i, (doc, text) in enumerate(rows):
        text, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + nxt[:q]
        f = fingerprint.chunks(text.encode())
        near = fingerprint.likeness(f, fingerprint.chunks(edited.encode())), fingerprint.likeness(f, fingerprint.chunks(nxt.encode()))
        want.append((str(doc), len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.to_text(f), *near))
    got = fingerprint.edit_report(docs.repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in got) == sorted(want)
    if which == "corpus":
        assert np.mean([r["near_edited"] for r in got if r["n_chars"] > 200]) > 0.65 and np.mean([r["near_next"] for r in got]) < 0.05


def test_place(spark):
    from pyspark.sql import functions as F

    ends = [3, 7, 8, 20, 21, 40, 90]
    got = spark.range(100).select("id", fingerprint._place(F.col("id"), ends).alias("p")).collect()
    assert all(r["p"] == sum(e < r["id"] for e in ends) for r in got)


def test_packing_holds_few_pieces(spark, monkeypatch):
    """A worker drops other operators' word hashes, encodes few texts at once and keeps a bounded number of pieces; the ids stay."""
    from pricelark.llm import jaccard

    class Rows:
        select = lambda self, *_: self
        mapInArrow = lambda self, cut, _: cut

    path = tokenizer_path("word_bpe_49k.json")
    texts = [" ".join(f"w{i * 7 + k}" for k in range(7)) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(range(60)), pa.array(texts)], names=["row", "doc_id", "text"])
    monkeypatch.setattr(packing, "KEPT", 50)
    monkeypatch.setattr(packing, "TEXTS", 4)
    monkeypatch.setattr(tokens, "_encoders", {})
    jaccard._words[b"left over"]
    cut = packing.token_pieces(Rows(), path, keep_ids=True)
    found, most = [], 0
    for out in cut(iter([batch])):
        found += out.column("ids").to_pylist()
        most = max(most, len(tokens._encoders[path].pieces))
    assert not jaccard._words and most <= 50 + 4 * 7
    assert found == [np.array([*ids, 0], "<u4").tobytes() for ids in direct(path, texts)]
