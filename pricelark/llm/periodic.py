"""Periodic runs of words inside documents.

A run is a stretch of words with smallest period q, of at least max(24, 3q) words, that no
neighbouring word extends.  For every lag the matches ``word[i] == word[i + lag]`` are
counted exactly: frequent words of a document by the autocorrelation of their places
(FFT), rare ones by the differences of their places.  A run of period p holds at least
max(24 - p, 2p) matches in a row at lag p, so only lags with that many are scanned for
islands, from the smallest on; the matches of a run found are taken off its multiples,
whose own scans would only show it again.

Shape at scale: no shuffle.  A task holds a few documents at a time, and one text whole;
memory is linear in the longest text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_OUT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


def _need(p: np.ndarray | int, least: int, times: int):
    """Matches in a row that a run of period ``p`` has at lag ``p``."""
    return np.maximum(least - p, (times - 1) * p)


def lag_counts(codes: np.ndarray, doc: np.ndarray, sizes: np.ndarray, times: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(counts, first): matches of document d at lag p are ``counts[first[d] + p]``, for p up to ``sizes[d] // times``.

    ``codes`` are the words of all documents in a row, ``doc`` the document of each place.
    A word with c places in a document of n words is frequent if its c²/2 pairs cost more
    than a transform of n log n steps.
    """
    begin, most = np.cumsum(sizes) - sizes, sizes // times
    first = np.cumsum(most + 1) - (most + 1)
    counts = np.zeros(int((most + 1).sum()), np.int64)
    if not len(codes):
        return counts, first
    key = doc * (int(codes.max()) + 1) + codes
    places = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(key[places]) != 0))
    length = np.diff(np.append(heads, len(places)))
    owner = doc[places[heads]]
    n = np.maximum(sizes[owner], 2)
    heavy = length.astype(float) ** 2 > 24 * n * np.log2(n)
    for d in np.unique(owner[heavy]):
        size = 1 << int(2 * sizes[d] - 1).bit_length()
        power = np.zeros(size // 2 + 1)
        for g in np.flatnonzero(heavy & (owner == d)):
            at = np.zeros(size)
            at[places[heads[g] : heads[g] + length[g]] - begin[d]] = 1
            spectrum = np.fft.rfft(at)
            power += spectrum.real**2 + spectrum.imag**2
        counts[first[d] : first[d] + most[d] + 1] += np.rint(np.fft.irfft(power, size)[: most[d] + 1]).astype(np.int64)
    end = np.repeat(np.where(heavy, 0, heads + length), length)
    alive, held, total, k = np.arange(len(places)), [], 0, 0
    limit, base = most[doc[places]], first[doc[places]]
    while len(alive):
        k += 1
        alive = alive[alive + k < end[alive]]
        lag = places[alive + k] - places[alive]
        near = lag <= limit[alive]  # the next places of a word are farther still
        alive = alive[near]
        held.append(base[alive] + lag[near])
        total += len(alive)
        if total > 2_000_000 or not len(alive):
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, total = [], 0
    return counts, first


def _islands(codes: np.ndarray, p: int, need: int) -> list[tuple[int, int]]:
    """(start, length) of the stretches of period ``p`` with ``need`` matches in a row and more."""
    step = need // 8
    if step > 4:  # an island holds eight places in a row of a grid this wide
        grid = np.flatnonzero(~np.concatenate(([False], codes[: len(codes) - p : step] == codes[p::step], [False])))
        if np.diff(grid).max() <= 8:
            return []
    same = np.concatenate(([False], codes[p:] == codes[:-p], [False]))
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, length = edges[::2], edges[1::2] - edges[::2]
    long = length >= need
    return list(zip(starts[long].tolist(), (length[long] + p).tolist()))


def runs_of(codes: np.ndarray, counts: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by start, then period; ``counts`` by lag (index 0 isn't read)."""
    lags = np.arange(len(counts))
    wanted = np.maximum(_need(lags, least, times), 1)
    left, found = counts.copy(), {}
    for p in np.flatnonzero(counts >= wanted).tolist():
        if p == 0 or left[p] < wanted[p]:
            continue
        for start, length in _islands(codes, p, int(wanted[p])):
            if (start, length) in found:  # of a smaller period, that divides p
                continue
            found[start, length] = p
            multiples = np.arange(p, min(length, len(left)), p)
            left[multiples] -= length - multiples
    return sorted((s, n, p) for (s, n), p in found.items())


def words_of(text: str | None) -> list[bytes]:
    """Runs of other code points than U+0020 and U+0009 to U+000D, in UTF-8."""
    return (text or "").encode().split()


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places that the words of a document are taken from, where its id asks for a repetition."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    dropped = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        dropped[s + q] += 1
        dropped[s + n] -= 1
    gone = np.cumsum(dropped)[:-1] > 0
    left = [w for w, g in zip(words, gone) if not g] if runs else words
    collapsed = hashlib.sha256(b" ".join(left)).hexdigest()
    best = (None,) * 4
    if runs:
        top = runs[0]
        for run in runs[1:]:  # by start, then period: an equal exponent doesn't replace
            if run[1] * top[2] > top[1] * run[2]:
                top = run
        best = (*top, 1000 * top[1] // top[2])
    return (len(runs), *best, listed, collapsed, len(words), int(gone.sum()))


def _judge(ids: list, texts: list, plant: bool, least: int, times: int) -> list[tuple]:
    lists = [words_of(t) for t in texts]
    if plant:
        for k, (i, words) in enumerate(zip(ids, lists)):
            if (places := planted(i, len(words))) is not None:
                lists[k] = [words[j] for j in places.tolist()]
    sizes = np.array([len(w) for w in lists], np.int64)
    flat = pa.array([w for words in lists for w in words], pa.binary())
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(lists)), sizes)
    counts, first = lag_counts(codes, doc, sizes, times)
    begin = np.cumsum(sizes) - sizes
    lag = np.arange(len(counts)) - np.repeat(first, sizes // times + 1)
    hopeful = np.zeros(len(lists), bool)
    hopeful[np.repeat(np.arange(len(lists)), sizes // times + 1)[(lag > 0) & (counts >= np.maximum(_need(lag, least, times), 1))]] = True
    out = []
    for k, words in enumerate(lists):
        runs = runs_of(codes[begin[k] : begin[k] + sizes[k]], counts[first[k] : first[k] + sizes[k] // times + 1], least, times) if hopeful[k] else []
        out.append(_row(words, runs))
    return out


def periodic_runs(docs: DataFrame, plant: bool = False, least: int = 24, times: int = 3, most_chars: int = 1 << 20) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_runs, the run of greatest length / period, digests, words and dropped words.

    ``plant`` first repeats words of the documents that `planted` names.  ``times`` periods
    and ``least`` words make a run.  A word after the first period of any run is dropped;
    ``collapsed_sha256`` is of the words left.  Documents are judged together up to
    ``most_chars`` characters of text, a longer one alone; this bounds memory, not results.
    Null and empty texts have no words and no runs; a null doc_id isn't planted; rows that
    repeat are judged one by one; empty tables give empty tables; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            size = np.cumsum(pc.utf8_length(texts.fill_null("")).to_numpy(zero_copy_only=False)) if batch.num_rows else []
            at = 0
            while at < batch.num_rows:
                done = size[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(size, done + most_chars, side="right")))
                rows = _judge(ids[at:to], texts[at:to].to_pylist(), plant, least, times)
                columns = [pa.array(ids[at:to], batch.column(0).type)]
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2
                columns += [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)
                at = to

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(part.split()[0] for part in _OUT.split(", "))]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_OUT}")
