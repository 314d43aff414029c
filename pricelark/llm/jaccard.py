"""N-gram Jaccard join by universe partition and pigeonhole.

A text's set holds its distinct word n-grams as 64-bit hashes.  Sets whose Jaccard
similarity reaches t differ in at most H = (|x| + |y|) (1 - t) / (1 + t) elements.  Each size
band hashes the universe into segments; a segment is indexed whole (it can absorb no
difference), or with its one-deletion neighbourhood (it absorbs one).  Where the parts'
allowances add up to more than H, linked sets share an entry.  How many segments of each
kind a band gets is the cheapest allocation by a cost model (`allocate`).  Entries that
meet are candidates and are verified exactly on the sets (`links.link`).

Segments have an order.  Where all are whole, a set needs to show only as many as it may have differences
and one (a prefix filter over segments).  Empty segments would meet everywhere, so they don't count; a set that
has too few others shows all.  With deletions, the allowances exceed H by a reserve: sets
whose empty segments fit the reserve leave them out and still meet elsewhere; sets with
more of them (rare, by choice of the reserve) index them.  So nothing is lost.

Shape at scale: texts are cut once and staged as entries; exact copies share one set digest
and count as one.  Entries are two longs; they are counted by partial aggregates, and only entries that meet go on, through a
join that adaptive execution may split.  Sets are fetched for candidates alone.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, stage
from .links import degrees, link, meeting, sketch
from .tokens import slices

_U = np.uint64
_A, _B = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)  # a well-known 64-bit finalizer's multipliers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _A
    x = (x ^ (x >> _U(33))) * _B
    return x ^ (x >> _U(33))


class Words(dict):
    """Hashes of words, each computed once; cleared when large."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = Words()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams of lower-cased (A-Z) words; of all its words if fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > 500_000:
        _words.clear()
    h = np.array(list(map(_words.__getitem__, words)), np.uint64)
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out + h[i : len(h) - k + 1 + i]) + _U(i)
    return np.unique(out)


def digest(s: np.ndarray) -> int:
    """A set's 64-bit digest; two different sets share one with probability 2**-64."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - (1 << 63)


@lru_cache(None)
def bands(t: Fraction) -> list[int]:
    """Smallest size of each band; linked sets are in one band or in two that follow each other."""
    step = max(2, 1 / t)
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * step)))
    return out


def differences(x: int, y: int, t: Fraction) -> int:
    """The most elements in which linked sets of these sizes differ."""
    p, q = t.numerator, t.denominator
    return (x + y) * (q - p) // (q + p)


#: From this size on, a set shows a hundredth of its size more segments than it needs, so that linked sets share several.
PLAIN = 30


def most_shown(x: int, t: Fraction) -> int:
    """How many segments a set shows, where that are enough: one more than it may differ in from any it links with, and some."""
    return differences(x, x * t.denominator // t.numerator, t) + 1 + x // 100


def _full(n: int, m: int) -> float:
    """How many of m segments n elements fill, but for one time in a billion."""
    none = math.exp(-n / m)
    return m * (1 - none) - 6 * math.sqrt(m * none * (1 - (1 + n / m) * none))


@lru_cache(None)
def allocate(t: Fraction, band: int, docs: float = 1e7) -> tuple[int, int, int]:
    """(whole, deleted, reserve): segments of each kind for a band, and what its allowances exceed H by.

    From ``PLAIN`` on a deletion costs more than it saves, and all segments are whole: so many that a set hardly ever has too
    few that aren't empty.  Below, the cost of an allocation is its entries, plus the sets that a set is expected to meet by
    empty segments alone.  Those are indexed by the few sets with more of them than the
    reserve; their share is a Poisson tail, of ``docs`` sets in the band.
    """
    lo, hi = bands(t)[band], bands(t)[band + 1] - 1
    if hi >= PLAIN:
        m = most_shown(hi, t)
        while any(_full(n, m) < most_shown(n, t) for n in (lo, hi)):
            m += 1 + m // 100
        return m, 0, 0
    h = differences(hi, hi, t)
    best = None
    for deleted in sorted({0, 1, h // 4, (h + 1) // 2}):
        for reserve in range(max(2 * deleted - h - 1, 0), 2 * h + 40):
            whole = h + 1 + reserve - 2 * deleted
            m = whole + deleted
            size = lo / m
            mu = math.exp(-size) * (whole + 2 * deleted * (1 + size))
            tail = max(0.0, 1 - sum(math.exp(-mu + k * math.log(mu) - math.lgamma(k + 1)) for k in range(reserve + 1)))
            chance = docs * (tail * (reserve + 1)) ** 2 / m
            cost = whole + deleted * (1 + hi / m) + chance
            if best is None or cost < best[0]:
                best = cost, (whole, deleted, reserve)
            if chance < 0.01:
                break
    return best[1]


def entries(s: np.ndarray, t: Fraction) -> tuple[np.ndarray, int]:
    """(a set's index entries, how many of them it has at least in a band).

    It is indexed in its own band and, where it may meet larger sets there, the next.  Where all segments are whole, a set
    shows its first segments that aren't empty, more than it may differ in from any it links with: of
    two linked sets, the first segments of either hold some that the other has too, so both show them.  The number
    is 0 where a set has too few such segments or a band has segments with deletions.
    """
    out, least = [], None
    edges = bands(t)
    home = int(np.searchsorted(edges, len(s), "right")) - 1
    widest = len(s) * t.denominator // t.numerator  # the largest set that it links with
    for band in (home, home + 1):
        hi = edges[band + 1] - 1
        if band > home and widest < edges[band]:
            continue
        if differences(hi, hi, t) == 0:
            continue  # only equal sets link, and they share a digest
        whole, deleted, reserve = allocate(t, band)
        m = whole + deleted
        mixed = mix(s + _U(band))
        part = (mixed % _U(m)).astype(np.int64)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, part, mixed)
        sizes = np.bincount(part, minlength=m)
        tag = mix(np.arange(m, dtype=np.uint64) + (_U(band + 1) << _U(32)))
        if not deleted:
            full, need = np.flatnonzero(sizes), most_shown(len(s), t)
            show = full[:need] if len(full) >= need else np.arange(m)
            enough = need if len(full) >= need else 0
        else:
            empty = int((sizes[:whole] == 0).sum() + 2 * (sizes[whole:] <= 1).sum())
            show, enough = np.full(m, True) if empty > reserve else sizes > 0, 0
        least = enough if least is None else min(least, enough)
        out.append(mix(sums[show] + tag[show]))
        if deleted:
            d = part >= whole
            if empty <= reserve:
                d &= sizes[part] > 1
            out.append(mix(sums[part[d]] - mixed[d] + tag[part[d]]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64), least or 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), _signed(flat))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def indexed(docs: DataFrame, n: int, t: Fraction) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, size, shown, sketch, buckets) per row: the set's digest, size, sketch and index entries."""
    schema = "doc_id long, text_key long, n_shingles long, node long, size int, shown int, sketch binary, buckets array<long>"

    def run(batches):
        for b in (s for x in batches for s in slices(x)):
            sets = [shingles(t_, n) for t_ in b.column("text").to_pylist()]
            made = [entries(s, t) if len(s) else (s, 0) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), b.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([k for _, k in made], pa.int32()), pa.array([sketch(s) for s in sets], pa.binary()), _lists([e for e, _ in made])],
                names=["doc_id", "text_key", "n_shingles", "node", "size", "shown", "sketch", "buckets"],
            )

    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    return rows.mapInArrow(run, schema)


def _fetched(docs: DataFrame, rows: DataFrame, n: int, wanted: DataFrame, scope: str) -> DataFrame:
    """(node, elements) of the ``wanted`` nodes, each from one of the rows that have it."""
    one = rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("at"), (F.count("*") > 1).alias("again"))
    one = one.join(wanted, "node", "left_semi")
    one = broadcast_if_small(stage(one.select(F.col("at.doc_id").alias("id"), F.col("at.text_key").alias("key"), "again"), scope), 500_000)  # two longs and a flag
    chosen = docs.select("doc_id", "text").join(one, F.col("doc_id").eqNullSafe(F.col("id")) & (text_key(F.col("text")) == F.col("key"))).select("text", "again")

    def run(batches):
        for b in (s for x in batches for s in slices(x)):
            sets = [shingles(t, n) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()), b.column("again"), _lists(sets)], names=["node", "again", "elements"])

    sets = stage(chosen.mapInArrow(run, "node long, again boolean, elements array<long>"), scope)
    # Rows that repeat doc_id and text were all read.
    return sets.where("NOT again").drop("again").unionByName(sets.where("again").drop("again").dropDuplicates(["node"]))


def _classes(docs: DataFrame, n: int, t: Fraction, scope: str, counted: bool = False) -> DataFrame:
    """Rows (doc_id, text_key, n_shingles, node, comp), with n_links if ``counted``; both null where a set has no link."""
    rows = stage(indexed(docs, n, t), scope)
    members = meeting(rows.select(F.explode("buckets").alias("bucket"), "node"), scope)
    nodes = rows.where("size(buckets) > 0").select("node", "size", "shown", "sketch")
    rows = rows.select("doc_id", "text_key", "n_shingles", "node")
    fetch = lambda wanted: _fetched(docs, rows, n, wanted, scope)
    classes = link(members, nodes, fetch, t, scope)
    if counted:
        classes = classes.join(stage(degrees(classes, fetch, t, scope), scope), "node")
    return rows.join(classes, "node", "left")


def near_components(docs: DataFrame, n: int = 5, threshold: float | Fraction = 0.8, scope: str = "jaccard", counted: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, n_links (the number of other sets that its set is linked with), component_id.

    component_id is the smallest doc_id reachable by links, the row's own included.  A text without a
    word has an empty set, is linked with nothing and has its own doc_id; so has a null text.
    Texts with fewer than n words have one element, the whole sequence.  Null doc_ids count
    as larger than all others.  Rows that share a doc_id have rows of their own.  An empty table gives an
    empty one.  Other columns are not looked at.

    Unless ``counted``, there's no n_links, and links inside a component are verified only as far as they connect it.
    """
    rows = _classes(docs, n, Fraction(threshold).limit_denominator(1000), scope, counted)
    named = rows.withColumn("comp", F.coalesce("comp", "node"))
    if counted:
        named = named.fillna(0, ["n_links"])
    names = ["doc_id", "n_shingles", *["n_links"] * counted, "component_id"]
    full = named.where("n_shingles > 0")
    first = full.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = full.join(first, "comp").select(*names)
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone.select(*names))


def keep_first(docs: DataFrame, n: int = 5, threshold: float | Fraction = 0.8, scope: str = "jaccard") -> DataFrame:
    """The first row of each component by doc_id (nulls last), then text; all columns stay.

    Of rows that repeat doc_id and text one stays.  Rows without a word are linked with nothing and stay.
    """
    rows = _classes(docs, n, Fraction(threshold).limit_denominator(1000), scope)
    full = stage(rows.where("n_shingles > 0").select(F.coalesce("comp", "node").alias("comp"), "doc_id", "text_key"), scope)
    order = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "text_key")
    groups = full.groupBy("comp").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    named = full.join(groups, "comp").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), (order == F.col("first")).alias("__kept"))
    # Not kept, or kept and there more than once.
    marked = stage(named.groupBy("__id", "__key").agg(F.max("__kept").alias("__kept"), F.count("*").alias("__n")).where("NOT __kept OR __n > 1").drop("__n"), scope)
    marked = broadcast_if_small(marked, 500_000)  # two longs and a flag
    met = docs.join(marked, F.col("doc_id").eqNullSafe(F.col("__id")) & (text_key(F.col("text")) == F.col("__key")), "left")
    one = met.where("__kept").dropDuplicates(["__id", "__key"])
    return met.where("__kept IS NULL").unionByName(one).select(*[F.col(f"`{c}`") for c in docs.columns])
