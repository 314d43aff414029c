"""Links between sets that share buckets, and the components they make.

Sets that share a bucket are candidates for a link, Jaccard t or more.  Linked sets x and y differ in
at most T = (|x| + |y|) (1 - t) / (1 + t) elements.  Candidates are excluded by what moves least
first, and never wrongly:

* sizes alone;
* the number of buckets that two sets share, where the index says how many a link shares at least;
* sketches of 512 or 2048 bits, where each element flips the bit that its hash names: two sketches differ
  in at most as many bits as the sets in elements (longer sets fill a sketch, and it excludes little);
* at last the sets themselves, for pairs that still matter: first a forest (each set with the
  smallest candidate), then candidates that the forest has not joined.

Buckets of up to ``most`` sets give all their pairs.  A larger bucket would give a square, so there each set meets
the bucket's pivot alone, the set that shares most buckets with others, in a group of near copies the one nearest
all, before small buckets are looked at.  Then only sets of different components still matter; they are compared by
sketches inside the join, in blocks of bounded size, so that no task gets a whole bucket and no pair is written but the
few that pass.  No link between components is lost.  Links inside components are counted in blocks (`degrees`).
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small
from .common import stage_freed as stage

#: Bits of a sketch; of a set of ``LARGE`` elements or more, four times as many.
BITS, LARGE = 512, 800


def sketch(mixed: np.ndarray) -> bytes:
    """The sketch of a set of hashes: bit h is set if an odd number of hashes ends in h."""
    bits = BITS if len(mixed) < LARGE else 4 * BITS
    odd = np.bincount((mixed & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _bits(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sketches folded to ``BITS``, as rows of longs; whether a set is large, and the whole sketches of large ones (others: zeros)."""
    found = column.to_pylist()
    large = np.array([len(x) > BITS // 8 for x in found], bool)
    whole = np.zeros((len(found), 4, BITS // 64), np.uint64)
    read = lambda wanted: np.frombuffer(b"".join(x for x, is_large in zip(found, large) if is_large == wanted), np.uint64)
    whole[large] = read(True).reshape(-1, 4, BITS // 64)
    folded = np.bitwise_xor.reduce(whole, axis=1)
    folded[~large] = read(False).reshape(-1, BITS // 64)
    return folded, large, whole.reshape(len(found), -1)


def _apart(one: tuple, two: tuple) -> np.ndarray:
    """In how many bits sketches differ, by whole ones where both sets are large."""
    count = lambda k: np.bitwise_count(one[k] ^ two[k]).sum(-1, dtype=np.int64)
    return np.where(one[1] & two[1], count(2), count(0))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) of edges, for all but the smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(ids))
    while True:
        new = low.copy()
        least = np.minimum(low[x], low[y])
        for ends in (x, y, low[x], low[y]):
            np.minimum.at(new, ends, least)
        new = new[new]
        if np.array_equal(new, low):
            break
        low = new
    moved = low != np.arange(len(ids))
    return ids[moved], ids[low[moved]]


def _contracted(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The same components by fewer edges (a > b): each task makes stars of up to ``most`` edges at a time."""

    def run(batches):
        held, n = [], 0

        def stars():
            a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(v) for v in _stars(a, b)], names=["a", "b"])

        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= most:
                yield stars()
                held, n = [], 0
        if held:
            yield stars()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scope: str, most: int = 60) -> DataFrame:
    """(node, comp): for every node of ``edges`` (a, b) with another end the smallest node it reaches.

    Tasks first make stars of the edges they read.  Then each step links every node to the
    smallest of its neighbourhood and rewires the neighbours to that (small and large stars
    by turns), so long chains shrink in logarithmically many steps.  Groupings are partial
    aggregates; a hub's rows are split over tasks.  Nothing is collected but one answer a step.
    """
    now = stage(_contracted(edges), scope)
    for _ in range(most):
        # Done when every node has one link, to a node that has none: stars.
        ends = now.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
        # Every node and its smaller neighbours (a > b).  Small star: all of them meet at the smallest.
        low = now.groupBy("a").agg(F.min("b").alias("low"))
        small = now.join(low, "a").select(F.col("b").alias("x"), "low").where("x <> low").unionByName(low.select(F.col("a").alias("x"), "low"))
        # Large star: larger neighbours meet at the smallest of the neighbourhood, or the node itself.
        both = small.select(F.col("x").alias("u"), F.col("low").alias("v")).unionByName(small.select(F.col("low").alias("u"), F.col("x").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        new = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        now = stage(_contracted(stage(new, scope)), scope)
    raise RuntimeError(f"components aren't stars after {most} steps")


def _able(t: Fraction, one: str, two: str) -> Column:
    """Sizes that allow a link."""
    return F.least(one, two) * t.denominator >= F.greatest(one, two) * t.numerator


def _differences(t: Fraction, one: str, two: str) -> Column:
    """The most elements in which linked sets of these sizes differ."""
    p, q = t.numerator, t.denominator
    return F.floor((F.col(one).cast("long") + F.col(two)) * (q - p) / (q + p))


def _second(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(f"{c}_") for c in df.columns])


def _ordered(one: str, two: str) -> list[Column]:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def _sketched(pairs: DataFrame, info: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    facts = info.select("node", "size", "sketch")
    out = pairs.join(facts.withColumnRenamed("node", "a"), "a").join(_second(facts).withColumnRenamed("node_", "b"), "b")
    out = out.where(_able(t, "size", "size_")).select("a", "b", "sketch", "sketch_", _differences(t, "size", "size_").cast("long").alias("most"))

    def run(batches):
        for batch in batches:
            apart = _apart(_bits(batch.column("sketch")), _bits(batch.column("sketch_")))
            yield batch.select(["a", "b"]).filter(pa.array(apart <= batch.column("most").to_numpy()))

    return out.mapInArrow(run, "a long, b long")


def _late(members: DataFrame, t: Fraction, most: int = 1024) -> DataFrame:
    """(a, b, least) for each bucket and two of its ``members`` of different ``comp`` whose sizes and sketches allow a link.

    A bucket is cut in blocks of about ``most`` sets, and every two of its blocks are a group of their own.  Pairs are
    made inside the groups; those that pass alone leave them.
    """
    p, q = t.numerator, t.denominator
    cut = members.withColumn("blocks", F.ceil(F.col("n") / most).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "size", "shown", "sketch")

    def run(group: pa.Table) -> pa.Table:
        block, node, comp, size, shown = (group.column(c).to_numpy() for c in ("block", "node", "comp", "size", "shown"))
        size, bits = size.astype(np.int64), _bits(group.column("sketch"))
        folded = bits[0]
        one, two = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        node2, comp2, size2, folded2 = node[two], comp[two], size[two], folded[two]
        found = []
        for x in one.tolist():
            allowed = (size[x] + size2) * (q - p) // (q + p)
            near = (comp2 != comp[x]) & (np.bitwise_count(folded2 ^ folded[x]).sum(1, dtype=np.int64) <= allowed)
            near &= np.minimum(size[x], size2) * q >= np.maximum(size[x], size2) * p
            if block.min() == block.max():
                near &= node2 > node[x]
            at = np.flatnonzero(near)
            at = at[_apart([b[two[at]] for b in bits], [b[x] for b in bits]) <= allowed[at]]
            if len(at):
                found.append(np.stack([np.minimum(node[x], node2[at]), np.maximum(node[x], node2[at]), np.maximum(1, np.minimum(shown[x], shown[two[at]]) - allowed[at])]))
        a, b, least = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
        return pa.table({"a": a, "b": b, "least": least})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long, least long")


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets are linked, in whole numbers."""
    out = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return out.where(both * (t.numerator + t.denominator) >= t.numerator * (F.size("x") + F.size("y"))).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _counted(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that share as many buckets as a link does at least."""
    return pairs.groupBy("a", "b").agg(F.count("*").alias("k"), F.min("least").alias("least")).where("k >= least").select("a", "b")


def link(members: DataFrame, nodes: DataFrame, fetch: Callable[[DataFrame], DataFrame], t: Fraction, scope: str, most: int = 64) -> DataFrame:
    """(node, comp): the component of every node with a link.

    ``members``: distinct (bucket, node).  ``nodes``: (node, size, shown, sketch), rows may repeat; of the buckets
    that two linked nodes of a ``shown`` of f and g have, they share min(f, g) - T or more, and one at least.  ``fetch``
    gives (node, elements), arrays of distinct longs, for the nodes of a DataFrame.
    Links inside a component are verified only as far as they connect it; `degrees` counts them all.
    """
    facts = nodes.groupBy("node").agg(*[F.min(c).alias(c) for c in ("size", "shown", "sketch")])
    info = stage(facts.join(members.select("node"), "node", "left_semi"), scope)
    counts = members.groupBy("bucket").agg(F.count("*").cast("int").alias("n"))
    sized = stage(members.join(info.select("node", "size", "shown"), "node").join(counts, "bucket"), scope)
    small, hot = sized.where(F.col("n") <= most).drop("n"), sized.where(F.col("n") > most)
    crowded = hot.groupBy("node").agg(F.count("*").cast("int").alias("large"))
    crowded = broadcast_if_small(stage(crowded, scope), 500_000)  # a long and an int

    # Large buckets first: each set with the pivot.  What that joins needs no pairs of small buckets.
    weighed = hot.join(crowded, "node").select("bucket", "node", "large")
    pivot = weighed.groupBy("bucket").agg(F.max(F.struct("large", "node"))["node"].alias("pivot"))
    starred = hot.join(pivot, "bucket").where("node <> pivot").select(*_ordered("node", "pivot")).distinct()
    starred = stage(_sketched(starred, info, t), scope)
    links = stage(_verified(starred, fetch(_ends(starred)), t), scope)
    classes = components(links, scope)

    # A link between buckets of both kinds may be counted in the small ones too rarely: its share of large buckets is allowed for.
    few = small.join(crowded, "node", "left").withColumn("shown", F.col("shown") - F.coalesce("large", F.lit(0))).drop("large")
    few = few.join(classes, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = F.greatest(F.lit(1), F.least("shown", "shown_") - _differences(t, "size", "size_")).cast("int").alias("least")
    met = few.join(_second(few, "bucket"), "bucket").where((F.col("node") < F.col("node_")) & (F.col("comp") != F.col("comp_")) & _able(t, "size", "size_"))
    pairs = _counted(met.select(F.col("node").alias("a"), F.col("node_").alias("b"), least))
    pairs = stage(_sketched(pairs, info, t), scope)
    sets = fetch(_ends(pairs))

    forest = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b")).select(*_ordered("a", "b")).distinct()
    links = links.unionByName(stage(_verified(forest, sets, t), scope))
    classes = components(links, scope)
    more = stage(_verified(_parted(pairs, classes), sets, t), scope)
    if not more.isEmpty():
        links = links.unionByName(more)
        classes = components(links, scope)
    if hot.isEmpty():
        return classes
    named = hot.join(classes, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    apart = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    # A link that shares a small bucket was a candidate above, so these share as many large ones as a link does.
    left = named.join(apart, "bucket").join(info.select("node", "sketch"), "node")
    late = stage(_counted(_late(left, t)), scope)
    if not late.isEmpty():
        more = stage(_verified(late, fetch(_ends(late)), t), scope)
        classes = components(links.unionByName(more), scope)
    return classes


def _common(row: np.ndarray, element: np.ndarray, one: np.ndarray, two: np.ndarray, width: int = 4096) -> np.ndarray:
    """How many elements the sets ``one`` and ``two`` (row numbers) have in common, as a matrix."""
    _, at, n = np.unique(element, return_inverse=True, return_counts=True)
    shared = n[at] > 1
    row, column = row[shared], (np.cumsum(n > 1) - 1)[at[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(one), len(two)))
    for start in range(0, int((n > 1).sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        held = np.zeros((max(one.max(), two.max()) + 1, width), np.float32)
        held[row[lo:hi], column[lo:hi] - start] = 1
        both += held[one] @ held[two].T
    return both


def degrees(classes: DataFrame, fetch: Callable[[DataFrame], DataFrame], t: Fraction, scope: str, most: int = 256, room: int = 1_000_000) -> DataFrame:
    """(node, n_links): how many other nodes each node of ``classes`` (node, comp) is linked with.

    All links are inside components.  Two nodes of their own have one.  A larger component is cut in blocks of about ``most``
    sets and ``room`` elements, every two of its blocks are a group of their own, and a task counts the links of a group
    by a product of incidence matrices.  A row leaves for each set of a group, none for a pair.
    """
    p, q = t.numerator, t.denominator
    several = classes.groupBy("comp").agg(F.count("*").alias("n"))
    wanted = classes.join(several.where("n > 2"), "comp").select("node", "comp")
    held = fetch(wanted.select("node")).join(wanted, "node")
    cut = held.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum(F.size("elements").cast("long")) / room)).cast("int").alias("blocks"))
    dealt = held.join(cut, "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "elements")

    def run(group: pa.Table) -> pa.Table:
        block, node, lists = group.column("block").to_numpy(), group.column("node").to_numpy(), group.column("elements").combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        i, j = (group.column(c)[0].as_py() for c in ("i", "j"))
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(one) or not len(two):
            return pa.table({"node": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64())})
        both = _common(np.repeat(np.arange(len(node)), size), lists.flatten().to_numpy(), one, two)
        linked = both * (p + q) >= p * (size[one][:, None] + size[two])
        linked &= node[one][:, None] != node[two]
        ends = [(one, 1)] if i == j else [(one, 1), (two, 0)]
        return pa.table({"node": np.concatenate([node[at] for at, _ in ends]), "n_links": np.concatenate([linked.sum(axis) for _, axis in ends])})

    counted = dealt.groupBy("comp", "i", "j").applyInArrow(run, "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))
    return counted.unionByName(classes.join(several.where("n = 2"), "comp").select("node", F.lit(1).cast("long").alias("n_links")))


def _parted(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    out = pairs.join(classes.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a", "left").join(classes.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b", "left")
    return out.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def meeting(entries: DataFrame, scope: str) -> DataFrame:
    """Distinct (bucket, node) rows of the buckets in which different nodes meet.

    Buckets are counted by partial aggregates, so that a hot bucket costs a row for each task;
    only entries of buckets with company are moved whole, through a join that may be split.
    """
    counts = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = stage(entries.join(counts, "bucket").distinct(), scope)
    several = members.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket")
    return stage(members.join(several, "bucket"), scope)
