"""Spelling variants: words at distance one, by a self-join of a prefix-partitioned trie.

Two words at distance one agree up to the place of the edit (their longest common prefix)
and after it.  So the vocabulary is dealt out as many small tries: a partition ``(m, a, e)`` holds
the words of lengths m and m + 1 with one prefix of ``a`` code points and one suffix of ``m - e``,
and answers for the pairs, of a word of length m and one of either length, whose common prefix
is in ``[a, e)``.  First the range of all places is halved, which cuts near the root of a trie
of the words and of one of the words read backwards; partitions of over ``most`` words are
halved again, until they are small or a single place is left (then the alphabet bounds them).  Each pair belongs to
exactly one partition, so none is lost or found twice.

In a partition, a trie of what stands between prefix and suffix is joined with itself:
the active nodes of a node, those within distance one, follow from its parent's, and
terminals that are active for a terminal are pairs.

Shape at scale: words are counted by partial aggregates before anything moves; a word goes to
four partitions, and no word visits the others.  A hot prefix is halved, not sampled.
"""

from __future__ import annotations

import itertools
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, partitions, stage

_RUNS = r"[^A-Za-zÀ-ÿ]+"


def vocabulary(docs: DataFrame, least_length: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """(word, n) of the words of at least ``least_length`` code points that occur ``least`` times over all texts.

    Where ``every`` (0: never) divides the crc32 of ``doc_id:run``, the run's code point
    crc32 % length is deleted first.  Null texts have no words; a null doc_id reads as empty.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(F.filter(F.split("text", _RUNS), lambda w: F.length(w) >= least_length)).alias("_run"))
    word = F.when(F.col("_run").rlike("[A-Z]"), lower_ascii(F.col("_run"))).otherwise(F.col("_run"))
    rows = runs.select("_id", word.alias("_run"))
    if every:
        coded = rows.select("_run", F.crc32(F.concat("_id", F.lit(":"), "_run")).alias("_h"), F.length("_run").alias("_length"))
        at = (F.col("_h") % F.col("_length")).cast("int")
        cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.col("_length")))
        rows = coded.select(F.when(F.col("_h") % every == 0, cut).otherwise(F.col("_run")).alias("_run"))
    return rows.where(F.length("_run") >= least_length).groupBy(F.col("_run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _dealt(words: DataFrame, ranges: Column) -> DataFrame:
    """(word, n, m, a, e, key) for each of a word's ranges ``struct<m, a, e>``."""
    rows = words.select("word", "n", F.explode(ranges).alias("r")).select("word", "n", "r.m", "r.a", "r.e")
    tail = F.greatest(F.col("m") - F.col("e"), F.lit(0))
    end = F.substring("word", F.length("word") - tail + 1, tail)
    return rows.select("*", F.concat_ws(":", "m", "a", "e", F.substring("word", F.lit(1), F.col("a")), end).alias("key"))


def _range(m: Column, a: Column, e: Column) -> Column:
    return F.struct(m.cast("int").alias("m"), a.cast("int").alias("a"), e.cast("int").alias("e"))


def _halves(m: Column, a: Column, e: Column) -> tuple[Column, Column]:
    middle = F.floor((a + e) / 2)
    return _range(m, a, middle), _range(m, middle, e)


def dealt(words: DataFrame, most: int = 4096, scope: str | None = None) -> DataFrame:
    """Rows of `_dealt` so that no partition of more than one place has over ``most`` words."""
    own = scope or f"spelling-{uuid.uuid4().hex}"
    length = F.length("word")
    bands = [pair for m in (length, length - 1) for pair in _halves(m, F.lit(0), m + 1)]
    rows = _dealt(words, F.array(*bands))
    done = None
    while True:
        hot = rows.where(F.col("e") - F.col("a") > 1).groupBy("key").agg(F.count("*").alias("_words")).where(F.col("_words") > most)
        hot = stage(hot.select(F.col("key").alias("_hot")), own)
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(hot, rows["key"] == hot["_hot"], "left_anti")
        done = small if done is None else done.unionByName(small)
        large = rows.join(hot, rows["key"] == hot["_hot"], "left_semi").drop("key")
        rows = stage(_dealt_again(large), own)


def _dealt_again(rows: DataFrame) -> DataFrame:
    halves = F.array(*_halves(F.col("m"), F.col("a"), F.col("e")))
    return _dealt(rows.select("word", "n", halves.alias("_ranges")), F.col("_ranges"))


def trie_pairs(words: list[str], m: int, a: int, e: int):
    """(i, j) of the pairs at distance one that the partition ``(m, a, e)`` answers for."""
    tail = max(m - e, 0)
    children: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]
    for i, word in enumerate(words):
        node = 0
        for c in word[a : len(word) - tail]:
            below = children[node]
            node = below.get(c)
            if node is None:
                node = below[c] = len(children)
                children.append({})
                ends.append(-1)
        ends[node] = i
    stack = [(0, tuple(children[0].values()))]
    while stack:
        node, active = stack.pop()
        if (i := ends[node]) >= 0:
            for y in active:
                j = ends[y]
                if j > i and (len(words[i]) == m or len(words[j]) == m) and _common(words[i], words[j], a) < e:
                    yield i, j
        below = children[node]
        beside = tuple(below.values()) if len(below) > 1 else ()
        for c, child in below.items():
            # Distance one of the child: its parent (delete), its siblings (replace), its children (insert),
            # and what the parent's active nodes have below under the same letter.
            near = {z for y in active if (z := children[y].get(c)) is not None}
            near.add(node)
            near.update(beside)
            near.update(children[child].values())
            near.discard(child)
            stack.append((child, near))


def _common(x: str, y: str, a: int) -> int:
    """Length of the longest common prefix, ``a`` or more."""
    for k in range(a, min(len(x), len(y))):
        if x[k] != y[k]:
            return k
    return min(len(x), len(y))


def near_pairs(words: DataFrame, most: int = 4096, scope: str | None = None) -> DataFrame:
    """(word, near, near_n): every two words at distance one, in both directions.  ``words`` has distinct words."""

    def run(batches):
        held: list[tuple] = []
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n"))))
        for key, group in itertools.groupby(rows, key=lambda r: r[0]):
            group = list(group)
            if len(group) < 2:
                continue
            m, a, e, *_ = key.split(":")
            for i, j in trie_pairs([g[1] for g in group], int(m), int(a), int(e)):
                held.append((group[i][1], group[j][1], group[j][2]))
                held.append((group[j][1], group[i][1], group[i][2]))
                if len(held) >= 20_000:
                    yield batch_of(held)
                    held = []
        if held:
            yield batch_of(held)

    def batch_of(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.string(), pa.int64()))], ["word", "near", "near_n"])

    rows = dealt(words, most, scope).select("key", "word", "n")
    rows = rows.repartition(partitions(words.sparkSession), "key").sortWithinPartitions("key", "word")
    return rows.mapInArrow(run, "word string, near string, near_n long")


def spelling_variants(docs: DataFrame, least_length: int = 7, least: int = 2, times: int = 10, every: int = 31, most: int = 4096, scope: str | None = None) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the `vocabulary`.

    ``form`` is the near word of largest n, the smallest in code-point order among equals, if that n is
    at least ``times`` the word's; ``root`` is where forms lead, the word itself without one.
    Counts grow ``times``-fold along a chain, so its length is bounded by the logarithm of
    the largest count, and pointers are doubled that often.  Empty tables and texts give no
    rows; rows that repeat count; other columns are not read.
    """
    if times < 2:
        raise ValueError("times must be 2 or more, or forms could lead in circles")
    scope = scope or f"spelling-{uuid.uuid4().hex}"
    words = stage(vocabulary(docs, least_length, least, every), scope)
    none = F.lit(None).cast("struct<less:bigint,near:string>")
    own = words.select("word", "n", none.alias("at"))
    met = near_pairs(words, most, scope).select("word", F.lit(None).cast("long").alias("n"), F.struct((-F.col("near_n")).alias("less"), "near").alias("at"))
    each = own.unionByName(met).groupBy("word").agg(F.max("n").alias("n"), F.count("at").alias("n_near"), F.min("at").alias("at"))
    chosen = -F.col("at.less") >= times * F.col("n")
    found = stage(each.select("word", "n", "n_near", F.when(chosen, F.col("at.near")).alias("form"), F.when(chosen, -F.col("at.less")).alias("form_n")), scope)
    largest = words.agg(F.max("n")).first()[0] or 0
    depth, count = 0, max(least, 1)
    while count * times <= largest:
        depth, count = depth + 1, count * times
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(depth - 1, 0).bit_length()):
        further = roots.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        roots = stage(roots.join(further, F.col("root") == F.col("_from"), "left").select("word", F.coalesce("_to", "root").alias("root")), scope)
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
