"""Substring dedup by paragraph MinHash banding.

Units of a text are its paragraphs (lines of at least ``least`` words) and, so that a
passage inside longer lines is seen too, windows of 25 words.  Of 26 windows that follow each
other, the one whose first words have the smallest hash is a unit (winnowing), so any passage of
50 words has a unit that lies inside it, and about one window in 13 is kept.  Windows are seeds only: each
place is extended by the words before and after it that another document has there too (`_extended`),
so passages are reported and removed up to their ends.  Equal units are one node.  Paragraphs get MinHash signatures of
their word 5-grams; bands, tuned for a recall at the threshold, put paragraphs into
buckets; those that collide are verified by exact Jaccard and clustered by components.
The first occurrence of a component, by doc_id, stays; the others are removed.

Shape at scale: texts are cut once and never move; units are hashes with a place, staged in
the shared folder.  Equal units are counted by partial aggregates, so a passage in a third of all documents costs a row for each task, and
near copies go through `links.link`, which makes no pairs inside what is already linked.
"""

from __future__ import annotations

import uuid
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, release
from .common import stage_freed as stage
from .jaccard import _lists, _signed, _words, mix, text_key
from .links import link, meeting, sketch
from .tokens import slices

_U = np.uint64
WINDOW = 25
NEXT = 26  # of so many windows in a row one is a unit at least
REACH = NEXT - 1  # so an end of a passage of WINDOW + REACH words is no further from its nearest unit
STRIDE = 5


@lru_cache(None)
def tune_bands(threshold: float, recall: float = 0.999, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the fewest hash values with that recall at the threshold, preferring few chance collisions.

    Pairs at Jaccard j collide with probability 1 - (1 - j**rows)**bands.
    """
    best = None
    for rows in range(2, 13):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                chance = sum(1 - (1 - (threshold * k / 20) ** rows) ** bands for k in range(1, 13))
                if best is None or bands + 4 * chance < best[0]:
                    best = bands + 4 * chance, (bands, rows)
                break
    return best[1]


def _hashes(words: list[bytes]) -> np.ndarray:
    if len(_words) > 500_000:
        _words.clear()
    return np.array(list(map(_words.__getitem__, words)), np.uint64)


def _roll(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = np.full(len(at), width, np.uint64)
    for k in range(width):
        out = mix(out + h[at + k]) + _U(k)
    return out


def _winnowed(h: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Starts of the windows that are units; ``end``: where the text of each word ends.

    What is chosen inside a passage depends on the passage alone.  Texts with fewer than ``NEXT``
    windows have none.
    """
    n = len(h) - WINDOW - NEXT + 2
    if n <= 0:
        return np.zeros(0, np.int64)
    low = (mix(h[:-1] + (h[1:] << _U(1))) >> _U(32) << _U(32)) + np.arange(len(h) - 1, dtype=np.uint64)  # the first of equals
    width = 1
    while 2 * width <= NEXT:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[NEXT - width : NEXT - width + n])
    inside = np.arange(n) + WINDOW + NEXT - 1 <= end[:n]
    return np.unique(low[inside] & _U(0xFFFFFFFF)).astype(np.int64)


class Cut:
    """The units of a batch of texts, as flat arrays.

    Paragraphs and windows have a hash, a first word (counted in their text from 0) and the
    number of their text; ``grams`` holds the paragraphs' shingles one after the other.
    """

    def __init__(self, texts: list[str | None], least: int, n: int, windows: bool = True):
        cut = [[line.split() for line in (t or "").encode().lower().split(b"\n")] for t in texts]
        h = _hashes([w for lines in cut for line in lines for w in line])
        lengths = np.array([len(line) for lines in cut for line in lines], np.int64)
        line_text = np.repeat(np.arange(len(cut)), [len(lines) for lines in cut])
        firsts = np.cumsum(lengths) - lengths
        text_words = np.bincount(line_text, weights=lengths, minlength=len(cut)).astype(np.int64)
        text_end = np.cumsum(text_words)
        text_first = text_end - text_words

        chosen = lengths >= max(least, n)
        first, self.words, self.text = firsts[chosen], lengths[chosen], line_text[chosen]
        self.at = first - text_first[self.text]
        self.count = self.words - n + 1
        self.starts = np.cumsum(self.count) - self.count
        place = np.arange(int(self.count.sum())) - np.repeat(self.starts, self.count)
        self.grams = _roll(h, np.repeat(first, self.count) + place, n)
        # A paragraph's hash is that of its word sequence: its grams, each with its place.  ``check`` makes it 128 bits.
        placed = mix(self.grams + _U(0x9E3779B97F4A7C15) * (place + 1).astype(np.uint64))
        whole = lambda x: np.bitwise_xor.reduceat(x, self.starts) if len(self.starts) else np.zeros(0, np.uint64)
        self.unit, self.check = whole(placed), whole(mix(placed + _U(1)))

        self.window_at = self.window_text = np.zeros(0, np.int64)
        self.window = self.window_check = np.zeros(0, np.uint64)
        if windows and len(h) >= WINDOW:
            start = _winnowed(h, np.repeat(text_end, text_words))
            self.window_text = np.searchsorted(text_end, start, "right")
            self.window_at = start - text_first[self.window_text]
            self.window, self.window_check = mix(_roll(h, start, WINDOW)), mix(_roll(mix(h), start, WINDOW))

    def sets(self) -> list[np.ndarray]:
        return [np.unique(self.grams[a : a + c]) for a, c in zip(self.starts.tolist(), self.count.tolist())]

    def band_keys(self, bands: int, rows: int) -> np.ndarray:
        """A row of band keys for each paragraph's set of grams."""
        out = np.empty((len(self.unit), bands), np.uint64)
        if not len(out):
            return out
        for b in range(bands):
            key = np.full(len(out), b + 1, np.uint64)
            for r in range(rows):
                seed = mix(np.array([b * rows + r + 1], np.uint64))[0]
                key = mix(key + np.minimum.reduceat((self.grams ^ seed) * (seed | _U(1)), self.starts))
            out[:, b] = key
        return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")


def units(docs: DataFrame, least: int, n: int, bands: int, rows: int) -> DataFrame:
    """(row, doc_id, text_key, unit, check, at, words, buckets) per document, all but the first three arrays.

    Paragraphs come before windows, whose ``words`` are 0; ``buckets`` has the paragraphs' band keys one after the other.
    """
    schema = "row long, doc_id long, text_key long, unit array<long>, check array<long>, at array<int>, words array<int>, buckets array<long>"

    def nested(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values.astype(kind, copy=False)))

    def run(batches):
        for batch in (s for x in batches for s in slices(x)):
            c = Cut(batch.column("text").to_pylist(), least, n)
            m = batch.num_rows
            text = np.concatenate([c.text, c.window_text])
            order = np.argsort(text, kind="stable")
            each = np.bincount(text, minlength=m)
            cat = lambda p, w: np.concatenate([p, w])[order]
            keys = c.band_keys(bands, rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), nested(cat(c.unit, c.window).view(np.int64), each, np.int64), nested(cat(c.check, c.window_check).view(np.int64), each, np.int64), nested(cat(c.at, c.window_at), each, np.int32),
                 nested(cat(c.words, np.zeros(len(c.window), np.int64)), each, np.int32), nested(keys.reshape(-1).view(np.int64), bands * np.bincount(c.text, minlength=m), np.int64)],
                names=["row", "doc_id", "text_key", "unit", "check", "at", "words", "buckets"],
            )

    return _keyed(docs).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text_key", "text").mapInArrow(run, schema)


def _named(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """The texts that ``lists`` (id, key, and more) names, joined with it.  Only those move."""
    names = broadcast_if_small(lists.select(F.col("id").alias("id_"), F.col("key").alias("key_")), 500_000)  # two longs a row
    same = lambda a, b: F.col("doc_id").eqNullSafe(F.col(a)) & (text_key(F.col("text")) == F.col(b))
    return docs.select("doc_id", "text").join(names, same("id_", "key_"), "left_semi").join(lists, same("id", "key"))


def _sets(docs: DataFrame, one: DataFrame, least: int, n: int, scope: str) -> DataFrame:
    """(node, elements, size, sketch) of the paragraphs in ``one`` (unit, id, key, again), cut from the document that is named there."""
    asked = one.groupBy("id", "key").agg(F.collect_list("unit").alias("asked"), F.max("again").alias("again"))  # of one document
    found = _named(docs, stage(asked, scope)).select("text", "asked", "again")

    def run(batches):
        for batch in (s for x in batches for s in slices(x)):
            c = Cut(batch.column("text").to_pylist(), least, n, windows=False)
            asked = [set(x) for x in batch.column("asked").to_pylist()]
            rows, first = [], set()
            for i, (of, unit) in enumerate(zip(c.text.tolist(), c.unit.view(np.int64).tolist())):
                if unit in asked[of] and (of, unit) not in first:
                    first.add((of, unit))
                    rows.append(i)
            sets = [np.unique(c.grams[a : a + k]) for a, k in zip(c.starts[rows].tolist(), c.count[rows].tolist())]
            yield pa.RecordBatch.from_arrays(
                [_signed(c.unit[rows]), _lists(sets), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s) for s in sets], pa.binary()), batch.column("again").take(pa.array(c.text[rows]))],
                names=["node", "elements", "size", "sketch", "again"],
            )

    sets = stage(found.mapInArrow(run, "node long, elements array<long>, size int, sketch binary, again boolean"), scope)
    # Rows that repeat doc_id and text were all read.
    return sets.where("NOT again").drop("again").unionByName(sets.where("again").drop("again").dropDuplicates(["node"]))


def _contexts(docs: DataFrame, seeds: DataFrame, scope: str) -> DataFrame:
    """The windows of ``seeds`` with ``before`` (where ``back``) and ``after`` (where ``on``): codes of the window and its next 1, 2, ... ``REACH`` words on that side, as far as the text goes."""
    schema = "doc_id long, text_key long, at int, component long, kept boolean, first_doc long, before array<long>, after array<long>"
    each = seeds.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "component", "kept", "first_doc", "back", "on")).alias("seeds"))  # of one document
    each = stage(each.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "seeds"), scope)
    found = _named(docs, each).select(F.col("id").alias("doc_id"), F.col("key").alias("text_key"), "text", "seeds")

    def run(batches):
        for batch in (s for x in batches for s in slices(x)):
            texts = [t.encode().lower().split() for t in batch.column("text").to_pylist()]
            h = _hashes([w for words in texts for w in words])
            ends = np.cumsum([len(words) for words in texts])
            firsts = np.append(0, ends[:-1])
            lists = batch.column("seeds")
            of, flat = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten()
            at, component = flat.field("at").to_numpy(), flat.field("component").to_numpy()
            start = firsts[of] + at
            sides = []
            for step, edge, room, asked in ((-1, start, at, "back"), (1, start + WINDOW - 1, ends[of] - start - WINDOW, "on")):
                room = np.where(flat.field(asked).to_numpy(zero_copy_only=False), np.minimum(room, REACH), 0)
                codes, code = np.empty((len(at), REACH), np.uint64), mix(component.view(np.uint64) + _U(step + 2))
                for k in range(REACH):
                    code = codes[:, k] = mix(code + h[np.clip(edge + step * (k + 1), 0, len(h) - 1)]) + _U(k)
                offsets = pa.array(np.append(0, np.cumsum(room)), pa.int32())
                sides.append(pa.ListArray.from_arrays(offsets, _signed(codes[np.arange(REACH) < room[:, None]])))
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("text_key").take(rows), flat.field("at"), flat.field("component"), flat.field("kept"), flat.field("first_doc"), *sides],
                names=["doc_id", "text_key", "at", "component", "kept", "first_doc", "before", "after"],
            )

    return found.mapInArrow(run, schema)


def _extended(docs: DataFrame, seeds: DataFrame, scope: str, removed: bool = False) -> DataFrame:
    """``seeds`` (places of windows that several documents have) as spans up to the ends of what is shared.

    A removed place reaches as far as some earlier document goes on alike, a kept one as far as any
    other does; what only later documents share next to a removed place is a kept span.  Words are
    compared by grouping codes of the window and its k next words, never place by place: first for
    every ``STRIDE``-th k, then for those between where places that were alike so far part.  A side on which
    the next window of the text follows without a gap, kept or removed as well, needs no words: that window goes as
    far.  Where windows cover the next ``REACH`` words, two of the places that have the same ones stand for all;
    where words do, places with the same ones are compared as one.  With ``removed`` only the removed spans are given, one for a place.
    """
    doc = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("text_key").alias("k"))
    turn = Window.partitionBy("doc_id", "text_key").orderBy("at")
    at = lambda f, k: f("at", k).over(turn)

    def ahead(f) -> tuple:
        """(whether the text goes on with the next window, the windows of the next ``REACH`` words, null unless three at most cover them)."""
        joined, code, done = F.lit(True), F.array(), F.lit(False)
        flags = []
        for k in (1, 2, 3):
            before = at(f, k - 1) if k > 1 else F.col("at")
            joined = joined & F.coalesce((F.abs(at(f, k) - before) <= WINDOW) & (f("kept", k).over(turn) == F.col("kept")), F.lit(False))
            flags.append(joined)
            code = F.when(joined & ~done, F.concat(code, F.array(f("component", k).over(turn), (at(f, k) - F.col("at")).cast("long")))).otherwise(code)
            done = done | (joined & (F.abs(at(f, k) - F.col("at")) >= REACH))
        return flags[0], F.when(done, code)

    (backed, prev), (followed, next_) = ahead(F.lag), ahead(F.lead)
    own = f"{scope}/{uuid.uuid4().hex}"
    seeds = seeds.distinct().select("*", backed.alias("backed"), prev.alias("prev"), followed.alias("followed"), next_.alias("next"), doc.alias("doc"))
    seeds = stage(seeds, own)
    seeds = seeds.withColumn("back", ~F.col("backed")).withColumn("on", ~F.col("followed"))
    open_ = seeds.where("back OR on").groupBy("component").agg(F.max("back").alias("b"), F.max("on").alias("o"))
    # Of the places that go on with the same windows, the first and the last document stand for all.
    closed = seeds.join(open_, "component")
    seeds = closed.withColumn("back", F.col("back") | (F.col("b") & F.col("prev").isNull())).withColumn("on", F.col("on") | (F.col("o") & F.col("next").isNull())).drop("b", "o").unionByName(seeds.join(open_, "component", "left_anti"))
    edge = lambda f: f(F.struct("doc", "at"))
    stand = lambda side, when, other: closed.where(when).groupBy("component", other).agg(edge(F.min).alias("lo"), edge(F.max).alias("hi")).select(F.explode(F.array("lo", "hi")).alias("e"), F.lit(side).alias("side"))
    marks = stand("back", "b AND backed AND prev IS NOT NULL", "prev").unionByName(stand("on", "o AND followed AND next IS NOT NULL", "next"))
    marks = stage(marks.groupBy("e.doc", "e.at").agg(F.bool_or(F.col("side") == "back").alias("mb"), F.bool_or(F.col("side") == "on").alias("mo")), own)
    none = F.lit(False)
    seeds = seeds.join(marks, ["doc", "at"], "left").withColumn("back", F.col("back") | F.coalesce("mb", none)).withColumn("on", F.col("on") | F.coalesce("mo", none))
    seeds = stage(seeds.select("doc_id", "text_key", "at", "component", "kept", "first_doc", "back", "on"), scope)
    release(docs.sparkSession, own)
    whole = seeds.where("NOT (back OR on)").select("doc_id", "text_key", "at", F.lit(WINDOW).alias("words"), "component", "kept", "first_doc")
    seeds = seeds.where("back OR on")
    places = _contexts(docs, seeds, own).withColumn("place", F.monotonically_increasing_id()).withColumn("doc", doc)
    last_code = lambda side: F.get(side, F.size(side) - 1)  # noqa: E731  # null where the text has no word there
    coded_places = f"{scope}/{uuid.uuid4().hex}"
    full = stage(places.withColumn("ctx_b", last_code("before")).withColumn("ctx_a", last_code("after")), coded_places)
    places = stage(full.drop("before", "after"), scope)

    # Places with the same words on a side are one context there; only contexts are compared.
    def topped(ctx: str, back: bool) -> DataFrame:
        met = places.where(F.col(ctx).isNotNull()).groupBy(F.col(ctx).alias("ctx")).agg(F.min(F.struct("doc", "place")).alias("f"), F.max("doc").alias("last"))
        return met.withColumn("back", F.lit(back))

    tops = topped("ctx_b", True).unionByName(topped("ctx_a", False))
    tops = tops.select("ctx", "last", F.col("f.doc").alias("first"), "f.place", "back").join(full.select("place", "component", "before", "after"), "place")
    contexts = stage(tops.select("ctx", "back", "component", "first", "last", F.when(F.col("back"), F.col("before")).otherwise(F.col("after")).alias("codes")), own)
    release(docs.sparkSession, coded_places)

    def met(coded: DataFrame) -> DataFrame:
        """Of the codes that several documents have: the first of these, and whether the contexts part before the next code."""
        groups = coded.groupBy("code").agg(F.min("first").alias("from"), F.max("last").alias("to"), F.min("next").alias("lo"), F.max("next").alias("hi")).where("from <> to")
        return coded.select("ctx", "k", "code").join(groups.select("code", "from", (F.col("lo") != F.col("hi")).alias("parts")), "code").drop("code")

    def coded(rows: DataFrame, levels) -> DataFrame:
        return rows.select("ctx", "first", "last", F.explode(levels).alias("x")).select("ctx", "first", "last", "x.*")

    code = lambda k: F.coalesce(F.get("codes", k - 1), F.lit(0))  # noqa: E731  # 0: the text ends
    levels = F.filter(F.array(*[F.lit(k) for k in range(0, REACH + 1, STRIDE)]), lambda k: k <= F.size("codes"))
    rough = F.transform(levels, lambda k: F.struct(k.alias("k"), F.when(k == 0, F.xxhash64("component", "back")).otherwise(code(k)).alias("code"), F.when(k < REACH, code(k + STRIDE)).otherwise(0).alias("next")))
    each = F.transform("codes", lambda c, i: F.struct((i + 1).alias("k"), c.alias("code"), F.lit(0).cast("long").alias("next")))
    fine = F.filter(each, lambda x: (x["k"] % STRIDE != 0) & F.array_contains("parted", x["k"] - x["k"] % STRIDE))

    first = stage(met(coded(contexts, rough)), own)
    parted = first.where("parts").groupBy("ctx").agg(F.collect_set("k").alias("parted"))  # some
    found = first.drop("parts").unionByName(met(coded(contexts.join(parted, "ctx"), fine)).drop("parts"))
    # How far each document that is the first somewhere goes on alike: some rows of a context, of REACH + 1 at most.
    reached = found.groupBy("ctx", "from").agg(F.max("k").alias("k")).groupBy("ctx").agg(F.collect_list(F.struct("from", "k")).alias("reach"))
    reached = stage(reached, scope)
    release(docs.sparkSession, own)
    far = lambda steps: F.coalesce(F.array_max(F.transform(steps, lambda x: x["k"])), F.lit(0))
    done = places.where("NOT kept") if removed else places
    for c in "ba":
        # A side without words meets nothing; its key is its own, so that such places spread.
        done = done.withColumn("ctx", F.coalesce(f"ctx_{c}", F.xxhash64("place"))).join(reached, "ctx", "left")
        done = done.withColumn(f"r{c}", far(F.filter("reach", lambda x: x["from"] < F.col("doc")))).withColumn(f"s{c}", far(F.col("reach"))).drop("ctx", "reach")
    start, end = F.col("at"), F.col("at") + WINDOW
    span = lambda a, b, kept, first: F.struct(a.cast("int").alias("at"), (b - a).cast("int").alias("words"), kept.alias("kept"), first.alias("first_doc"))
    own, gone = F.col("kept"), ~F.col("kept")
    if removed:
        return whole.where("NOT kept").unionByName(done.select("doc_id", "text_key", (start - F.col("rb")).cast("int").alias("at"), (end + F.col("ra") - start + F.col("rb")).cast("int").alias("words"), "component", "kept", "first_doc"))
    spans = F.array(
        span(start - F.when(own, F.col("sb")).otherwise(F.col("rb")), end + F.when(own, F.col("sa")).otherwise(F.col("ra")), own, F.col("first_doc")),
        F.when(gone & (F.col("sb") > F.col("rb")), span(start - F.col("sb"), start - F.col("rb"), F.lit(True), F.col("doc_id"))),
        F.when(gone & (F.col("sa") > F.col("ra")), span(end + F.col("ra"), end + F.col("sa"), F.lit(True), F.col("doc_id"))),
    )
    flat = done.select("doc_id", "text_key", "component", F.explode(F.array_compact(spans)).alias("s"))
    return whole.unionByName(flat.select("doc_id", "text_key", "s.at", "s.words", "component", "s.kept", "s.first_doc"))


def repeats(docs: DataFrame, least: int = 20, n: int = 5, threshold: float = 0.8, recall: float = 0.999, scope: str = "paragraphs", removed: bool = False) -> DataFrame:
    """(doc_id, text_key, at, words, component, kept): units that occur in several documents, windows extended; with ``removed`` those alone that aren't kept.

    ``at`` counts words of the text from 0.  The first unit of a component, by doc_id (nulls
    last), then text, then place, is ``kept``; so are those of the component in that document.
    """
    own, last = f"{scope}/{uuid.uuid4().hex}", scope
    scope = own  # what the places of units are made from; it goes once they are written
    bands, rows = tune_bands(threshold, recall)
    t = Fraction(threshold).limit_denominator(1000)
    cut = stage(units(docs, least, n, bands, rows), scope)
    banded = cut.select(F.explode(F.transform("buckets", lambda x, i: F.struct(x.alias("bucket"), F.get(F.col("unit"), F.floor(i / bands).cast("int")).alias("node")))).alias("e")).select("e.bucket", "e.node")
    members = meeting(banded, scope)
    near = members.select(F.col("node").alias("unit")).distinct()

    found = cut.select("row", F.explode(F.arrays_zip("unit", "check", "at", "words")).alias("u")).select("row", "u.unit", "u.check", "u.at", "u.words")
    shared = cut.select(F.explode("unit").alias("unit")).groupBy("unit").agg(F.count("*").alias("n")).where("n > 1").select("unit")
    wanted = stage(shared.unionByName(near).distinct(), scope)
    some = found.join(broadcast_if_small(wanted, 500_000), "unit")  # a long a row
    some = stage(some.join(cut.select("row", "doc_id", "text_key"), "row").drop("row"), scope)

    one = some.groupBy("unit").agg(F.min(F.struct("doc_id", "text_key")).alias("o")).join(near, "unit", "left_semi").select("unit", F.col("o.doc_id").alias("id"), F.col("o.text_key").alias("key"))
    twice = cut.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg((F.count("*") > 1).alias("again"))
    twice = twice.where("again").select(F.col("id").alias("id_"), F.col("key").alias("key_"), "again")
    one = one.join(twice, F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")), "left").select("unit", "id", "key", F.coalesce("again", F.lit(False)).alias("again"))
    sets = _sets(docs, one, least, n, scope)
    nodes = sets.select("node", "size", F.lit(0).alias("shown"), "sketch")
    comp = link(members, nodes, lambda asked: sets.select("node", "elements").join(asked, "node", "left_semi"), t, scope)
    comp = comp.withColumnRenamed("node", "unit")

    # Paragraphs of a component were compared; all other units are equal by 128 bits.
    placed = some.join(comp, "unit", "left").withColumn("check", F.when(F.col("comp").isNull(), F.col("check")).otherwise(0)).withColumn("component", F.coalesce("comp", "unit")).drop("comp", "unit")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc"), F.col("text_key").alias("key"))
    groups = placed.groupBy("component", "check").agg(F.min(order).alias("f"), F.min("text_key").alias("lo"), F.max("text_key").alias("hi"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.bool_or(F.col("doc_id").isNull()).alias("null"))
    groups = groups.where("lo <> hi OR a <> b OR null AND a IS NOT NULL").select("component", "check", F.col("f.doc").alias("first_doc"), F.col("f.key").alias("first_key"))
    out = placed.join(groups, ["component", "check"])
    kept = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("text_key") == F.col("first_key"))
    out = stage(out.select("doc_id", "text_key", "at", "words", F.xxhash64("component", "check").alias("component"), kept.alias("kept"), "first_doc"), last)
    release(docs.sparkSession, own)
    paragraphs = out.where("words > 0 AND NOT kept" if removed else "words > 0")
    return paragraphs.unionByName(_extended(docs, out.where("words = 0"), last, removed))


def _merged(spans) -> str:
    """Spans (sorted by start) merged where they touch."""
    return (
        f"aggregate({spans}, CAST(array() AS array<struct<at:int,to:int>>), (a, x) -> IF(size(a) > 0 AND element_at(a, -1).to >= x.at, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('at', element_at(a, -1).at, 'to', greatest(element_at(a, -1).to, x.to)))), "
        "concat(a, array(named_struct('at', x.at, 'to', x.to)))))"
    )


def repeat_report(docs: DataFrame, least: int = 20, n: int = 5, threshold: float = 0.8, recall: float = 0.999, scope: str = "paragraphs") -> DataFrame:
    """A row for each passage that a document shares with others: doc_id, start and end (words from 0), n_words, removed, first_doc.

    Overlapping units are one passage, apart for those removed and those kept.  ``first_doc``
    is the smallest doc_id that keeps a unit of it.  Null and empty texts have none; rows
    that repeat doc_id and text are one document; an empty table gives none; other columns
    are not looked at.
    """
    found = repeats(docs, least, n, threshold, recall, scope)
    spans = found.groupBy("doc_id", "text_key", "kept").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("words")).alias("to")))).alias("s"), F.min("first_doc").alias("first_doc"))  # of one document
    flat = spans.select("doc_id", "kept", "first_doc", F.explode(F.expr(_merged("s"))).alias("p"))
    return flat.select("doc_id", F.col("p.at").alias("start"), F.col("p.to").alias("end"), (F.col("p.to") - F.col("p.at")).alias("n_words"), (~F.col("kept")).alias("removed"), "first_doc")


def remove(docs: DataFrame, least: int = 20, n: int = 5, threshold: float = 0.8, recall: float = 0.999, scope: str = "paragraphs") -> DataFrame:
    """``docs`` without the repeated passages; n_chars, if there, follows; texts left without a word go.

    Documents with nothing to remove are untouched.  Other columns stay.
    """
    found = repeats(docs, least, n, threshold, recall, scope, removed=True)
    gone = found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("words")).alias("to")))).alias("s"))
    gone = stage(gone.select(F.col("doc_id").alias("__of"), F.col("text_key").alias("__key"), F.expr(_merged("s")).alias("__spans")), scope)
    names = docs.columns
    on = lambda a, b: F.col("doc_id").eqNullSafe(F.col(a)) & text_key(F.col("text")).eqNullSafe(F.col(b))
    # Each word goes with the white space before it.
    words, space = (r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)", r"split(text, '[^\\x20\\x09-\\x0D]+')")
    pairs = f"transform(arrays_zip({space}, {words}), (x, i) -> named_struct('t', concat(x.`0`, x.`1`), 'i', i))"
    left = f"filter({pairs}, x -> x.t IS NOT NULL AND NOT exists(__spans, p -> x.i >= p.at AND x.i < p.to))"
    new = F.expr(f"trim(BOTH ' \\n' FROM array_join(transform({left}, x -> x.t), ''))")
    # Only texts that lose something move.
    asked = broadcast_if_small(gone.select(F.col("__of").alias("__id"), F.col("__key").alias("__k")), 500_000)  # two longs a row
    same = [F.col(f"`{c}`") for c in names]
    untouched = docs.join(asked, on("__id", "__k"), "left_anti").select(*same)
    cut = docs.join(asked, on("__id", "__k"), "left_semi").join(gone, on("__of", "__key")).withColumn("__new", new).where("__new <> ''")
    fresh = {"text": F.col("__new"), "n_chars": F.length("__new").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return untouched.unionByName(cut.select(*[fresh.get(c, F.col(f"`{c}`")).alias(c) for c in names]))
