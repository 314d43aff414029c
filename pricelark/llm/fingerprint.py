"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; a chunk ends where its low bits match a mask: a
strict one before the normal size, a loose one after it, so sizes gather around the normal
one.  Boundaries depend on the last 32 bytes alone, so an insertion moves a few chunks and
leaves the rest.  A fingerprint is the set of chunk digests with their lengths; likeness
is the length-weighted containment of the lighter set in the other.

Shape at scale: rolling and digesting happen in Arrow batches, 256 documents at a time.
To set each document beside its successor, rows are dealt by ranges of doc_id (quantiles
of that column alone), each range with one more row: the first of the next.  Each text
is shuffled once and no window spans the table.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions
from .tokens import slices

LEAST, NORMAL, MOST = 8, 32, 128
STRICT, LOOSE = np.uint32(0x7F << 20), np.uint32(0xF << 20)  # 7 and 4 bits
WIDTH = 32  # bytes that a boundary depends on

#: 256 pseudo-random words, from a rule: the hash of the byte's value.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=7) for b in range(256)], np.uint32)

ENTRY = 8  # bytes in a fingerprint for each chunk: 6 of its digest, 2 of its length


def boundaries(data: bytes) -> list[int]:
    """Where chunks end."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < WIDTH:  # h[i] = sum of gear[i - k] << k over the last `step` bytes
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
        if len(h) <= 2 * step:
            break
        step *= 2
    loose_at = np.flatnonzero((h & LOOSE) == 0)
    strict = loose_at[(h[loose_at] & STRICT) == 0].tolist()
    loose = loose_at.tolist()
    ends, at = [], 0
    while n - at > LEAST:
        end = min(at + MOST, n)
        i = bisect_left(strict, at + LEAST - 1)
        if i < len(strict) and strict[i] < at + NORMAL:
            end = min(end, strict[i] + 1)
        else:
            i = bisect_left(loose, at + NORMAL - 1)
            if i < len(loose):
                end = min(end, loose[i] + 1)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> dict[int, int]:
    """Digest to length, for the distinct chunks; an empty text has none."""
    ends = boundaries(data)
    digest = xxhash.xxh3_64_intdigest
    return {digest(data[a:b]) >> 16: b - a for a, b in zip([0, *ends], ends)}


def to_text(found: dict[int, int]) -> str:
    return base64.b64encode(b"".join(k.to_bytes(6, "big") + v.to_bytes(2, "big") for k, v in sorted(found.items()))).decode()


def from_text(fingerprint: str) -> dict[int, int]:
    raw = base64.b64decode(fingerprint)
    return {int.from_bytes(raw[i : i + 6], "big"): int.from_bytes(raw[i + 6 : i + 8], "big") for i in range(0, len(raw), ENTRY)}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Length-weighted containment of the lighter set in the heavier; 1 for two empty sets, 0 for one."""
    if not a or not b:
        return float(a == b)
    if len(a) > len(b):
        a, b = b, a
    shared = sum(v for k, v in a.items() if k in b)
    return min(1.0, shared / min(sum(a.values()), sum(b.values())))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row; a null text counts as empty, with an empty fingerprint."""

    def run(batches):
        for b in (s for b in batches for s in slices(b)):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([to_text(chunks((t or "").encode())) for t in b.column("text").to_pylist()])], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _place(doc_id: Column, ends: list[int]) -> Column:
    """How many of the sorted ``ends`` are smaller: first among every k-th, then within its group of k, k = sqrt(n)."""
    if not ends:
        return F.lit(0)
    k = math.isqrt(len(ends) - 1) + 1
    groups = [ends[i : i + k] for i in range(0, len(ends), k)]
    below = lambda values: F.size(F.filter(values, lambda e: e < doc_id))
    group = below(F.lit([g[-1] for g in groups]))
    return F.when(group == len(groups), F.lit(len(ends))).otherwise(group * k + below(F.get(F.array(*[F.lit(g) for g in groups]), group)))


def with_successor(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` dealt by ranges of doc_id and sorted (nulls first, then by text).

    ``extra`` rows, one at the end of each range, repeat the first row of the next range (of
    the first one, after the last).  The ranges' ends are driver values, as many as partitions.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)  # several ranges to a partition even out its size
    ids = docs.select("doc_id")
    ends = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    ends = sorted(set(ends))
    place = _place(F.col("doc_id"), ends)
    rows = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), 0).otherwise(place).cast("int").alias("range"))
    first_ids = {r["range"]: r["first"] for r in rows.groupBy("range").agg(F.min("doc_id").alias("first"), F.bool_or(F.col("doc_id").isNull()).alias("null")).select("range", F.when(~F.col("null"), F.col("first")).alias("first")).collect()}
    order = sorted(first_ids)
    before = {k: order[i - 1] for i, k in enumerate(order)}
    if not order:
        return rows.select("*", F.lit(False).alias("extra"))
    firsts = spark.createDataFrame([(k, first_ids[k], before[k]) for k in order], "of int, first long, to int")  # one row for each range
    met = rows.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("range") == F.col("of")))
    extra = met.groupBy("to", "doc_id").agg(F.min(F.struct(F.col("text").isNotNull(), "text"))["text"].alias("text"))
    both = rows.select("*", F.lit(False).alias("extra")).unionByName(extra.select("doc_id", "text", F.col("to").alias("range"), F.lit(True).alias("extra")))
    return both.repartition(partitions(spark), "range").sortWithinPartitions("range", "extra", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last quarter taken from its successor's start).

    Rows follow each other by doc_id, nulls first, those with equal ids by their text; the
    last is followed by the first.  A single row follows itself.  Null texts are empty; an empty
    table gives an empty table; other columns, whatever their names, are not looked at.
    """
    import hashlib

    def run(batches):
        held = None
        out = []

        def record(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.int64()] + [pa.string()] * 3 + [pa.float64()] * 2)], names=[x.split()[0] for x in OUT.split(", ")])

        for b in (s for b in batches for s in slices(b)):
            for doc, text, where in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "range"))):
                text = text or ""
                found = chunks(text.encode())
                if held and held[3] == where:
                    of, mine, print_, _ = held
                    n = len(mine)
                    edited = (mine[: n - n // 4] + text[: n // 4]).encode()
                    changed = chunks(edited)
                    out.append((of, n, hashlib.sha256(edited).hexdigest(), to_text(print_), to_text(changed), likeness(print_, changed), likeness(print_, found)))
                held = (doc, text, found, where)
            if out:
                yield record(out)
                out = []

    return with_successor(docs).mapInArrow(run, OUT)
