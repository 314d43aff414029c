"""Best-fit packing with certified partitions.

Documents become token pieces of at most the sequence length.  Pieces are dealt over
partitions; each packs its own by best-fit decreasing and computes a lower bound on its
number of sequences from dual-feasible functions.  Where count and bound agree the
partition is certified and keeps its sequences; a partition with a gap keeps only the full
ones.  The documents of the others, and of each partition's few loose ends, are dealt anew
over fewer partitions, and packed again, in six rounds.

Shape at scale: texts are encoded once, and only lengths and ids of pieces are staged and
moved (tens of bytes a piece).  A partition has a bounded number of pieces, so no task
grows with the input; what is exchanged shrinks from round to round.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard, tokens
from .common import give_back, partitions, stage

MOST = 20_000  # pieces in a partition
FEW = 250  # and at least so many, where there are fewer
KEPT, TEXTS = 600_000, 1024  # token pieces that a worker keeps between texts, and texts that it encodes at once


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest of the bounds by dual-feasible functions.

    For every u: sum of f(x) over pieces, rounded up, is a number of bins that no packing
    can beat.  Used: the identity; for each threshold t, f(x) = 1 above capacity - t, 0
    below t, x / capacity between; for small k, f(x) = x / capacity if (k + 1) x is a
    multiple of the capacity, else floor((k + 1) x / capacity) / k.
    """
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((n * x).sum()) // capacity)
    count, mass = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    t = np.arange(1, capacity // 2 + 1)
    large = count[-1] - count[capacity - t + 1]
    middle = mass[capacity - t + 1] - mass[t]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 25):
        whole = (k + 1) * x % capacity == 0
        scaled = np.where(whole, k * x, (k + 1) * x // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((n * scaled).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of every piece, and the fill of every bin."""
    order = np.argsort(-lengths, kind="stable")
    which, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by the room they have left
    some = 0  # bit r: a bin with room r is open
    fill: list[int] = []
    for i, x in zip(order.tolist(), lengths[order].tolist()):
        fits = some >> x
        if fits:
            left = x + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                some &= ~(1 << left)
        else:
            b, left = len(fill), capacity
            fill.append(0)
        which[i], offset[i] = b, fill[b]
        fill[b] += x
        left -= x
        if left:
            room[left].append(b)
            some |= 1 << left
    return which, offset, np.array(fill, np.int64)


PIECES = "row long, doc_id long, piece int, start long, length int, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int | None = 0, keep_ids: bool = False) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32[, ids]): each document's tokens, cut only where longer than ``length``."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")

    def cut(batches):
        if jaccard._words:  # of operators before this one, in the same Python worker
            jaccard._words.clear()
            give_back()
        enc = tokens.encoder(tokenizer, KEPT)
        for batch in (s for b in batches for s in tokens.slices(b, TEXTS)):
            every, counts = enc.encode_with_end(batch.column("text"), end_id)
            every, out, first = every.astype("<u4"), [], 0
            for row, doc, n in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), counts.tolist()):
                for k, at in enumerate(range(0, n, length)):
                    part = every[first + at : first + min(at + length, n)].tobytes()
                    out.append((row, doc, k, at, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
                first += n
            columns = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)][: 7 if keep_ids else 6], names=names[: 7 if keep_ids else 6])

    return rows.mapInArrow(cut, PIECES + ", ids binary" * keep_ids)


def _packed(capacity: int, last: bool):
    def run(pieces: pa.Table) -> pa.Table:
        lengths = pieces.column("length").to_numpy()
        which, offset, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        # A gap: all but full sequences are given up.  Certified: those with a tenth free.
        done = fill >= (capacity * 9 // 10 if len(fill) == bound else capacity)
        new = {"bin": which, "offset": offset, "done": done[which] | last, "bins": np.full(len(which), len(fill)), "bound": np.full(len(which), bound)}
        for name, values in new.items():
            pieces = pieces.append_column(name, pa.array(values))
        return pieces

    return run


PLACED = "deal int, bin long, offset long, done boolean, bins long, bound long"


def assign(pieces: DataFrame, length: int = 2048, rounds: int = 6, scope: str = "packing") -> DataFrame:
    """``pieces`` (the columns of `PIECES`) with sequence_id and offset.  The same pieces get the same sequences again."""
    spark = pieces.sparkSession
    rest, kept, most = pieces, [], None
    for r in range(rounds):
        n = rest.count()
        if not n:
            break
        deals = max(-(-n // MOST), min(partitions(spark), n // FEW), 1)
        last = r == rounds - 1 or (most is not None and deals == 1)
        most = n
        dealt = rest.select("*", F.pmod(F.xxhash64("row", "piece", F.lit(r)), F.lit(deals)).cast("int").alias("deal"))
        placed = stage(dealt.groupBy("deal").applyInArrow(_packed(length, last), f"{PIECES}, {PLACED}"), scope)
        sequence = F.lit(r) * F.lit(1 << 56) + F.col("deal").cast("long") * F.lit(1 << 32) + F.col("bin")
        kept.append(placed.where("done").select(*pieces.columns, sequence.alias("sequence_id"), "offset"))
        rest = placed.where("NOT done").select(*pieces.columns)
    if not kept:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int | None = 0, scope: str = "packing") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are pieces of the end id alone.  Rows that share a doc_id are
    documents of their own.  An empty table packs into nothing.  Other columns are not
    looked at.
    """
    pieces = stage(token_pieces(docs, tokenizer, length, end_id), scope)
    return assign(pieces, length, scope=scope).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int | None = 0, scope: str = "packing") -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, doc_ids, and the ids (little-endian u32)."""
    pieces = stage(token_pieces(docs, tokenizer, length, end_id, keep_ids=True), scope)
    placed = assign(pieces.drop("ids"), length, scope=scope).select("row", "piece", "sequence_id", "offset")
    each = pieces.join(placed, ["row", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))  # `length` pieces at most
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return each.select("sequence_id", (F.octet_length(joined) / 4).cast("int").alias("n_tokens"), F.col("p.doc_id").alias("doc_ids"), joined.alias("ids"))
