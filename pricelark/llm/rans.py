"""Token ids as files: static range asymmetric numeral system.

Format.  A data set is a folder with two Parquet tables.  ``table``: the shared frequency
of every symbol that occurs, out of 2**20.  ``blocks``: independent blocks in ascending
document order (part, then seq), each with its documents' ids and token counts, and a
payload.  A payload interleaves up to 4096 lanes: symbol ``i`` belongs to lane
``i % lanes``; states are 64-bit and shed 32-bit words, which all lanes share in the order
in which a decoder asks for them.  Every ``STEP`` rows the lane states and the word
position are kept (a checkpoint), with the crc32 of the symbols up to the next one, so
segments of a block decode apart and damage is found where it is.

Shape at scale: documents are range-partitioned by doc_id once; ids are made once and
staged in the shared folder; counting, encoding and decoding run block by block with
memory for one block.  The driver sees the frequency table alone, bounded by the
vocabulary.  Files are written by Spark, so a retried task cannot leave half a block.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import broadcast_if_small, partitions, stage, staging

BITS = 20
LOW = np.uint64(1 << 31)
LANES = 4096
STEP = 128  # rows between checkpoints
BLOCK = LANES * 256  # tokens in a block, unless one document is longer

_U = np.uint64


def frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Counts scaled to sum to 2**bits, at least 1 for each symbol that occurs."""
    counts = np.asarray(counts, np.int64)
    used = counts > 0
    if used.sum() > 1 << bits:
        raise ValueError("more symbols than slots")
    out = np.zeros(len(counts), np.int64)
    if used.any():
        out[used] = np.maximum(1, counts[used] * (1 << bits) // counts.sum())
        over = int(out.sum()) - (1 << bits)
        order = np.argsort(-out, kind="stable")
        if over < 0:
            out[order[0]] -= over
        for i in order:  # rounding up the rare ones is paid by the frequent ones
            if over <= 0:
                break
            take = min(over, int(out[i]) - 1)
            out[i] -= take
            over -= take
    return out


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(_U)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(_U)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = max(1, min(LANES, n // 16))
        rows = -(-n // lanes)
        state = np.full(lanes, LOW, _U)
        words, marks = [], []
        total = 0
        for r in range(rows - 1, -1, -1):
            part = ids[r * lanes : (r + 1) * lanes]
            k = len(part)
            f, x = self.freq[part], state[:k]
            full = x >= f << _U(63 - BITS)
            shed = x[full].astype(np.uint32)
            total += len(shed)
            words.append(shed)
            x = np.where(full, x >> _U(32), x)
            q = x // f
            state[:k] = (q << _U(BITS)) + (x - q * f) + self.start[part]
            if r % STEP == 0:
                marks.append((total, zlib.crc32(ids[r * lanes : (r + STEP) * lanes].astype("<u4").tobytes()), state.copy()))
        marks.reverse()
        body = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        head = np.array([n, lanes, len(marks), len(body)], "<u4").tobytes()
        index = np.array([[total - left, crc] for left, crc, _ in marks], "<u4").tobytes()
        return head + index + b"".join(s.astype("<u8").tobytes() for *_, s in marks) + body.astype("<u4").tobytes()

    def decode(self, data: bytes, segment: int | None = None) -> np.ndarray:
        """All ids of a payload, or those from one checkpoint up to the next."""
        n, lanes, marks, size = map(int, np.frombuffer(data, "<u4", 4))
        index = np.frombuffer(data, "<u4", 2 * marks, 16).reshape(-1, 2)
        states = np.frombuffer(data, "<u8", marks * lanes, 16 + 8 * marks).reshape(marks, lanes)
        words = np.frombuffer(data, "<u4", size, 16 + 8 * marks + 8 * marks * lanes).astype(_U)
        out = []
        for m in range(marks) if segment is None else [segment]:
            got = np.empty(min(n - m * STEP * lanes, STEP * lanes), np.uint32)
            state, at = states[m].astype(_U), int(index[m, 0])
            for r in range(0, len(got), lanes):
                k = min(lanes, len(got) - r)
                x = state[:k]
                low = x & _U((1 << BITS) - 1)
                s = self.slot[low]
                got[r : r + k] = s
                x = self.freq[s] * (x >> _U(BITS)) + low - self.start[s]
                need = np.flatnonzero(x < LOW)
                x[need] = (x[need] << _U(32)) | words[at : at + len(need)]
                at += len(need)
                state[:k] = x
            if zlib.crc32(got.astype("<u4").tobytes()) != int(index[m, 1]):
                raise ValueError(f"checksum of segment {m} doesn't hold")
            out.append(got)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


#: The last row of each part has the counts of all its symbols and nothing else.
IDS = "part int, seq long, doc_id long, local_start long, n_tokens long, ids binary, counts binary"
BLOCKS = "part int, seq long, tokens long, doc_ids array<long>, counts array<long>, payload binary"
READ = "part int, doc_id long, local_start long, ids binary"


def _numbered(path: str, end_id: int | None):
    names = ["part", "seq", "doc_id", "local_start", "n_tokens", "ids", "counts"]

    def run(batches):
        enc, part, seq, at = tokens.encoder(path), TaskContext.get().partitionId(), 0, 0
        total = np.zeros(enc.size, np.int64)
        for batch in (s for b in batches for s in tokens.slices(b, 4096)):
            ids, n = enc.encode_with_end(batch.column("text"), end_id)
            total += np.bincount(ids, minlength=enc.size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(seq, seq + len(n))), batch.column("doc_id").cast(pa.int64()), pa.array(at + np.cumsum(n) - n), pa.array(n), tokens.binaries(ids, n), pa.nulls(len(n), pa.binary())],
                names=names,
            )
            seq, at = seq + len(n), at + int(n.sum())
        longs = [pa.nulls(1, pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *longs, pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=names)

    return run


def ordered_ids(docs: DataFrame, tokenizer: str, end_id: int | None = 0) -> DataFrame:
    """Token ids of every document in ascending doc_id order (nulls first, then by text)."""
    n = partitions(docs.sparkSession)
    rows = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return rows.mapInArrow(_numbered(tokenizer, end_id), IDS)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, scope: str = "rans") -> None:
    """Write the ids of ``docs`` to ``path`` (see the module's docstring for the format).

    Null and empty texts have the end id alone.  Rows that share a doc_id follow each other
    in the order of their texts.  An empty table gives empty tables.  Other columns are not
    looked at.
    """
    spark = docs.sparkSession
    size = tokens.Encoder(tokenizer).size
    wide = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    ids = stage(ordered_ids(docs, tokenizer, end_id), scope)

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("counts"):
                total += np.frombuffer(x.as_buffer(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["symbol", "n"])

    counted = ids.where("counts IS NOT NULL").select("counts").mapInArrow(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toArrow()  # at most the vocabulary
    counts = np.zeros(size, np.int64)
    counts[counted.column("symbol").to_numpy()] = counted.column("n").to_numpy()
    freq = frequencies(counts)
    table = pa.table({"symbol": np.arange(size), "freq": freq})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/table")
    raw = freq.astype("<i8").tobytes()

    def blocks(batches):
        coder, held, have = Coder(np.frombuffer(raw, "<i8")), [], 0

        def flush():
            part, seq = held[0][:2]
            data = coder.encode(np.frombuffer(b"".join(h[3] for h in held), wide).astype(np.int64))
            row = {"part": [part], "seq": [seq], "tokens": [have], "doc_ids": [[h[2] for h in held]], "counts": [[len(h[3]) // wide.itemsize for h in held]], "payload": [data]}
            return pa.RecordBatch.from_pydict(row, schema=schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("payload", pa.binary())])
        for batch in (s for b in batches for s in tokens.slices(b)):
            for part, seq, doc, data in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "doc_id", "ids"))):
                if held and (have >= BLOCK or (part, seq) != (held[-1][0], held[-1][1] + 1)):
                    yield flush()
                    held, have = [], 0
                held.append((part, seq, doc, data))
                have += len(data) // wide.itemsize
        if held:
            yield flush()

    ids.where("seq IS NOT NULL").select("part", "seq", "doc_id", "ids").mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, start, ids) per document, decoded block by block; ids are little-endian u32."""
    freq = spark.read.parquet(f"{path}/table").orderBy("symbol").toArrow().column("freq").to_numpy()  # as long as the vocabulary
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sums = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    offsets = sums.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("offset"))  # one row for each file that was written
    before = blocks.select("part", "seq", (F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens")).alias("before"))
    starts = before.join(broadcast_if_small(offsets), "part").select(F.col("part").alias("of"), F.col("seq").alias("at"), (F.col("before") + F.col("offset")).alias("start"))
    rows = blocks.join(broadcast_if_small(starts, 500_000), (F.col("part") == F.col("of")) & (F.col("seq") == F.col("at")))
    raw = freq.astype("<i8").tobytes()

    def decode(batches):
        coder = Coder(np.frombuffer(raw, "<i8"))
        for b in batches:
            for part, start, docs, counts, data in zip(*(b.column(c) for c in ("part", "start", "doc_ids", "counts", "payload"))):
                ids, counts = coder.decode(data.as_buffer()).astype("<u4"), np.array(counts.as_py(), np.int64)
                to = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(to), part.as_py(), np.int32)), pa.array(docs.as_py(), pa.int64()), pa.array(start.as_py() + to - counts), tokens.binaries(ids, counts)],
                    names=["part", "doc_id", "local_start", "ids"],
                )

    return rows.select("part", "start", "doc_ids", "counts", "payload").mapInArrow(decode, READ).withColumnRenamed("local_start", "start")


def report(docs: DataFrame, tokenizer: str, end_id: int | None = 0, scope: str = "rans") -> DataFrame:
    """Write ``docs``, read the files back, and return doc_id, start, n_tokens, ids_crc32."""
    import uuid

    path = f"{staging(docs.sparkSession, scope)}/files-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id, scope)
    n = (F.octet_length("ids") / 4).cast("long")
    flat = read(docs.sparkSession, path)
    return flat.select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
