"""Chat formatting: conversations rendered by a compiled template, with the loss mask.

`format_conversations` writes a conversation as parts of text with the spans that a model is
trained on; `read_back` parses such parts again.  Texts are escaped, so that no text can
look like a turn's mark.

Shape at scale: one exchange by conversation, sorted by turn.  A task reads a conversation
as a stream and holds two turns and one part, so a conversation of any length needs no
more memory; a digest over all its turns is one pass by nature (SHA-256 has no other).
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions
from .templates import Template, TemplateError, unescape

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Strings that texts must not hold as they are.
CONTROLS = ("###", "</turn>")
SOURCE = (
    "{% for m in messages %}" + OPEN + "{{ m.role | escape(': ') }}" + MIDDLE
    + "{% if m.role == 'assistant' %}{% generation %}{{ m.content | escape }}{% endgeneration %}{% else %}{{ m.content | escape }}{% endif %}"
    + CLOSE + "{% endfor %}"
)

_PART = "part long, text string, loss array<struct<start:int,end:int>>"
_READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, loss_turns long"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _by_conversation(batches, most: int, names: list[str], kinds: list, rows_of):
    """Batches of what ``rows_of(id, rows)`` gives for each conversation; ``most`` characters of text at most are held, but for one row."""
    held, size = [], 0
    first = None
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for first, group in itertools.groupby(rows, key=lambda r: r[0]):
        for row, chars in rows_of(first, group):
            held.append((first, *row))
            size += chars + 100
            if size >= most:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)


def format_conversations(convs: DataFrame, source: str = SOURCE, controls: tuple = CONTROLS, constants: dict | None = None, part_chars: int = 1 << 20) -> DataFrame:
    """(conv_id, part, text, loss): the rendered conversations, cut into parts after turns.

    ``loss`` has the spans inside ``{% generation %}`` by code points of the part's text.
    Turns come by ``turn`` (null first), then role and text, so repeated turns have an order.
    Null roles and texts are empty; rows without a conv_id are one conversation; an
    empty table gives an empty table; other columns are not read.  A template that fails
    on a conversation fails the job.
    """
    Template(source, controls, constants)  # a wrong source fails here, not in a task
    kind = convs.schema["conv_id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())

    def run(batches):
        template = Template(source, controls, constants)

        def rows(_, group):
            messages = ({"role": role or "", "content": text or ""} for _, role, text in group)
            for k, (text, spans) in enumerate(template.parts(messages, part_chars)):
                yield (k, text, [{"start": a, "end": b} for a, b in spans]), len(text)

        yield from _by_conversation(batches, 4 * part_chars, ["conv_id", "part", "text", "loss"], [id_type, pa.int64(), pa.string(), _SPANS], rows)

    rows = convs.select("conv_id", F.col("turn").alias("_turn"), "role", "text")
    rows = rows.repartition(partitions(convs.sparkSession), "conv_id").sortWithinPartitions("conv_id", "_turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, {_PART}")


def turns_of(text: str):
    """(role, content start, content end) of the turns in a formatted part."""
    at = 0
    while at < len(text):
        middle, close = text.find(MIDDLE, at), text.find(CLOSE, at)
        if not text.startswith(OPEN, at) or middle < 0 or close < middle:
            raise TemplateError(f"no turn at code point {at}")
        yield unescape(text[at + len(OPEN) : middle]), middle + len(MIDDLE), close
        at = close + len(CLOSE)


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation, read from formatted parts alone: turns and their digest, what the loss mask covers, sizes.

    ``turns_sha256`` is over role, line feed, text, line feed of each turn; ``loss_sha256``
    over the unescaped text under the mask.  ``loss_turns`` counts the turns that the mask meets.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())

    def run(batches):
        def rows(_, group):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = loss_chars = masked = 0
            for _, _, text, spans in group:
                chars += len(text)
                starts = iter(spans)
                span = next(starts, None)
                for role, a, b in turns_of(text):
                    n += 1
                    turns.update(f"{role}\n{unescape(text[a:b])}\n".encode())
                    masked += span is not None and span["start"] < b
                    while span is not None and span["start"] < b:
                        span = next(starts, None)
                for s in spans:
                    learned = unescape(text[s["start"] : s["end"]])
                    loss.update(learned.encode())
                    loss_chars += len(learned)
            yield (n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, masked), 0

        names = ["conv_id", *(x.split()[0] for x in _READ.split(", "))]
        kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield from _by_conversation(batches, 1 << 20, names, kinds, rows)

    rows = parts.select("conv_id", "part", "text", "loss").repartition(partitions(parts.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(run, f"conv_id {kind}, {_READ}")
