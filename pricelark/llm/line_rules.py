"""Quality rules with cross-document line frequency.

Per-text rules (length, symbols, repeated lines and words) are expressions on the row.
Across documents, normalised lines are hashed, distinct documents are counted per host,
lines above the limits are removed, and documents that lose too much are rejected.  All
of it is DataFrame and SQL functions.

Shape at scale: no text is shuffled, only 8-byte line hashes with a word count, which are
staged once in the shared folder.  The two
counts are partial aggregates, so a line that a third of all documents share sends one
row per task; the join back to the lines has no grouping above it in its stage, so
adaptive execution may split a hot line's partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sql_let, stage

_SPACE = r"[\\x20\\x09-\\x0D]+"
_BLANKS = r"translate(%s, ' \t\n\u000b\u000c\r', '')"


def _words(text: str) -> str:
    return rf"filter(split({text}, '{_SPACE}'), w -> w <> '')"


#: Words covered by 3-word windows that occur twice or more.  Window hashes are 64 bits.
#: A text whose window hashes are all distinct (one hash-set pass) needs no sort.
_COVERED = sql_let(
    "array_sort(transform(h, (x, i) -> named_struct('x', x, 'i', i)))", "s",
    "aggregate(array_sort(transform(filter(s, (e, k) -> (k > 0 AND e.x = element_at(s, k).x) OR (k < size(s) - 1 AND e.x = element_at(s, k + 2).x)), e -> e.i)), "
    "named_struct('n', 0L, 'to', 0L), "
    "(a, i) -> named_struct('n', a.n + i + 3L - greatest(a.to, CAST(i AS BIGINT)), 'to', i + 3L), a -> a.n)",
)
_REPEATED = (
    "IF(size(ws) < 3, 0L, "
    + sql_let("transform(sequence(0, size(ws) - 3), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2]))", "h", f"IF(size(array_distinct(h)) = size(h), 0L, {_COVERED})")
    + ")"
)


def text_rules(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and ``more`` named columns) per row.

    A null or empty text has no words and fails.
    """
    t = "coalesce(text, '')"
    lines = rf"filter(split({t}, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"
    pair = sql_let(_words(t), "ws", f"named_struct('n', CAST(size(ws) AS BIGINT), 'r', {_REPEATED})")
    rows = docs.select(
        "doc_id",
        F.struct(*more, F.lit(0).alias("_")).alias("more"),
        F.expr(pair).alias("w"),
        F.expr(f"CAST(length({_BLANKS % t}) AS BIGINT)").alias("word_chars"),
        F.expr(f"CAST(length({t}) - length(translate({t}, '#*$%&|<>', '')) AS BIGINT)").alias("n_symbols"),
        F.expr(sql_let(lines, "ls", "CAST(size(ls) - size(array_distinct(ls)) AS BIGINT)")).alias("n_dup_lines"),
    )
    n, r = F.col("w.n"), F.col("w.r")
    return rows.select("doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), ((n < 50) | (100 * r > 50 * n)).alias("base_failed"), "more.*").drop("_")


def _normal_lines(text: str) -> str:
    """The lines of a text, normalised: single characters over the whole text, runs of space only in lines that have them."""
    flat = rf"translate(lower(coalesce({text}, '')), '0123456789\t\u000b\u000c\r', '0000000000    ')"
    return rf"transform(split({flat}, '\n'), x -> trim(IF(contains(x, '  '), regexp_replace(x, ' +', ' '), x)))"


def text_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """(row, doc_id, host, content, line, words): one row for each non-blank line; ``row`` numbers the rows of ``docs``.

    A line is normalised by lower case, collapsed space and digits read as 0; ``content`` is
    a hash of the whole text, by which exact copies count as one document.
    """
    lines = f"filter({_normal_lines('text')}, x -> x <> '')"
    coded = rf"transform({lines}, x -> named_struct('line', xxhash64(x), 'words', length(x) - length(translate(x, ' ', '')) + 1))"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(host).alias("host"), F.xxhash64("text").alias("content"), "text")
    return rows.select("row", "doc_id", "host", "content", F.explode(F.expr(coded)).alias("l")).select("row", "doc_id", "host", "content", "l.line", "l.words")


def frequent_lines(lines: DataFrame, least: int = 3, share: float = 0.05) -> DataFrame:
    """(host, line) of lines in over ``share`` of a host's distinct documents, and in at least ``least`` of them: in two, a line is shared, not frequent."""
    each = lines.select("host", "content", "line").distinct()
    docs = lines.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    count = each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    both = count.join(docs.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
    return both.where(F.col("n") > share * F.col("docs")).select("host", "line")


def judge(docs: DataFrame, host: str = "source", least: int = 3, share: float = 0.05, most_lost: float = 0.7, scope: str = "lines") -> DataFrame:
    """The columns of `text_rules`, words in removed lines (``removed_words``), and ``kept``.

    ``kept`` is false if ``base_failed``, or if more than ``most_lost`` of the words stand
    in removed lines.  Null hosts are one host.  Every row is judged by its own text, also where rows share
    a doc_id or repeat.  Empty tables give empty tables; other columns are not looked at.
    """
    lines = stage(text_lines(docs, host), scope)
    often = frequent_lines(lines, least, share).select(F.col("host").alias("of"), F.col("line").alias("is"))
    gone = lines.join(often, (F.col("line") == F.col("is")) & F.col("host").eqNullSafe(F.col("of")))
    # Rows that repeat lose the same words: those of one of them count.
    lost = gone.groupBy("row", "doc_id", "host", "content").agg(F.sum("words").alias("words")).groupBy("doc_id", "host", "content").agg(F.max("words").alias("removed_words"))
    lost = lost.select(F.col("doc_id").alias("in"), F.col("host").alias("at"), F.col("content").alias("with"), "removed_words")
    rules = text_rules(docs, F.col(host).alias("host"), F.xxhash64("text").alias("content"))
    out = rules.join(lost, F.col("doc_id").eqNullSafe(F.col("in")) & F.col("host").eqNullSafe(F.col("at")) & (F.col("content") == F.col("with")), "left").drop("in", "at", "with", "host", "content")
    removed = F.coalesce(F.col("removed_words"), F.lit(0)).cast("long")
    return out.withColumn("removed_words", removed).withColumn("kept", ~F.col("base_failed") & (removed <= most_lost * F.col("n_words")))


def clean(docs: DataFrame, host: str = "source", least: int = 3, share: float = 0.05, scope: str = "lines") -> DataFrame:
    """``docs`` with the frequent lines taken out of each text; its columns stay.

    Lines are looked up one by one, and each row's frequent ones come back to it as a list that
    its own text bounds; no list of a host's lines is made.  Rows that repeat are cleaned one by one.
    """
    names = docs.columns
    rows = stage(docs.select(F.monotonically_increasing_id().alias("__nr"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")), scope)
    lines = rows.select("__nr", F.col(f"__row.`{host}`").alias("host"), F.xxhash64("__row.text").alias("content"), F.explode(F.expr(f"array_distinct(transform({_normal_lines('__row.text')}, x -> xxhash64(x)))")).alias("line"))
    often = frequent_lines(text_lines(docs, host), least, share).withColumnRenamed("host", "of").withColumnRenamed("line", "is")
    met = lines.join(often, (F.col("line") == F.col("is")) & F.col("host").eqNullSafe(F.col("of")), "left_semi")
    gone = met.groupBy("__nr").agg(F.collect_list("line").alias("__gone"))
    kept = F.expr(
        rf"array_join(transform(filter(arrays_zip(split(`__row`.text, '\n'), {_normal_lines('`__row`.text')}), "
        "x -> NOT array_contains(__gone, xxhash64(x.`1`))), x -> x.`0`), '\n')"
    )
    both = rows.join(gone, "__nr", "left")
    text = F.when(F.col("__gone").isNull(), F.col("__row.text")).otherwise(kept)
    return both.select(*[(text if c == "text" else F.col("__row")[c]).alias(c) for c in names])
