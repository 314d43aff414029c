"""Licence scans by a positional rare-token index.

Each template is a short run of words with mandatory key phrases.  The index holds, for
every template word, its postings (template, position).  A file looks up, of a template's mandatory
words, that with the highest inverse document frequency (every true place has it); a hit at word ``p`` of the
file and position ``q`` of the template proposes the start ``p - q``; the postings of the
template's other words are intersected by that relative position; and a proposal counts if
every mandatory key phrase stands there whole.

Shape at scale: one scan cuts texts into words and keeps the few words of the index, with
their positions, per file (staged in the shared folder); all else works on those.  The
index is constant in size.  Nothing groups by anything wider than one file, apart from the
document frequencies, which are partial counts of a few dozen words.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, lower_ascii, stage

#: Words: ASCII letters, digits, and all beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: (name, label, mandatory key phrases, whole run).  ``_`` is any one word.
BASE = (
    ("mit-name", "mit", ("mit license",), "mit license"),
    ("apache-name", "apache", ("apache license",), "apache license"),
    ("gpl-name", "gpl", ("general public license",), "general public license"),
)
TEMPLATES = BASE + (
    ("mit-grant", "mit-text", ("hereby granted free", "charge"), "permission _ hereby granted free _ charge _ any person obtaining _ copy"),
    ("apache-2", "apache-2.0", ("apache license version 2 0",), "licensed under _ apache license version 2 0"),
    ("gpl-3", "gpl-3.0", ("general public license version 3",), "gnu general public license version 3"),
    ("gpl-2", "gpl-2.0", ("general public license version 2",), "gnu general public license version 2"),
    ("lgpl", "lgpl", ("lesser general public license",), "gnu lesser general public license"),
    ("agpl", "agpl", ("affero general public license",), "gnu affero general public license"),
    ("bsd-clauses", "bsd", ("redistribution", "source", "binary forms"), "redistribution _ use _ source _ binary forms with _ without modification"),
    ("bsd-name", "bsd", ("bsd license",), "bsd license"),
    ("mpl", "mpl", ("mozilla public license",), "mozilla public license"),
    ("isc", "isc", ("use copy modify", "distribute"), "permission _ use copy modify _ _ distribute _ software"),
    ("cc-by-sa", "cc-by-sa", ("creative commons attribution sharealike",), "creative commons attribution sharealike"),
    ("cc-by", "cc-by", ("creative commons attribution",), "creative commons attribution"),
    ("unlicense", "unlicense", ("released into", "public domain"), "released into _ public domain"),
    ("epl", "epl", ("eclipse public license",), "eclipse public license"),
    ("all-rights", "reserved", ("all rights reserved",), "all rights reserved"),
)


def _postings(templates) -> list[tuple]:
    """(name, label, base, run length, words that count, mandatory mask, word, position)."""
    rows = []
    for name, label, keys, run in templates:
        run = run.split()
        if len(run) > 62:
            raise ValueError(f"{name}: a template has 62 words at most")
        must = 0
        for key in map(str.split, keys):
            at = [i for i in range(len(run) - len(key) + 1) if run[i : i + len(key)] == key]
            if not at:
                raise ValueError(f"{name}: key phrase {' '.join(key)!r} isn't in the run")
            must |= sum(1 << (at[0] + k) for k in range(len(key)))
        count = sum(w != "_" for w in run)
        rows += [(name, label, (name, label, keys, " ".join(run)) in BASE, count, must, w, i) for i, w in enumerate(run) if w != "_"]
    return rows


def index(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """The postings: one row per template word, a constant number."""
    return spark.createDataFrame(_postings(templates), "template string, label string, base boolean, n_counted int, must long, word string, at int")


def file_words(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, row, n_words, hits): the words of the index in a text, with their positions from 0."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(WORDS), F.lit(0))
    known = F.array(*[F.lit(w) for w in sorted(vocabulary)])
    hit = lambda ws: F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("p"))), lambda x: F.array_contains(known, x["w"]))
    # A text with none of the words, the usual one, needs no positions.
    both = let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n"), F.when(F.arrays_overlap(ws, known), hit(ws)).alias("hits")))
    return docs.select("doc_id", both.alias("f")).select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("f.n").alias("n_words"), F.col("f.hits").alias("hits"))


def scan(docs: DataFrame, templates=TEMPLATES, scope: str = "license") -> tuple[DataFrame, DataFrame]:
    """(files, finds): per row of ``docs`` its words, and each place where a template stands.

    finds: row, template, label, base, start (word, from 0), score (matched share of the
    template's IDF).  A null or empty text has no words and no finds.  Rows that share a
    doc_id are files of their own.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    posts = index(spark, templates)
    files = stage(file_words(docs, [r[6 - 1] for r in _postings(templates)]), scope)
    seen = files.where("hits IS NOT NULL")
    total = files.select(F.count("*").alias("files"))
    frequency = seen.select(F.explode(F.array_distinct("hits.w")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    weights = posts.join(frequency, "word", "left").join(F.broadcast(total))  # total is one row
    idf = F.log((F.col("files") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1.0
    posts = stage(weights.withColumn("idf", idf).drop("files", "df"), scope)
    whole = posts.groupBy("template").agg(F.sum("idf").alias("all_idf"))
    posts = F.broadcast(posts.join(F.broadcast(whole), "template"))  # constant in size: the templates' words

    places = seen.select("row", F.explode("hits").alias("h")).select("row", F.col("h.w").alias("word"), F.col("h.p").alias("p"))
    met = places.join(posts, "word").withColumn("start", F.col("p") - F.col("at"))
    needed = F.expr("must & shiftleft(1L, at) <> 0")  # an optional word may be rarer, and stand elsewhere
    rarest = F.max(F.when(needed, F.col("idf"))).over(Window.partitionBy("row", "template"))
    aligned = (
        met.withColumn("look_up", needed & (F.col("idf") >= rarest))
        .groupBy("row", "template", "start")
        .agg(
            F.first("label").alias("label"), F.first("base").alias("base"), F.first("must").alias("must"),
            F.coalesce(F.bool_or("look_up"), F.lit(False)).alias("proposed"), F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"),
            (F.sum("idf") / F.first("all_idf")).alias("score"),
        )
    )
    finds = aligned.where(F.col("proposed") & (F.col("mask").bitwiseAND(F.col("must")) == F.col("must")))
    return files, finds.select("row", "template", "label", "base", "start", F.least("score", F.lit(1.0)).alias("score"))


def license_report(docs: DataFrame, templates=TEMPLATES, scope: str = "license") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, empty labels and score 0.  Rows that repeat, or share a doc_id, a null one too, are scanned
    one by one.  Empty tables give empty tables; other columns, whatever their names, are not looked at.
    """
    files, finds = scan(docs, templates, scope)
    start = F.when(F.col("base"), F.col("start")).cast("long")
    names = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))  # noqa: E731  # as many as there are labels
    per = finds.groupBy("row").agg(
        F.count(start).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        names(F.when(F.col("base"), F.col("label"))).alias("base_labels"), names("label").alias("labels"), F.max("score").alias("score"),
    )
    return files.join(per, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
    )
