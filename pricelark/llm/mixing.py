"""Mixing sources to target weights.

Tokens are summed per source; capped targets give each source a repetition rate; each
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose
probability is the fraction.  All of it is DataFrame functions.

Shape at scale: one scan makes a narrow table of sizes, its sums per source are partial
aggregates (a hot source sends one row per task), and the rates, one row per source, are
joined back.  They are broadcast only after a count of them; otherwise the join is a
shuffled one that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, stage

#: Bernoulli draws are 52-bit fractions: the first 13 hex digits of an md5.
_HEX = 13


def text_size(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: Column) -> Column:
    """A fraction in [0, 1) that depends on the document and the seed alone."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), seed.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, _HEX), 16, 10).cast("double") / F.lit(float(16**_HEX))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target, rate) from (source, size) rows.

    Weights repeat over the sources by code point, null last.  A target stops at ``cap``
    times its source's size; what is over goes to the others by weight until none is
    above: targets are ``min(cap * size, level * weight)`` at the level that uses the whole
    share.  The level is found from running sums over sources in order of ``size / weight``.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("long"))
    filled = F.col("source_size") / F.col("weight")
    rising = Window.orderBy(filled, F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    per = per.select(
        "source", "source_size", "weight",
        F.sum("source_size").over(everything).alias("all_size"),
        F.coalesce(F.sum("source_size").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("size_before"),
        F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("weight_left"),
        F.row_number().over(rising).alias("turn"),
    )
    level = (F.lit(float(share)) * F.col("all_size") - F.lit(float(cap)) * F.col("size_before")) / F.col("weight_left")
    per = per.withColumn("level", level)
    fits = level * F.col("weight") <= F.lit(float(cap)) * F.col("source_size")
    first = F.min(F.when(fits, F.struct("turn", "level"))).over(everything)
    per = per.withColumn("at", first["level"])
    most = F.lit(float(cap)) * F.col("source_size")
    target = F.coalesce(F.least(most, F.col("at") * F.col("weight")), most)
    return per.select(
        "source", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )


def copies(rate: Column, doc_id: Column, seed: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw(doc_id, seed) < rate - whole, 1).otherwise(0)).cast("long")


def plan_mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seeds: int = 16, scope: str = "mixing") -> tuple[DataFrame, DataFrame]:
    """(sizes, rates): (doc_id, source, size) rows, and per source its target, rate and seed.

    One large document moves a source's total by its whole size, so of ``seeds`` hash seeds
    each source takes the one whose draws bring it nearest its target (the smallest of
    equals).  That is one more partial aggregate over the narrow table.
    """
    sizes = stage(docs.select("doc_id", "source", text_size(F.col("text")).alias("size")), scope)
    targets = broadcast_if_small(stage(source_targets(sizes, weights, share, cap), scope))
    on = sizes["source"].eqNullSafe(targets["source"])
    drawn = sizes.join(targets, on, "left").select(sizes["source"], "doc_id", "size", "rate", "target", "source_size")
    tried = drawn.groupBy("source", "source_size", "target", "rate").agg(
        *[F.sum(F.col("size") * copies(F.col("rate"), F.col("doc_id"), F.lit(k))).alias(f"taken{k}") for k in range(seeds)]
    )
    best = F.least(*[F.struct(F.abs(F.col(f"taken{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(seeds)])
    rates = stage(tried.select("source", "source_size", "target", "rate", best["seed"].alias("seed")), scope)
    return sizes, rates


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seeds: int = 16, scope: str = "mixing") -> DataFrame:
    """``docs`` with each document repeated as often as the mix takes it; its columns stay.

    Nulls: a null text has size 0, a null source is a source of its own, a null doc_id draws
    as an empty one.  Documents of size 0 weigh nothing and are emitted like their source's
    others.  Repeated rows draw alike.  An empty table gives an empty table.  Extra columns,
    whatever their names, pass through.
    """
    _, rates = plan_mix(docs, weights, share, cap, seeds, scope)
    rates = broadcast_if_small(rates)
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source").alias("of"), F.col("doc_id").alias("id"))
    taken = row.join(rates, row["of"].eqNullSafe(rates["source"])).select("row", copies(F.col("rate"), F.col("id"), F.col("seed")).alias("n"))
    return taken.where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select(*[F.col("row")[c].alias(c) for c in names])


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """Per row: doc_id, size, source_size, target, and the words the mix takes of it.

    A null text has size 0, a null source is a source of its own, a null doc_id draws as an empty one.  Rows that
    repeat draw alike.  An empty table gives an empty table; other columns are not looked at.
    """
    sizes, rates = plan_mix(docs, **how)
    rates = broadcast_if_small(rates)
    return sizes.join(rates, sizes["source"].eqNullSafe(rates["source"])).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * copies(F.col("rate"), F.col("doc_id"), F.col("seed"))).alias("taken"),
    )
