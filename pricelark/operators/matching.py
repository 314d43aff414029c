"""Joins of texts without a product of the two sides: similar names, codes inside texts.

Both file each row under its rarest parts.  How often a part occurs is counted first, so a
word or a brand prefix that every text has is nobody's key.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vocab

#: Names of more words than this meet by single words of their prefix; and the most keys of a name for one size of partner.
MOST_WORDS, MOST_KEYS = 12, 48
#: Scores are rounded to three places before they are compared.
_ROUNDED = 0.0005 + 1e-9


def shared_at_least(n: int, k: int, least: float) -> int | None:
    """Fewest shared words with which sets of n and k words reach ``least``; None if they can't."""
    return next((i for i in range(1, min(n, k) + 1) if 0.5 * i / (n + k - i) + 0.5 * i / min(n, k) >= least - _ROUNDED), None)


def prefix_of(n: int, least: float) -> int:
    """Of n words by rarity, the first so many hold one that any partner shares.

    Containment is 1 at most, so the Jaccard similarity is at least 2 least - 1, and
    with it the share of the n words that the partner has.
    """
    share = 2 * (least - _ROUNDED) - 1
    return n - max(1, -int(-share * n // 1)) + 1


def _plan(least: float) -> list[tuple[int, int, str, list[int]]]:
    """(own words, partner's words, sizes, places): what a name files for each size of partner.

    Names of n and k words that reach ``least`` share o words, so by rarity they share s <= o
    words among their first n - o + s and k - o + s.  The largest s that needs few keys is taken: most
    names are filed under several rare words at once.
    """
    rows = []
    for n in range(1, MOST_WORDS + 1):
        for k in range(1, MOST_WORDS + 1):
            if o := shared_at_least(n, k, least):
                s = max((s for s in range(1, o + 1) if max(comb(n - o + s, s), comb(k - o + s, s)) <= MOST_KEYS), default=1)
                rows += [(n, k, f"{min(n, k)}.{max(n, k)}", list(c)) for c in combinations(range(n - o + s), s)]
    return rows


def _by_rarity(sets: DataFrame, words: DataFrame) -> DataFrame:
    """(t, r): each word set with its words by document frequency, rarest first."""
    ranked = sets.select("t", F.explode("t").alias("word")).join(words, "word")
    return ranked.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "word"))), lambda x: x["word"]).alias("r"))


def _set_key(t: Column) -> Column:
    """16 bytes that stand for a word set in joins, so that its words don't move with each pair."""
    return F.unhex(F.md5(F.array_join(t, "\x01")))


def _filed(sets: DataFrame, least: float, side: str, sizes: DataFrame | None = None) -> DataFrame:
    """(key, long, set, r): a set under its keys, which tell the two sizes apart, or which side is a long name.

    With ``sizes`` (k) there are keys for partners of these numbers of words alone.
    """
    spark: SparkSession = sets.sparkSession
    plan = spark.createDataFrame(_plan(least), "n int, k int, sizes string, places array<int>")  # a few thousand rows, whatever the data
    if sizes is not None:
        plan = plan.join(F.broadcast(sizes.where(F.col("k") <= MOST_WORDS).distinct()), "k", "left_semi")  # MOST_WORDS rows at most
    own, other = ("n", "k") if side == "left" else ("k", "n")
    sized = sets.select(_set_key(F.col("t")).alias("set"), "r", F.size("r").alias("n"))
    short = sized.join(F.broadcast(plan), "n").select(
        F.concat_ws("\x01", F.col(own).cast("string"), F.col(other).cast("string"), F.array_join(F.transform("places", lambda i: F.get(F.col("r"), i)), "\x02")).alias("key"), "set", "r", F.lit(False).alias("long")
    )
    share = max(2 * (least - _ROUNDED) - 1, 0.0)
    size = F.col("n")
    prefix = (size - F.greatest(F.lit(1), F.ceil(size * share).cast("int")) + 1).cast("int")
    # Long names meet long and short ones, short ones only long ones here.
    is_long = size > MOST_WORDS
    with_short, with_long = ("ls", "sl") if side == "left" else ("sl", "ls")
    kinds = F.when(is_long, F.array(F.lit("ll"), F.lit(with_short))).otherwise(F.array(F.lit(with_long)))
    may_meet = sized.where(is_long | (size >= int(share * (MOST_WORDS + 1))))
    words = may_meet.select(F.explode(F.slice("r", F.lit(1), prefix)).alias("word"), "set", "r", kinds.alias("kinds"))
    long = words.select(F.explode("kinds").alias("kind"), "word", "set", "r").select(F.concat_ws("\x01", "kind", "word").alias("key"), "set", "r", F.lit(True).alias("long"))
    return short.unionByName(long).withColumnRenamed("set", f"set_{side}").withColumnRenamed("r", f"r_{side}")


def _named(names: DataFrame, least: float) -> DataFrame:
    """(id, t): names that have words, with their distinct words in order."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and 1 at most")
    return names.select("id", F.array_sort(F.array_distinct(text.name_tokens(F.col("name")))).alias("t")).where(F.size("t") > 0)


def _alike(a: DataFrame, b: DataFrame, least: float, once: bool) -> DataFrame:
    """(set_left, set_right, similarity) of the word sets (t) that are alike enough; ``once``: of one table, each two sets in one order."""
    each = (a.select("t") if once else a.select("t").union(b.select("t"))).distinct()
    df = each.select(F.explode("t").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    ranked = _by_rarity(each, df)
    mine = lambda ids: ranked if once else ranked.join(ids.select("t").distinct(), "t", "left_semi")
    sizes = lambda ids: ids.select(F.size("t").alias("k"))
    # The plan's k is the partner's size on both sides.
    met = _filed(mine(a), least, "left", sizes(b)).join(_filed(mine(b), least, "right", sizes(a)), ["key", "long"])
    if once:
        met = met.where("set_left <= set_right")
    both = F.array_intersect("r_left", "r_right")
    # A pair may meet under several keys; the one of its first shared words counts.
    words = F.get(F.split("key", "\x01"), F.lit(2))
    first = F.array_join(F.slice(both, F.lit(1), F.size(F.split(words, "\x02"))), "\x02")
    counts = F.when(F.col("long"), F.element_at(F.split("key", "\x01"), 2) == F.get(both, F.lit(0))).otherwise(words == first)
    score = text.shared_similarity(F.size(both), F.size("r_left"), F.size("r_right"))
    return met.where(counts).select("set_left", "set_right", score.alias("similarity")).where(F.col("similarity") >= least)


def _ids(named: DataFrame, side: str) -> DataFrame:
    """Which ids a set has; joined by sorting, since names look as small as the columns they are made of and would be broadcast whole."""
    return named.select(F.col("id").alias(f"{side}_id"), _set_key(F.col("t")).alias(f"set_{side}")).hint("merge")


def similar_names(left: DataFrame, right: DataFrame, least: float = vocab.NAME_KEEP) -> DataFrame:
    """(left_id, right_id, similarity) of names (id, name) that are alike enough.

    Names become distinct word sets first, so repeated names are compared once.  Sets are
    filed under their rarest words, for each size that a partner may have (`_plan`), so two
    meet only where they share as many rare words as their sizes demand, under one key
    that counts; the score is then computed.  Names without words are like nothing.
    """
    a, b = _named(left, least), _named(right, least)
    scored = _alike(a, b, least, once=False)
    return scored.join(_ids(a, "left"), "set_left").join(_ids(b, "right"), "set_right").select("left_id", "right_id", "similarity")


def similar_pairs(names: DataFrame, least: float = vocab.NAME_KEEP) -> DataFrame:
    """`similar_names` of a table (ids are unique) with itself, each two names once: left_id < right_id.  Two sets meet and move in one order only."""
    a = _named(names, least)
    pairs = _alike(a, a, least, once=True).join(_ids(a, "left"), "set_left").join(_ids(a, "right"), "set_right")
    pairs = pairs.where((F.col("set_left") != F.col("set_right")) | (F.col("left_id") < F.col("right_id")))
    return pairs.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "similarity")


def _grams(flat, gram: int):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(flat) - gram + 1), lambda i: F.substring(flat, i, F.lit(gram))))


def rarest_grams(codes: DataFrame, texts: DataFrame, gram: int = vocab.MIN_OEM) -> DataFrame:
    """(code, gram, df): each code's gram that the fewest of ``texts`` (flat) have; codes with a gram in none are left out.

    Only grams of codes are counted, by partial aggregates.
    """
    parts = codes.select("code").distinct().where(F.length("code") >= gram).select("code", F.explode(_grams(F.col("code"), gram)).alias("gram"))
    wanted = parts.select("gram").distinct()
    met = texts.where(F.length("flat") >= gram).select(F.explode(_grams(F.col("flat"), gram)).alias("gram")).join(wanted.hint("merge"), "gram", "left_semi")
    df = met.groupBy("gram").agg(F.count("*").alias("df"))
    best = parts.join(df.hint("merge"), "gram", "left").groupBy("code").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("b"))
    return best.select("code", "b.gram", "b.df").where("df > 0")


def containing_code(queries: DataFrame, offers: DataFrame, gram: int = vocab.MIN_OEM) -> DataFrame:
    """(query_id, offer_id, code) where a code occurs inside an offer's normalised text.

    Each code is filed under its rarest gram of ``gram`` characters; texts look up their own grams, and the
    whole code is then looked for.  A brand's prefix that all codes share is no code's key,
    unless nothing in the code is rarer.  Codes shorter than a gram are not looked for.
    The joins are sort-merge joins by hint: a list of grams looks as small as the column it is made of, and would be
    broadcast whole through the driver.
    """
    codes = queries.select("query_id", F.explode(text.matchable(F.col("oem_numbers"))).alias("code")).distinct()
    flat = offers.select("offer_id", text.norm_code(F.col("title")).alias("flat"))
    filed = rarest_grams(codes, flat, gram).select("gram", "code")
    pieces = flat.where(F.length("flat") >= gram).select("offer_id", "flat", F.explode(_grams(F.col("flat"), gram)).alias("gram"))
    hits = filed.join(pieces.hint("merge"), "gram").where(F.contains("flat", "code")).select("code", "offer_id").distinct()
    return codes.join(hits.hint("merge"), "code").select("query_id", "offer_id", "code")
