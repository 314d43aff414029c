"""URL filters by association rules.

Fixed rules allow or block hosts and paths.  What they judge serves as labels: Spark's
FP-growth mines combinations of URL tokens that go with a verdict, rules below a support
or a confidence are pruned, and the rest judge the other URLs.  Rules match through an
inverted index: each is filed under its rarest token, a URL meets only the rules filed
under tokens it has, and the rest of the rule is verified by containment.
Only DataFrame functions and Spark's own JVM miner.

Shape at scale: hosts of millions of pages cost nothing, as token rows join the index
without any grouping above the join in its stage.  The number of rules is bounded by the
support (at most 1/support single tokens, and so on); it is counted before a broadcast.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, lower_ascii, stage

#: (verdict, host, start of the path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """What a URL is made of: host labels and their suffixes, path words, length classes."""
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    tagged = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.filter(F.split(F.regexp_replace(host, r"[^a-z0-9]+", "-"), "-"), lambda x: F.length(x) > 2), lambda x: F.concat(F.lit("w:"), x)),
        F.transform(parts, lambda x: F.concat(F.lit("p:"), F.when(x.rlike(r"^\d+$"), F.concat(F.lit("number"), F.substring(x, 1, 1))).otherwise(x))),
        F.array(F.concat(F.lit("q:"), F.when(url.contains("?"), F.lit("query")).when(url.contains("#"), F.lit("anchor")).otherwise(F.lit("none")))),
    )
    return F.array_distinct(tagged)


def folded(labelled: DataFrame, support: float, rows: int) -> DataFrame:
    """(token, item) of the tokens in at least ``support`` of the ``rows``; tokens that stand in the same rows are one item, the first of them by name.

    Rows of such tokens have equal count, sum and exclusive or of their hashes.  Without
    folding, k tokens that always come together make 2^k frequent sets.
    """
    h = F.xxhash64(F.lit(7), "row")
    each = labelled.select("row", F.explode("items").alias("token"))
    sets = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("s"), F.bit_xor(h).alias("x")).where(F.col("n") >= support * rows)
    return sets.select("token", F.min("token").over(Window.partitionBy("n", "s", "x")).alias("item"))


def mine(labelled: DataFrame, support: float = 0.02, confidence: float = 0.6, longest: int = 4) -> DataFrame:
    """(verdict, antecedent, confidence, support) mined from (items, verdict) rows: rules with at least that support and confidence, of up to ``longest`` items."""
    baskets = labelled.select(F.array_append("items", F.concat(F.lit("verdict="), F.col("verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent")[0].startswith("verdict="))
    plain = ~F.exists("antecedent", lambda x: x.startswith("verdict="))
    return found.where(plain & (F.size("antecedent") <= longest)).select(
        F.substring_index(F.col("consequent")[0], "=", -1).alias("verdict"), F.array_sort("antecedent").alias("antecedent"), "confidence", "support"
    )


def judge(pages: DataFrame, rules=RULES, support: float = 0.02, confidence: float = 0.6, longest: int = 4, default: str | None = None, scope: str = "urls") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, and the mined rule that decided (``mined``).

    Of the mined rules that match, the most confident one decides, then the one with more
    support, more items, and the first by its text; where none matches, ``default``, or if that isn't given the
    verdict that most labelled urls have (allow, of equals).
    A null url or one without ``://`` has an empty host and path and gets the default.
    Where the fixed rules judge nothing (an empty table too), nothing is mined.  Rows that repeat
    are judged one by one; other columns, also those named as the ones made here, are not looked at.

    Tokens of the labelled urls are folded (`folded`): an item stands for tokens that always
    come together there, and a url has it if it has one of them.
    """
    url = F.coalesce("url", F.lit(""))
    rule, verdict = rule_of(host_of(url), path_of(url), rules)
    cut = pages.select("page_id", F.monotonically_increasing_id().alias("row"), host_of(url).alias("host"), path_of(url).alias("path"), tokens(host_of(url), path_of(url), url).alias("items"), rule.alias("rule"), verdict.alias("verdict"))
    cut = stage(cut, scope)
    labelled = cut.where("verdict IS NOT NULL")
    votes = {r[0]: r[1] for r in labelled.groupBy("verdict").count().collect()}
    default = default or ("block" if votes.get("block", 0) > votes.get("allow", 0) else "allow")
    if not votes:
        return cut.select("page_id", "host", "path", "rule", F.lit(default).alias("verdict"), F.lit(None).cast("string").alias("mined"))
    items = broadcast_if_small(stage(folded(labelled, support, sum(votes.values())), scope))
    had = cut.where("host <> ''").select("row", "verdict", F.explode("items").alias("token")).join(items, "token")
    made = stage(had.groupBy("row", "verdict").agg(F.array_sort(F.collect_set("item")).alias("items")), scope)
    # Labelled urls without any frequent token count in the support too.
    baskets = labelled.select("row", "verdict").join(made.where("verdict IS NOT NULL").select("row", F.col("items").alias("_items")), "row", "left").select("verdict", F.coalesce("_items", F.array().cast("array<string>")).alias("items"))
    mined = stage(mine(baskets, support, confidence, longest), scope)
    frequency = made.where("verdict IS NOT NULL").select(F.explode("items").alias("key")).groupBy("key").agg(F.count("*").alias("df"))
    ranked = mined.select("*", F.explode("antecedent").alias("key")).join(frequency, "key")
    filed = ranked.groupBy("verdict", "antecedent", "confidence", "support").agg(F.min(F.struct("df", "key"))["key"].alias("key"))
    filed = broadcast_if_small(stage(filed.withColumnRenamed("verdict", "says"), scope))

    open_ = made.where("verdict IS NULL").select("row", "items", F.explode("items").alias("key"))
    hits = open_.join(filed, "key").where(F.size(F.array_except("antecedent", "items")) == 0)
    order = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), (-F.size("antecedent")).alias("n"), F.array_join("antecedent", " ").alias("a"), F.col("says").alias("v"))
    best = hits.groupBy("row").agg(F.min(order).alias("b"))
    return cut.join(best, "row", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.col("b.v"), F.lit(default)).alias("verdict"), F.col("b.a").alias("mined"),
    )
