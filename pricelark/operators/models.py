"""Model passes as data: prompts, batches, and what their answers mean.

The model itself is outside: it fills a table of answers.  Whatever it says on one run
stays said, so results can be computed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST, CHUNK, VERIFY_CHUNK = 120, 25, 12


def prompt(name: Column, brand: Column, numbers: Column, titles: Column) -> Column:
    """The text that asks for verdicts on numbered titles; a missing brand or an empty list leaves its line out."""
    maker = F.when(F.coalesce(brand, F.lit("")) != "", F.concat(F.lit("Виробник: "), brand))
    listed = F.when(F.size(numbers) > 0, F.concat(F.lit("Каталожні номери: "), F.array_join(numbers, ", ")))
    lines = F.transform(titles, lambda t, i: F.concat(i.cast("string"), F.lit(". "), t))
    head = F.filter(F.array(F.concat(F.lit("Наша деталь: "), name), maker, listed), lambda x: x.isNotNull())
    return F.array_join(F.concat(head, F.array(F.lit(""), F.lit("Кандидати:")), lines), "\n")


def batches(candidates: DataFrame, size: int = CHUNK) -> DataFrame:
    """(query_id, source, chunk, titles): candidates (position from 0) in batches, the first 120 of a list."""
    chosen = candidates.where(F.col("position") < MOST).withColumn("chunk", F.floor(F.col("position") / size).cast("int"))
    listed = chosen.groupBy("query_id", "source", "chunk").agg(F.sort_array(F.collect_list(F.struct("position", "title"))).alias("l"))
    return listed.select("query_id", "source", "chunk", F.transform("l", lambda x: x["title"]).alias("titles"))


def verdicts(candidates: DataFrame, answers: DataFrame, missing: str = "no", size: int = CHUNK, by: tuple[str, ...] = ("query_id", "source")) -> DataFrame:
    """(query_id, source, position, verdict) from answers (query_id, source, chunk, response JSON).

    A batch whose answer can't be read, or holds no verdict, leaves its candidates without
    one; in one that was judged, those left out get ``missing``.  The answers to a list (``by``), a handful, are
    one row, so candidates that lie by their list meet them where they are.
    """
    shape = "struct<verdicts: array<struct<index: int, verdict: string>>>"
    usable = lambda x: x["index"].between(0, size - 1) & x["verdict"].isNotNull()
    said = answers.where(F.col("chunk") <= (MOST - 1) // size).select(*by, "chunk", F.filter(F.from_json("response", shape)["verdicts"], usable).alias("v")).where(F.size("v") > 0)
    lists = said.groupBy(*by).agg(F.collect_list(F.struct("chunk", "v")).alias("said"))
    placed = candidates.where(F.col("position") < MOST).select(*by, "position", F.floor(F.col("position") / size).cast("int").alias("chunk"), (F.col("position") % size).cast("int").alias("i"))
    own = F.flatten(F.transform(F.filter("said", lambda s: s["chunk"] == F.col("chunk")), lambda s: s["v"]))
    judged = placed.join(lists, list(by)).select(*by, "position", "i", own.alias("own")).where(F.size("own") > 0)
    verdict = F.array_max(F.transform(F.filter("own", lambda x: x["index"] == F.col("i")), lambda x: x["verdict"]))
    return judged.select(*by, "position", F.coalesce(verdict, F.lit(missing)).alias("verdict"))


def market_line(low: Column, median: Column, high: Column) -> Column:
    """What a verification prompt says of the market."""
    return F.concat(F.lit("Ринок: мін "), low.cast("string"), F.lit(", медіана "), median.cast("string"), F.lit(", макс "), high.cast("string"))


def verify_prompt(name: Column, brand: Column, numbers: Column, market: Column, candidates: Column) -> Column:
    """The text that asks to check offers: ``candidates`` is an array of structs of title, price, seller, availability and condition.

    A missing brand, seller or stock note leaves its line out; an unknown condition says so.
    """
    maker = F.when(F.coalesce(brand, F.lit("")) != "", F.concat(F.lit("Виробник: "), brand))
    listed = F.when(F.size(numbers) > 0, F.concat(F.lit("Каталожні номери: "), F.array_join(numbers, ", ")))
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"   {label}: "), value))
    each = lambda o, i: F.concat_ws("\n", F.concat(i.cast("string"), F.lit(". "), o["title"]), F.concat(F.lit("   ціна: "), o["price"].cast("string")), line("продавець", o["seller"]), line("наявність", o["availability"]), F.concat(F.lit("   стан: "), F.coalesce(F.nullif(o["condition"], F.lit("")), F.lit("невідомо"))))
    head = F.filter(F.array(F.concat(F.lit("Наша деталь: "), name), maker, listed, market), lambda x: x.isNotNull())
    return F.array_join(F.concat(head, F.array(F.lit(""), F.lit("Кандидати:")), F.transform(candidates, each)), "\n")


def verify_batches(picked: DataFrame, size: int = VERIFY_CHUNK) -> DataFrame:
    """(query_id, chunk, candidates): the offers of the second pass (query_id, position, ...) in batches of ``size``, in their order."""
    facts = F.struct("position", "title", F.col("price").cast("string").alias("price"), F.col("seller").cast("string").alias("seller"), "availability", "condition")
    placed = picked.withColumn("chunk", F.floor(F.col("position") / size).cast("int"))
    return placed.groupBy("query_id", "chunk").agg(F.sort_array(F.collect_list(facts)).alias("candidates"))  # ``size`` at most


def verify_verdicts(picked: DataFrame, answers: DataFrame, size: int = VERIFY_CHUNK) -> DataFrame:
    """(query_id, position, verdict) from answers (query_id, chunk, response): in a batch that was judged, offers left out are ``unsure``."""
    return verdicts(picked, answers, "unsure", size, ("query_id",))
