"""Similar names and codes inside texts against all pairs, and how large their buckets get."""

import random

import pytest
from pyspark.sql import functions as F

from pricelark.functions import text
from pricelark.operators import matching


def score(a, b):
    i = len(a & b)
    return round(0.5 * i / len(a | b) + 0.5 * i / min(len(a), len(b)), 3) if a and b else 0.0


@pytest.mark.parametrize("least", [0.3, 0.55, 0.7, 0.8, 1.0])
def test_similar_names(spark, least):
    rng = random.Random(int(least * 100))
    words = [f"w{i:02}" for i in range(40)]
    pick = lambda n: " ".join(rng.choices(words, weights=[1000 / (i + 1) for i in range(40)], k=n))
    names = [(i, pick(rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 14, 25]))) for i in range(260)] + [(900, None), (901, ""), (902, "a b"), (903, "для the")]
    names += [(1000 + i, names[i][1] + " extra") for i in range(0, 200, 5)] + [(2000, names[3][1])]
    left, right = (spark.createDataFrame(x, "id long, name string") for x in (names[:200], names[100:]))
    got = {(r.left_id, r.right_id): r.similarity for r in matching.similar_names(left, right, least).collect()}
    sets = {i: set((n or "").split()) if i not in (902, 903) else set() for i, n in names}
    want = {(i, j): s for i, _ in names[:200] for j, _ in names[100:] if (s := score(sets[i], sets[j])) >= least}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1.1e-3 for k in want)
    assert matching.similar_names(left.limit(0), right, least).count() == 0


def test_names_do_not_meet_by_common_words(spark):
    """All 2,000 names share three words: what meets under the keys is hardly more than what is alike, not 4,000,000 pairs."""
    names = spark.range(2000).select("id", F.concat(F.lit("common words here k"), (F.col("id") % 500).cast("string"), F.lit(" z"), F.col("id").cast("string")).alias("name"))
    t = names.select(F.array_sort(F.array_distinct(text.name_tokens(F.col("name")))).alias("t"))
    df = t.select(F.explode("t").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    ranked = matching._by_rarity(t, df)
    assert matching._filed(ranked, 0.7, "left").join(matching._filed(ranked, 0.7, "right"), ["key", "long"]).count() <= 5 * 2000 * 4
    got = matching.similar_names(names, names)
    assert got.count() == got.distinct().count() == 2000 * 4


def test_pairs_of_one_table_move_once_and_narrow(spark):
    """Each two names once, as `similar_names` has them; sets of sizes that no name has get no key; no words move with a pair."""
    rng = random.Random(7)
    words = [f"w{i:02}" for i in range(30)]
    names = [(i, " ".join(rng.choices(words, weights=[300 / (i + 1) for i in range(30)], k=rng.choice([2, 4, 5, 14])))) for i in range(200)]
    names += [(1000 + i, " ".join(reversed(names[i][1].split()))) for i in range(0, 200, 4)] + [(2000, None), (2001, "")]
    table = spark.createDataFrame(names, "id long, name string")
    got = [tuple(r) for r in matching.similar_pairs(table, 0.7).collect()]
    assert len(got) == len(set(got)) > 50
    assert set(got) == {tuple(r) for r in matching.similar_names(table, table, 0.7).where("left_id < right_id").collect()}
    named = matching._named(table, 0.7)
    assert "t" not in (alike := matching._alike(named, named, 0.7, once=True)).columns
    assert alike.where("set_left > set_right").count() == 0
    five = spark.createDataFrame([(["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e"])], "t array<string>, r array<string>")
    sizes = spark.createDataFrame([(5,), (14,)], "k int")
    assert {k.split("\x01")[1] for (k,) in matching._filed(five, 0.7, "left", sizes).where("NOT long").select("key").collect()} == {"5"}


def test_code_inside_text(spark):
    rng = random.Random(5)
    codes = [(i, ["BRAND" + "".join(rng.choices("01", k=rng.randrange(1, 5))), "12", None]) for i in range(60)] + [(90, []), (91, None)]
    titles = [(i, rng.choice(["", "x "]) + "brand-" + "".join(rng.choices("01", k=rng.randrange(0, 9)))) for i in range(200)] + [(900, None), (901, ""), (902, "BRAND")]
    q, o = spark.createDataFrame(codes, "query_id long, oem_numbers array<string>"), spark.createDataFrame(titles, "offer_id long, title string")
    flat = {i: "".join(c for c in (n or "").upper() if c.isalnum()) for i, n in titles}
    want = {(i, j, c) for i, cs in codes for c in (cs or []) if c and len(c) >= 6 for j in flat if c in flat[j]}
    assert {tuple(r) for r in matching.containing_code(q, o).collect()} == want


def test_codes_are_filed_under_rare_grams(spark):
    """5,000 codes share a prefix of 8 characters: the largest bucket has a handful of codes, and a gram that no text has none."""
    codes = spark.range(5000).select(F.concat(F.lit("MAKER000"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("code"))
    texts = spark.range(4000).select(F.concat(F.lit("NEWMAKER000"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("OK")).alias("flat"))
    filed = matching.rarest_grams(codes, texts)
    assert 4000 <= filed.count() <= 5000
    assert filed.groupBy("gram").count().agg(F.max("count")).first()[0] <= 10
    assert filed.where("df > 111").count() <= 4  # 0 to 3, whose digits others begin with
