import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """n pseudo-random words in sentences."""
    x, out = seed * 7919 + 13, []
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50) + ("." if i % 9 == 8 else ""))
    return " ".join(out)


#: doc_id, text, lang, source, n_chars, and extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, range int, node long, bucket long, key long, id long, of string, gone string, size long, unit long, `at` int, n long, spans string"


def make(spark, rows):
    full = [(i, t, "en", s, None if t is None else len(t), 1, 2, 3, 4, 5, 6, "7", "8", 9, 10, 11, 12, "13") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and long texts, ties, repeated rows, exact and near copies, white space, symbols."""
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, base, "a"), (5, base, "b"), (6, " ".join(near), "b"), (7, prose(2, 3000), "a"), (8, "one", "b"),
        (9, "Released under the MIT License. " + prose(3, 60), "c"), (10, prose(4, 30) + "\n" + base + "\n" + prose(5, 30), "c"), (11, "été ñandú 漢字 𝒳 <|endoftext|> don't", None),
        (12, "THIS!! IS!! LOUD!!\n" * 30, "a"), (12, "THIS!! IS!! LOUD!!\n" * 30, "a"), (13, "a  b\n\n c \t d\r\n", "a"), (None, prose(6, 80), "a"), (14, "x " * 2000, "b"), (15, "#$% & | <>" * 40, "b"),
    ]
    return make(spark, rows).coalesce(1).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
