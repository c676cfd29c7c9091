import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that a user's table may bring and whose names operators use inside.
EXTRA = ["_key", "bucket", "line", "rank", "items", "size", "_n", "h", "key", "fp", "doc_key"]


def rows(seed=5, n=60):
    """Documents with copies, near copies, repeated lines and passages, odd texts and odd ids."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(150)] + ["Été", "naïve", "don't", "x9", "--", "日本"]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared, boiler = line(45), ["header " + line(3), line(30)]
    out = []
    for k in range(n):
        text = "\n".join(line(r.randint(0, 25)) for _ in range(r.randint(1, 6)))
        if k % 5 == 0:
            text += "\n" + shared
        if k % 7 == 0:
            text = "\n".join(boiler) + "\n" + text
        if k % 9 == 4:
            text = out[-3][1]
        if k % 11 == 6 and out[-2][1]:
            text = out[-2][1] + " tail"
        out.append((k * 3, text, r.choice(["en", "fr"]), f"src{r.choice([0, 0, 0, 1, 2])}"))
    out += [(1000, None, "en", "src1"), (1001, "", "en", None), (1002, " \n\t ", None, "src0"), (1003, "a", "en", "src9"), (1004, "a", "en", "src9"), (1005, "lone space\x1cfs\x85nel <|endoftext|> é", "en", "é")]
    out += [(1006, " ".join(["loop"] * 300), "en", "src0"), (1007, "w" * 20_000, "en", "src0"), (1008, "\n".join(["same line"] * 40), "en", "src0"), (None, "no id here " + shared, "en", "src0")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in out]


@pytest.fixture(scope="session")
def table():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def wide(spark, table):
    """The same rows with extra columns of clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(table, SCHEMA)
    for name in EXTRA:
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
