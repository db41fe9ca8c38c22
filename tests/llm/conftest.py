import random

import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, component string, rep long, family long, target int, pid int"


def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    r = random.Random(7)
    words = ["the", "Of", "and,", "tion", "ére", "über", "niño", "x", "日本", "a.", "\U0001f600"]
    base = " ".join(r.choice(words) + str(r.randrange(400)) for _ in range(150))
    edited = base.replace("the", "THE").split(" ")
    edited[70] = "changed"
    texts = [None, "", " ", "\n\t", "one", "one two", "One TWO", base, base, base.upper().lower(), " ".join(edited), base[:700] + " other tail " + base[700:1300], "12 34 -- !!", "same line here for all of us.\n" * 40, "a" * 500, "b a" * 300]
    texts.append(" ".join(r.choice(words) + str(r.randrange(5000)) for _ in range(30_000)))
    rows = [(i, t, ["en", "de", None][i % 3], None if i % 2 else "src0", None, 0.5, "c", 1, 2, 3, 4) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, 3, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), (7, base, "en", "src0", 1, None, None, None, None, None, None), (5, "one two", "en", None, 1, None, None, None, None, None, None)]
    rows += [(100 + i, " ".join(r.choice(words[:8]) + str(r.randrange(50)) for _ in range(r.randrange(1, 80))), "en" if i % 2 else "fr", "src1", 5, 0.1, "x", 1, 1, 1, 1) for i in range(40)]
    rows.append((1000, "start " + base[200:900] + " end", "en", "src2", 5, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
