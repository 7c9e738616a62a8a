"""Small tables with every awkward row: nulls, empty and long texts, ties, copies, extra columns that clash."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with the names that the operators use for their own.
CLASHING = ["size", "words", "ids", "data", "node", "k", "part", "name", "n", "score", "copy", "taken", "pos", "line", "h", "g", "first", "rows", "c", "comp", "best", "again", "_key", "_K", "_gone", "_lines", "_doc", "_text", "_row", "_id", "_size", "_th", "_copy", "_taken", "_slots", "_out", "_hot", "_part"]


def prose(rng, n, words=None):
    words = words or ["river", "stone", "Winter", "über", "año", "lamp", "green", "walk", "seven", "cloud", "paper", "tiny"]
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


def awkward_rows():
    rng = random.Random(5)
    base = prose(rng, 60)
    words = base.split()
    near = " ".join([*words[:30], "changed", *words[31:]])
    rows = [
        (1, base, "en", "a"), (2, base.upper().replace("Ü", "ü").replace("Ñ", "ñ"), "en", "a"), (3, near, "en", "b"), (4, base + " tail", "de", "c"),
        (5, None, None, None), (6, "", "en", None), (7, " \n\t ", "en", "a"), (8, "one", "en", "b"), (9, "one", "fr", "b"), (10, "two words", None, "c"),
        (None, prose(rng, 40), "en", "a"), (None, prose(rng, 41), "en", "d"), (12, base, "en", "e"), (12, base, "en", "e"), (13, "\n".join(["same line here"] * 5), "en", "a"),
        (14, prose(rng, 30_000), "en", "f"), (15, "x" * 70_000, "en", "f"), (16, "é ü " * 50, "es", "g"), (17, "\U0001f600 tail\x0bb\x0cc", "en", "h"),
    ]
    for i, source in enumerate("abcdefgh"):
        rows.append((30 + i, f"Shared footer line.\n{prose(rng, 30)}\nrare {source}\n", "en", source))
    rows += [(100 + i, prose(rng, rng.randrange(3, 80)), rng.choice(["en", "de"]), rng.choice("abc")) for i in range(60)]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(awkward):
    from pyspark.sql import functions as F

    return awkward.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
