import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, kind):
    parts = {"en": ["the", "ing", "tion", "er", "and", "th"], "de": ["der", "ung", "sch", "keit", "ü", "ein"]}[kind]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts of two languages with copies, near copies, nulls, empty and very long texts, and repeated rows."""
    rng = random.Random(8)
    out = []
    for i in range(120):
        kind = "en" if i % 3 else "de"
        out.append((i, words(rng, rng.randint(5, 90), kind).capitalize() + ".\n" + words(rng, 8, kind), kind, f"s{i % 4}", 0))
    for i in range(12):  # copies that differ in white space, and near copies
        base = out[i * 7]
        out.append((200 + i, base[1].replace(" ", "  ") + "\n", base[2], base[3], 0))
        out.append((300 + i, base[1] + " " + words(rng, 2, "en"), base[2], "s0", 0))
    out += [(400, None, "en", None, None), (401, "", None, "s1", 0), (402, " \t\n", "de", "s1", 0), (403, "12 34 !!", "en", None, 0), (None, "a null id", "en", "s2", 0)]
    out += [(404, words(rng, 30_000, "en"), "en", "s3", 0), (405, "x" * 100_000, "en", "s3", 0), (406, "7" * 50_000, "de", "s3", 0)]
    return out + [out[5], out[5], (5, "same id, other text", "en", "s1", 0)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Further columns under names that the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("id", "row", "run", "digest", "set_id", "size", "copies", "part", "number", "length", "count", "n", "score", "rate", "host", "_digest", "_id", "key", "level")
    return docs.withColumns({n: F.lit("x") for n in names})
