import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, digest int, kept string, row int"


def hostile_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, a hot source, many copies."""
    rng = random.Random(5)
    words = [("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randint(5, 120)) for _ in range(60)]
    texts += ["", " \t\n", "a", "one two", "The the THE\tthe", "x" * 5000, prose(9000), "é ß 中文 🙂 Ünïcode", "cc by " * 700]
    texts += [texts[3] + "  ", " " + texts[3], texts[3].replace(" ", "\n")]
    base = prose(300)
    texts += [base + f" {w}" for w in words[:20]] + [base] * 3
    rows = [(k, t, rng.choice(["en", "de", "xx", None]), rng.choice(["big", "big", "big", "b", "c", None]), len(t), "s", 1, "no", 2) for k, t in enumerate(texts)]
    rows += [(500 + k, "copy of a hot text", "en", "big", 1, None, None, None, None) for k in range(120)]
    rows += [rows[4], rows[4], (None, None, None, None, None, None, None, None, None), (None, "no id here", "en", "b", 9, None, 1, "x", 1)]
    rows += [(7, "another text under a used id", "fr", "c", 3, "z", 4, "y", 0), (900, None, "en", "b", 0, "z", 4, "y", 0)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return hostile_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
