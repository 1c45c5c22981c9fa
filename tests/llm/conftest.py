import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, predicted int"


def prose(n: int, seed: int, words: str = "the of and river stone walks quietly under seven lamps while morning bread waits") -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words.split()) + r.choice(["", "", "", "n", "s", "ing"]) + str(r.randrange(9)) * (r.random() < 0.05) for _ in range(n))


def documents() -> list[tuple]:
    """Nulls in every column, empty and blank texts, a very long text, exact and near copies, repeated rows, clashing columns."""
    rows = []
    for i in range(40):
        rows.append((i, prose(60 + 7 * i, i), "en" if i % 2 else "xx", f"s{i % 3}", 1, 0.5, 1))
    rows.append((100, rows[3][1], "en", "s0", 1, None, None))
    for i in range(6):
        w = rows[20][1].split()
        w[10 + i] = f"edit{i}"
        rows.append((101 + i, " ".join(w), "en", "s1", 1, 0.1, 0))
    rows += [(200, None, None, None, None, None, None), (201, "", "en", "", 0, 0.0, 0), (202, " \t\n ", None, "s0", 3, 0.0, 0), (203, "One two", "en", "s0", 1, 0.0, 0), (204, "one TWO", "en", None, 1, 0.0, 0), (205, "12 34 !!", "en", "s9", 1, 0.0, 0)]
    rows += [(206, prose(30_000, 77), "en", "s2", 1, 0.0, 0), (207, "x" * 200_000, "en", "s2", 1, 0.0, 0), (None, prose(50, 5), "en", "s1", 1, 0.0, 0)]
    rows += [rows[5], (208, "Été. <|endoftext|> it's, H̱i. 漢字 🙂x", "fr", "é", 1, 0.0, 0)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    df = spark.createDataFrame(documents(), DOCS).repartition(3)
    return df


@pytest.fixture
def scratch(spark):
    from millrace.llm.common import Scratch

    return Scratch(spark, "test")
