import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, digest string, n long, part long, bad int, component_id long, size long"


def plain(n: int) -> str:
    return " ".join(f"word{i * 7919 % 1000}x{i}" for i in range(n)) + "."


LONG = plain(20_000)
EDGE = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n\x0b\x0c\r", "en", "a"),
    (4, "one", "en", "a"),
    (5, "one", "en", "a"),
    (6, "ONE two", "de", None),
    (7, LONG, "en", "b"),
    (8, LONG + " tail", "en", "b"),
    (9, "é" * 60 + " " + "ñandú " * 30, "es", "b"),
    (10, "same line here\nsame line here\n\nsame line here", "en", "c"),
    (11, plain(60), "en", "c"),
    (11, plain(60), "en", "c"),
    (12, "\x00nul\x00" * 20, "en", "c"),
    (13, "a" * 300, "en", "c"),
    (14, "a" * 299, "en", "c"),
    (15, "😀 emoji 😀 text, \u0301 marks", "en", "c"),
    (None, "one", "en", "a"),
    (None, None, None, None),
]


def table(spark, rows):
    full = [(i, t, lang, s, len(t or ""), "x", 1, 2, 3, 4, 5) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DDL)


@pytest.fixture(scope="session")
def edge(spark):
    return table(spark, EDGE).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])
