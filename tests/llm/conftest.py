import pytest

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, size INT, score DOUBLE, rank INT, n INT, `group` STRING, token STRING"
SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i * i % 7919} the" for i in range(20_000))


@pytest.fixture()
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    more = (7, 0.5, 3, 1, "g", "t")
    rows = [
        (1, "One fine day the fox ran.\nOver the hill it went.\nThen home.\nAnd slept.", "en", "b", 60, *more),
        (1, "One fine day the fox ran.\nOver the hill it went.\nThen home.\nAnd slept.", "en", "b", 60, *more),
        (2, "One fine day the fox ran.\nOver the hill it went.\nThen home.\nAnd slept.", "en", "a", 60, *more),
        (None, "Ein Text ohne Nummer steht hier.\nNoch eine Zeile.\nUnd noch eine.", None, None, None, *[None] * 6),
        (None, "Ein Text ohne Nummer steht hier.\nNoch eine Zeile.\nUnd noch eine.", "de", "a", 60, *more),
        (3, None, "en", "a", None, *more),
        (4, "", "fr", None, 0, *more),
        (5, " \n\t \n\n ", "fr", "a", 6, *more),
        (6, LONG, "en", "b", len(LONG), *more),
        (7, "12345 !!! ???", "en", "c", 13, *more),
        (8, "Le petit chat boit du lait.", "fr", "a", 27, *more),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
