import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

PROSE = "the quick brown fox jumps over the lazy dog while many other animals watch from behind the tall green trees near the river bank today"


def variant(k: int, n: int = 80) -> str:
    return " ".join(f"w{(i * 7919 + k * 104729) % 9973}" for i in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and wordless texts, ties, repeated rows, a long text, and clashing names."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \n\t \n", "en", "s", 5),
        (4, PROSE, "en", "s", 1),
        (4, PROSE, "en", "s", 1),
        (5, PROSE, "en", "s", 1),
        (6, "short", "en", "s", 5),
        (7, "short", "en", "s", 5),
        (None, variant(1), "en", "s", 5),
        (8, variant(2, 30_000), "en", "s", 5),
        (9, "é ü\né ü\n퟿ 漢字 " + variant(3), "en", "s", 5),
        (10, variant(3) + " tail", "en", "s", 5),
    ]
    more = ["kept", "score", "n_words", "spans", "items", "__text", "n_removed", "llr", "component_id", "text_2"]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", *(f"'x' as `{c}`" for c in more))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
