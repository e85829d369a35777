import pytest

LONG = " ".join(f"word{i % 97} other{i % 89}" for i in range(3000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    rows = [(None, None), (1, ""), (2, LONG), (3, "Ein Satz."), (3, "Ein Satz."), (4, " \n "), (5, "123 !!"), (6, LONG)]
    return spark.createDataFrame(
        [(i, t, "en", None, 1, "r", 2.0) for i, t in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, score double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
