import pytest

ODD = [
    (1, "the cat sat on the mat. " * 40, "en"),
    (2, None, None),
    (3, "", "x"),
    (4, "naïve <|endoftext|>  two  spaces\n\n 日本語 it's we'll", "fr"),
    (5, "a" * 5000, "en"),
    (5, "a" * 5000, "en"),
    (None, "no id here", "en"),
    (7, "word " * 9000, "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash."""
    rows = [(i, t, lang, 0.5, 9, 9, *"abcdefgh") for i, t, lang in ODD]
    clash = ", ".join(f"{c} string" for c in ("spans", "_base", "_more", "_spans", "_fp", "_H", "_id", "family"))
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, score double, n_tokens long, start long, {clash}").repartition(3)


@pytest.fixture(scope="session")
def odd_rows():
    return ODD
