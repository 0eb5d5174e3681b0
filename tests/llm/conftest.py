import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
TEXTS = {
    1: "alpha beta gamma delta epsilon zeta eta theta iota kappa",
    2: None,
    3: "",
    4: "  \n\n \t ",
    5: LONG,
    6: "alpha beta gamma delta epsilon zeta eta theta iota kappa",
    7: "naïve Σίσυφος \U0001f600 字字 <|endoftext|> it's 12 . .\n\n  x",
    8: "one line of text here\n" * 30,
}


@pytest.fixture
def odd_docs(spark):
    """Null, empty, blank, very long, equal and repeated rows, and extra columns with clashing names."""
    rows = [(k, t, "en", None, "x", 1, k) for k, t in TEXTS.items()] + [(8, TEXTS[8], None, "s", "y", None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, name string, n_words int, start long").repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
