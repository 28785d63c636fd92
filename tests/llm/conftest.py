import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, k string, runs int, score double"


@pytest.fixture
def documents(spark):
    """Documents with extra columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src", len(t or ""), "x", 1, 0.5) for i, t in rows], DOC)

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows, several scripts."""
    words = " ".join(f"word{i % 97} tail{i % 13}," for i in range(6000))
    base = " ".join(f"alpha{i} beta{i}" for i in range(60))
    return [
        (0, base),
        (1, base + " and more"),
        (2, base),
        (3, None),
        (4, ""),
        (5, "   \n\t "),
        (6, words),
        (7, "x" * 3000),
        (8, "Straße İstanbul 😀 naïve gap wide don't we'll 123 ab12!\n\n  end "),
        (9, "one two three"),
        (9, "one two three"),
        (9, "another text under the same id"),
        (None, base),
        (10, "日本語のテキスト です。" * 40),
        (11, "word" + " " * 500 + "gap"),
    ]
