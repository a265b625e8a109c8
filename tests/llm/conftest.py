import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, key int, node int, row int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, blanks, repeated rows, one long text, and columns with names that operators use."""
    base = "the cat sat on the mat and looked at the dog across the wide road near the old mill by the river"
    texts = [None, "", " \t\n", "one", "one two", base, base, base + " today", "x" * 5000, ("long text goes on " * 20000).strip(), "É Über straße"]
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), 0.5, "l", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [(5, base, None, None, None, None, None, None, None, None), (None, "no id here at all", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
