"""Small document tables with every odd case at once, as fixtures to import."""
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, h long, node long, _row_file string, copies int, k string, `a b` int"
PASSAGE = "over the long river and through the old town they walked until the lamps were lit and nobody spoke a word of what had been said before supper"


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, and further columns whose names the operators use inside."""
    more = ("x", 1, 2, "y", 3, "z", 4)
    texts = [
        (1, "the quick brown fox jumps over the lazy dog and runs away from it"),
        (2, "the quick brown fox jumps over the lazy dog and runs away from it"),
        (2, "the quick brown fox jumps over the lazy dog and runs away from it"),
        (3, ""), (4, None), (5, ""), (None, "a text without a key that says little"), (None, None),
        (6, "###  $$$ 123"), (7, "été ß 日本語 ▁▁ <s> x"), (8, PASSAGE), (9, "first " + PASSAGE + " last"),
        (10, " ".join(f"word{i} it{i % 7}" for i in range(9000))), (11, "ab" * 400), (12, "x" * 70000),
        (13, PASSAGE.upper()), (-5, "short"), (2**60, "short"),
    ]
    sources = ["s1", "s2", None, "s1", "s1", "S", "s1"]
    return [(d, t, [None, "en", "fr"][i % 3], sources[i % 7], None if i % 2 else len(t or ""), *more) for i, (d, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def given(spark):
    """The smallest given documents as (doc_id, text)."""
    return [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
