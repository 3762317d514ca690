"""Small tables of odd rows: the fixtures that the tests of this folder import."""
import pytest

PASSAGE = ("the quick survey of northern rivers shows that every second bridge was rebuilt after the long winter flood "
           "and that none of the older mills along the upper valley kept its wheel or its weir in working order today "
           "although several families still own the ground and plan to restore at least two of them before next spring")
WORDS = [f"w{i}ord" for i in range(400)]


def _text(start, n):
    return " ".join(WORDS[(start * 37 + i * (start + 3)) % len(WORDS)] for i in range(n))


EDGE_TEXTS = [
    None, "", " \n\t ", "one", "two words", "a b c d e", _text(1, 80), _text(1, 80), _text(2, 90) + " " + PASSAGE,
    _text(3, 60) + "\n" + PASSAGE + "\n" + _text(4, 50), PASSAGE, PASSAGE + " tail", "é" * 150, "é" * 300, "x" * 1000,
    _text(5, 6000), _text(5, 6000) + " extra", "same line here\n" * 40, "## $$ %% " * 60, "日本 テキスト " * 30,
    _text(6, 100).upper(), _text(6, 100), "\x00 \x0b odd \x7f", _text(7, 12) + " " + PASSAGE[:210],
]


@pytest.fixture(scope="session")
def edge_rows():
    return list(enumerate(EDGE_TEXTS))


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """Nulls, empty, short, long, tied and repeated texts; extra columns named like internal ones."""
    rows = [(i, t, "x", i, 1.0, "s") for i, t in edge_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, value string, row long, n double, kept string").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
