import pytest

#: Awkward rows: nulls, blanks, repeats of an id, ties, an id of null, and a very long text.
AWKWARD = [
    (1, "alpha beta gamma delta epsilon zeta", "s1"),
    (1, "alpha beta gamma delta epsilon zeta", "s1"),
    (2, None, "s1"),
    (3, "", None),
    (4, " \t\n ", "s2"),
    (None, "a text without an id, long enough to be read", "s2"),
    (5, "Alpha  beta\tgamma delta epsilon zeta", "s2"),
    (6, "word " * 30_000, "s3"),
    (7, "é ß 漢字 🙂   x", None),
    (8, None, None),
]


@pytest.fixture
def awkward(spark):
    """Documents with awkward rows and with extra columns whose names operators use inside."""
    rows = [(*r, k, "x", k) for k, r in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score int, digest string, size int")


@pytest.fixture
def nothing(awkward):
    return awkward.where("false")


@pytest.fixture
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0d]+", text or "")
