import pyarrow.parquet as pq
import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for columns of their own.
CLASHING = ["n_words", "size", "taken", "kept", "h", "uid", "row_", "key", "line", "spans", "h_", "own_id", "own_row", "times", "copy", "flags", "kept_text", "item_id", "column_0"]


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def raw_docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with a column of every clashing name."""

    def build(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", 0) for r in rows]
        return spark.createDataFrame(full, DOCS).selectExpr("*", *[f"'x' AS {c}" for c in CLASHING])

    return build


@pytest.fixture
def odd(make):
    """Null ids and texts, empty and blank texts, repeated rows, equal ids with different texts, a long text."""
    long = " ".join(f"word{i}" for i in range(60_000))
    return make(
        [
            (None, None, None), (None, "some words that stand under no id at all but are here", None), (1, "", "a"), (1, "", "a"), (2, None, "a"),
            (3, " \t\n\x0b\x0c\r ", "b"), (4, "one two three four five six seven eight nine ten eleven", "b"),
            (4, "one two three four five six seven eight nine ten eleven", "b"), (4, "quite another text under the same id as before, you see", "b"),
            (5, long, "c"), (6, "x", None), (7, "é" * 300 + "\n" + "ü ß", "c"),
        ]
    )
