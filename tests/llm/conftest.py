import pytest

from braidgraph.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data_dir():
    return DATA


@pytest.fixture(scope="session")
def docs(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    return [(row["doc_id"], row["text"]) for row in table.collect()]


@pytest.fixture(scope="session")
def result(spark):
    held = {}

    def of(name):
        if name not in held:
            held[name] = [row.asDict() for row in queries.QUERIES[name](spark, DATA).collect()]
        return held[name]

    return of


ODD = [
    (1, "", "x", 1.0),
    (2, None, "x", None),
    (3, "one two three", None, 2.0),
    (3, "one two three", None, 2.0),
    (None, "one two three four five six", "y", 3.0),
    (None, None, "y", 3.0),
    (4, "a b c d e f g h i j k l m n o p " * 400, "z", 0.0),
    (5, "a b c d e f g h i j k l m n o p " * 400, "z", 0.0),
    (6, "\t \n", "z", 0.0),
    (7, "a b 🙂 é token = 'abcdefgh12345' a b c d e f g h i j k l m n o p a b c d", "z", 0.0),
]
ODD_SCHEMA = "doc_id long, text string, size string, n_shingles double"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
