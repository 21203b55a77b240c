import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


EDGES = [
    (5, None), (6, ""), (7, "   "), (8, "one"), (9, "a\n\nb\n"), (10, "same words in a row here and there"), (11, "same words in a row here and there"), (11, "same words in a row here and there"),
    (None, "no id at all but some words"), (12, "x" * 3000), (13, "mail a@b.cd +1 (234) 567-8901 4111 1111 1111 1111 10.0.0.1 end " * 40), (14, "é😀 ünï cödé " * 30),
]
