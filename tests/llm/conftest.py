import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty, tiny and very long texts, ties, repeated rows, clashing extra columns."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards box with jugs of liquid"
    words = base.split()
    many = [" ".join(words[(k * 7 + j * j) % len(words)] + ("x" if (k + j) % 5 == 0 else "") for j in range(30 + k)) for k in range(12)]
    rows = [
        (1, base), (2, base), (2, base), (3, base.replace(" ", "  ")), (4, None), (5, ""), (6, " \t\n"), (None, base), (None, None), (None, None),
        (7, "one"), (8, "Two Words"), (9, "é È ñ 東京 ²½ <|endoftext|> don't I'LL"), (10, "a" * 40_000), (11, base + " " + "word and " * 4_000),
        (12, "Released under the MIT License. " + base + " Released under the MIT License."), (13, "x\x1cy\x85z　w"), *((100 + k, t) for k, t in enumerate(many)), *((200 + k, many[0] + " end") for k in range(40)),
    ]
    return spark.createDataFrame([(i, t, "x", k, t) for k, (i, t) in enumerate(rows)], "doc_id long, text string, digest string, fp int, row string")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
