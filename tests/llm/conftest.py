import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, block int, fp string, task int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang, source]), with extra columns whose names clash with those that operators add."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or ""), "x", 1, "y", 2) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    return [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (None, "no key here"), (4, " \t\n"), (5, long), (6, "ein ganz kurzer Satz. Und noch einer!"), (7, "a b c d e f")]
