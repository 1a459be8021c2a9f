import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, size string, _id string, key string, digest string, root int"


@pytest.fixture(scope="session")
def shipped(spark):
    from cuelake.plans.shipping import ship
    ship(spark)
    return spark


@pytest.fixture
def docs(shipped):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names clash with internal ones."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None, 3, "x", None, "k", "d", 1) for r in rows]
        return shipped.createDataFrame(full, DOCS)
    return make
