import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table of (doc_id, text, lang, source) rows."""

    def build(rows):
        full = [(*r, *[None] * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(a, b, c, d, len(b) if b is not None else None) for a, b, c, d in full], SCHEMA)

    return build


@pytest.fixture(scope="session")
def by_id():
    def collect(df):
        return {r["doc_id"]: r.asDict() for r in df.collect()}

    return collect
