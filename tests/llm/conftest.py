import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, fp long, spans string, told string"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with columns whose names the operators use inside."""

    def made(rows):
        full = [(i, t, lang, source, None if t is None else len(t), "x", 1, "y", "z") for i, t, lang, source in rows]
        return spark.createDataFrame(full, DOC_SCHEMA)

    return made


@pytest.fixture(scope="session")
def empty(documents):
    return documents([])
