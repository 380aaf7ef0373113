import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table from (id, text) pairs, with an extra column whose name operators use themselves."""

    def make(rows, lang="en"):
        return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0) for i, t in rows], DOCS + ", lang_pred int")

    return make


LONG = " ".join(f"word{i} of{i % 7}" for i in range(30_000))
EDGE = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, LONG), (6, "Repeated row here"), (6, "Repeated row here"), (None, "no id at all"), (7, "… — ¡ 123 !")]
