import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs_of(spark):
    """Documents from texts (ids 0, 1, ...) or from (id, text) pairs."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(
            [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], COLUMNS
        )

    return make


ODD_TEXTS = [
    None, "", " \n\t ", "a", "a a a a a a", "ÀÉ ß\nÀÉ ß\n\nx", "a\x0bb\x0cc\x1cd e f",
    "the cat sat on the mat and the cat sat on the mat\n" * 40, "x" * 300_000, "w " * 100_000,
    "\U0001f600 emoji \U0001f600\r\nline", "| a | b |\n| a | b |\n#*$%&|<>", "the cat sat", "the cat sat",
]
