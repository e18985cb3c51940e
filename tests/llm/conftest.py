import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts or (id, text, lang, source)."""

    def made(rows):
        full = [(k, r, "en", "s") if r is None or isinstance(r, str) else r for k, r in enumerate(rows)]
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], SCHEMA)

    return made


@pytest.fixture(scope="session")
def clash():
    """Columns whose names operators use themselves."""

    def added(df):
        from pyspark.sql import functions as F

        names = ("fp", "norm", "id", "n", "kept", "key", "size", "score", "lang_pred", "word", "copies", "path_", "payload", "held_out", "a", "b", "label")
        return df.select("*", *[F.lit(1).alias(n) for n in names])

    return added
