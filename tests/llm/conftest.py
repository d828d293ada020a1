import pytest

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents frame from (doc_id, text) pairs, with columns that clash with the operators' own names."""

    def make(rows, **extra):
        full = [(i, t, "en", "s", len(t) if t is not None else None, "mine", 7.0, "k") for i, t in rows]
        return spark.createDataFrame(
            full,
            "doc_id long, text string, lang string, source string, n_chars long, class_id string, score double, key string",
        )

    return make
