import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text, lang, source) as a table like ``documents``."""

    def make(rows, schema=SCHEMA):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or "") if len(r) > 1 else 0) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def awkward(documents):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (None, "no id here at all", "en", "b"),
        (5, "same text of five words", "en", "a"), (5, "same text of five words", "en", "a"),
        (6, "same text of five words", "fr", None), (7, long, "en", "b"), (8, long + " tail", "en", "b"),
        (None, None, None, None), (9, "short", "de", "ü"), (10, "12 34", "de", "a"),
    ]
    extra = documents(rows)
    for name in ("id", "key", "size", "score", "kept", "rank", "n", "part", "root", "_place", "queue", "target"):
        extra = extra.withColumn(name, extra["doc_id"])
    return extra


@pytest.fixture
def write(tmp_path):
    def save(df, name="documents"):
        path = str(tmp_path / f"{name}.parquet")
        df.write.parquet(path)
        return path

    return save


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
