import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, or from (text, lang, source); ids count from 0."""

    def make(rows):
        full = []
        for i, row in enumerate(rows):
            text, lang, source = row if isinstance(row, tuple) else (row, "en", "src0")
            full.append((i, text, lang, source, len(text or "")))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties and repeated rows."""
    long_text = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    rows = [
        (0, None, "en", "a", 0),
        (1, "", "en", "a", 0),
        (2, " \t\n ", None, None, 4),
        (3, long_text, "en", "a", len(long_text)),
        (4, "One two three four five six seven eight nine ten eleven twelve.", "en", None, 60),
        (4, "One two three four five six seven eight nine ten eleven twelve.", "en", None, 60),
        (5, "one TWO three four five six seven eight nine ten eleven twelve.", None, "b", None),
        (None, "A row without an id, of more than ten words, is still a row here.", "en", "b", 1),
        (6, "ß Ünï 中文 \U0001f600 <|endoftext|> ǅ short", "de", "b", 9),
        (7, "tiny", "fr", "c", 4),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def clashing(odd_docs):
    """The odd documents with columns named like everything the operators add or use inside."""
    from pyspark.sql import functions as F

    names = (
        "size target copies taken step whole rank source_size score predicted kept base_failed n_words shard slot law "
        "bucket c a b n g p id key row component_id n_shingles text_crc32 grown_shard symbol_ratio kept_id print "
        "p_source p_step p_copies p_print p_last p_size p_target p_below kept_vector kept_row of low grams"
    )
    return odd_docs.withColumns({n: F.lit(7) for n in names.split()})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
