import pytest


@pytest.fixture()
def odd_documents(spark):
    """Nulls, empties, repeats, long texts, and columns with clashing names."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(20_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog today", "en", "a", 10, "x"),
        (1, "The quick brown fox jumps over the lazy dog today", "en", "a", 10, "x"),
        (2, "the QUICK brown fox jumps over the lazy dog today", "en", "b", 10, None),
        (3, None, None, None, None, None),
        (4, "", "en", "a", 0, "x"),
        (5, " \t\n\x0b\f\r ", "en", None, 7, "x"),
        (6, "one two", "en", "c", 7, "x"),
        (7, "ONE two", "en", "c", 7, "x"),
        (8, long, "en", "a", len(long), "x"),
        (9, long + " tail", "en", "b", len(long), "x"),
        (10, "日本語 テスト\u00a0\u3000x  y\n\nz  ", "ja", "é", 9, "x"),
        (None, "a text without an id", "en", "a", 3, "x"),
        (11, "a" * 5_000 + " " + "b" * 300, "en", "a", 3, "x"),
        (12, "x\n \n y   z \u200b<|endoftext|> 'll I'd", "en", "a", 3, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")


@pytest.fixture()
def no_documents(spark, odd_documents):
    return odd_documents.limit(0)
