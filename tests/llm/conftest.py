import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, kept int, ids string, n_words string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, and extra columns with clashing names."""
    line = "the quick brown fox jumps over the lazy dog again and again near the old river bank today"
    texts = [
        None, "", "   \n\t \n", "one", "A b\tC d", line, line, line.upper(), "w" * 70_000, "ab " * 30_000, "x\n\nx\n \nx", "é ü ñ   #*$ %&|<> \x1c\x85",
        "\n".join([line] * 6), "\n".join(f"line {i} of this text is unlike all other lines" for i in range(40)), "don't <|endoftext|> 'S 123 １２ 漢字\r\n\x0b\x0c end", "\x00 nul \x00\x00",
    ]
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, None, "h", 1, "i", "w") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id " * 30, None, None, 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
