import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    def make(rows, schema=DOCUMENTS):
        full = [(i, t, "en", "s", len(t or "")) if schema == DOCUMENTS else (i, t) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def hard():
    """Nulls, empties, white space, repeated rows, ties, case, non-ASCII, control characters, long texts and words."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from here to there " * 3
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    return [
        (0, None), (1, ""), (2, "   \n\t "), (3, base), (4, base.upper()), (5, base + "indeed"), (6, base.replace("lazy", "idle", 1)), (7, "one"), (8, "one two three four"), (9, "ONE two three four"),
        (10, "Äpfel É ẞ İstanbul ΣΑΣ H̱ x"), (11, "äpfel é ß i̇stanbul σας ẖ x"), (12, "a\x00b\x1fc a\x0bd"), (13, long), (14, long + " tail"), (15, "x" * 3_000_000), (16, "<|endoftext|> <|ENDOFTEXT|>, it's 12.5, a."),
        (17, base), (18, "é, à. “quoted,” 'S don't 'll"), (19, long.replace("w5x5", "w6x6")),
    ]
