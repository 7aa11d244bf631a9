import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, tag string, pos int, keep string, component string, n_words string, block int"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls anywhere, empty and long texts, ties, repeated rows and ids, columns with names that operators use."""
    prose = " ".join(f"word{i % 97} and{i % 89},".capitalize() for i in range(300))
    texts = [
        (1, prose), (2, prose), (2, prose), (3, prose + " tail"), (4, None), (5, ""), (6, "\n\n"), (7, " \t\x0b"), (8, "a b c"), (8, "a b c d"), (None, prose),
        (None, None), (9, "Line of the shared kind\nother one here"), (10, "  LINE of the SHARED kind \nown line of ten"), (11, "x" * 300_000), (12, "spam " * 20_000),
        (13, "é ß 漢字 🙂 <|endoftext|> \x1c licensed under the Apache License, Version 2.0"), (14, "Line of the shared kind\n" * 50), (15, "one two three four five six seven eight nine ten eleven twelve thirteen"),
        (16, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    ]
    rows = [(i, t, None if n % 3 else "en", None, len(t or "") if n % 2 else None, n, "t", None, "k", None, "w", 1) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
