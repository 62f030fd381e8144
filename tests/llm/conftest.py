import pytest

SCHEMA = "doc_id long, text string, lang string, fp long, kept string, n_words int, rest string, component_id long, toxic int, rule int"


@pytest.fixture
def frame(spark):
    """A documents table of (doc_id, text) rows with extra columns whose names operators use themselves."""
    return lambda rows: spark.createDataFrame([(i, t, "en", 1, "k", 2, "r", 3, 4, 5) for i, t in rows], SCHEMA)


LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(12_000))
PASSAGE = "a passage of well over fifty bytes that several documents share, ünd so on"


@pytest.fixture
def odd(frame):
    """NULLs, empty and long texts, ties, repeated rows."""
    return frame(
        [
            (1, f"start {PASSAGE} end"),
            (2, None),
            (3, ""),
            (None, f"nobody {PASSAGE} knows"),
            (4, LONG),
            (5, f"x{PASSAGE}y"),
            (5, f"x{PASSAGE}y"),
            (6, " \t\n"),
            (7, "é" * 300),
            (8, "One two three"),
        ]
    )
