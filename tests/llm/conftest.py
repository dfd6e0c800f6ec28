import pytest

BASE = "the quick brown fox jumps over the lazy dog while many small birds sing in the old green trees near a quiet river bank".split()


def prose(seed, n):
    """n words that no other seed gives in the same order."""
    return " ".join(BASE[(i * i * (seed + 3) + seed * 7 + i) % len(BASE)] + ("" if (i + seed) % 3 else str((seed * 131 + i * 17) % 97)) for i in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and blank texts, one word, a very long text, copies, near copies, repeated rows and extra columns with clashing names."""
    long = " ".join(f"w{i % 9973}x{i % 89}" for i in range(120_000))
    a, b = prose(1, 120), prose(2, 80)
    words = a.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, long), (7, a), (8, a + " "), (9, near), (10, near), (11, b), (11, b),
        (12, b.upper()), (None, b), (None, None), (13, "Ünïcödé 日本語 text — ok 😀́"), (14, "a" * 5000), (15, prose(3, 40) + "\n" + prose(4, 30)), (16, prose(5, 20) + "\n" + prose(4, 30)),
        (17, "x y z"), (18, "X  y\nz"), (19, "<|endoftext|> hello <|endoftext|>"), (20, "12345 !!! ###"),
    ]
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, 0, "e", 1.0, "n") for i, t in rows], "doc_id long, text string, lang string, n int, node string, keep_id double, digest string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
