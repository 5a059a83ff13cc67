import pytest

LONG = "word other\n" * 30_000
CLASH = ("size", "target", "fp", "shard", "vslot", "leaks", "secrets", "media", "n", "kind", "bad_chance", "line_ranges", "text_hash", "copies")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def rows_of(pairs):
    return [(i, t, "en", s, 7, *["x"] * len(CLASH)) for i, t, s in pairs]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, blanks, a very long text, ties, repeated rows and columns whose names operators use themselves."""
    pairs = [
        (1, "", "a"), (2, None, "a"), (3, " \n\t ", None), (None, "no id at all here", "b"), (None, "no id either", "b"), (5, LONG, "b"),
        (6, "one two three\nfour five\nsix seven", "a"), (7, "one two three\nfour five\nsix seven", "c"),
        (7, "one two three\nfour five\nsix seven", "c"), (8, "one two three\nfour five\nsix seven", None), (9, "é ü ñ password: hunter22 <x>", "c"),
    ]
    return spark.createDataFrame(rows_of(pairs), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
