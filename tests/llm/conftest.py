from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, size string, key int, cid string, word string"

BASE = "the cat sat on the mat while the dog ran round the old house and then went home again for its supper with a bone"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def row(i, text, lang="en", source="s0"):
    return (i, text, lang, source, len(text or ""), "x", 1, "y", 2, "z", "q")


ROWS = [
    row(1, BASE), row(2, BASE), row(2, BASE), row(3, BASE + " today"), row(4, None), row(5, ""), row(6, " \n\t "), row(7, "one"), row(8, "ONE"),
    row(9, LONG), row(10, "päivää žluťoučký кот 東京 \u0300x 'tis don't"), row(None, "null id text with some words in it"), row(None, None), row(11, BASE.upper(), None, None),
    row(12, "line one here\nline one here\nline two\n\nline one here", "de", "s1"), row(13, "a b c d e f g h " * 6, "fr", "s1"), row(14, "a <|startoftext|> b", "fr", None),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows, columns whose names clash with outputs."""
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
