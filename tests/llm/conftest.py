from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Columns that clash with names the operators use themselves.
EXTRA = "row string, kept string, keep_id string, size string, bits string, `dotted.name` string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def prose(rng, count):
    return " ".join(rng.choice(["an", "the", "of"]) + rng.choice("bcdfg") + rng.choice(["oris", "ament", "ul"]) for _ in range(count))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, copies, near copies and repeated rows."""
    rng = random.Random(5)
    base = prose(rng, 300)
    words = base.split()
    near = " ".join([*words[:150], "changed", *words[151:]])
    far = " ".join(w if i % 4 else f"x{i}" for i, w in enumerate(words))
    texts = [
        (1, base, "en", "b"),
        (2, base.upper(), "en", "a"),
        (3, near, "en", None),
        (4, far, "de", "b"),
        (5, None, None, "c"),
        (6, "", "en", "a"),
        (7, " \t\n ", "en", "a"),
        (8, "one", "en", "Ä"),
        (9, "One two", "fr", "Ä"),
        (10, "É" * 120 + " straße\u180e end", "de", "b"),
        (11, prose(rng, 40_000), "en", "b"),
        (12, "copy of all", "en", "a"),
        (13, "copy of ALL", "en", "a"),
        (14, "lead " + base + " tail", "en", "c"),
        (15, "ab" * 400, "en", "c"),
        (16, "<|endoftext|> a  b\r\n\r\nc 12'34", "en", "c"),
    ]
    rows = [(*t, None if t[1] is None else len(t[1]), *["extra"] * 5, None) for t in texts]
    return [*rows, rows[11], rows[4], (None, "copy of all", None, None, None, *["extra"] * 5, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
