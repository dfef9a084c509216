"""Fixtures for the training-data operators: a small table with every odd case."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did long, key string, bin long, size string, `range` int"


def words(rng, n, letters="abcdefgé"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(n))


def odd_rows():
    """(doc_id, text): nulls, empty and very long texts, ties, repeats, copies, shared passages."""
    rng = random.Random(11)
    shared = words(rng, 60)
    rows = [(0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "a b c"), (5, "x" * 3000), (6, words(rng, 9000))]
    for i in range(10, 60):
        text = words(rng, rng.choice([4, 12, 40, 120]))
        if rng.random() < 0.4:
            text += " " + shared + " " + words(rng, 5)
        rows.append((i, text))
    for i in range(60, 75):  # near copies
        parts = rows[12 + i % 4][1].split(" ")
        if len(parts) > 3:
            parts[rng.randrange(len(parts))] = "changed"
        rows.append((i, " ".join(parts)))
    rows += [(100 + i, rows[20][1]) for i in range(12)]  # exact copies
    rows += [rows[15], rows[15]]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The rows with clashing extra columns, over several partitions."""
    full = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), 1, "k", None, "s", 2)
            for i, t in odd_rows()]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
