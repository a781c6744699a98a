import random

import pytest

LONG = " ".join(f"word{i % 977}" for i in range(40_000))


@pytest.fixture(scope="session")
def make(spark):
    """documents of (doc_id, text) with other columns, some with names that operators use inside."""

    def of(rows, partitions=3):
        full = [(i, t, "en", "s", None, i, "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, node long, fp string").repartition(partitions)

    return of


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, a very long one, equal and repeated rows, special strings, odd white space."""
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, LONG),
        (5, "Hello, world! It's 2024.\nNext line <|endoftext|> tail"),
        (6, "Hello, world! It's 2024.\nNext line <|endoftext|> tail"),
        (6, "Hello, world! It's 2024.\nNext line <|endoftext|> tail"),
        (None, "no identifier here at all"),
        (None, None),
        (7, "Žluťoučký kůň  pěl ďábelské ódy 😀 éa × b÷c"),
        (8, "x" * 5000),
        (-9, "negative identifier, négatif été à l'œuvre"),
        (10, "tabs\tand\r\nreturns   and   spaces "),
    ]


@pytest.fixture(scope="session")
def prose():
    """Invented words, much repeated."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice(["an", "ti", "or", "he", "st", "ble"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def text(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) for _ in range(n))

    return text
