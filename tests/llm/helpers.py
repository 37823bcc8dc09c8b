"""Small document tables for the corpus operators' tests."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, pairs):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


def odd_pairs():
    """Nulls, empty and long texts, repeated rows, ties."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    return [
        (1, None),
        (2, ""),
        (3, "  \n\t "),
        (4, "one"),
        (5, "Hello, world! It's 2024 — naïve café <|endoftext|> tail"),
        (5, "Hello, world! It's 2024 — naïve café <|endoftext|> tail"),
        (None, "no id here"),
        (6, long),
        (7, long),
        (8, "日本語のテキスト \x1f mixed \x85 spaces and é combining"),
    ]
