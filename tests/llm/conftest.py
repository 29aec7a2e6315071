"""A small documents table with the awkward cases, and one with none."""

from __future__ import annotations

import random

import pytest

SYLLABLES = "th er an in re on at ti es or le ou en ch ai ung de la ment".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, votes int, n_tokens int, g int, fingerprint string, _key int, _mix_x int, _quality_votes int"


def row(doc_id, text, lang="en", source="src0"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 1, 2, 3, "y", 4, 5, 6)


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, shared ids, extra columns whose names the operators use."""
    rng = random.Random(11)
    long, shared = prose(rng, 30_000), prose(rng, 60)
    rows = [row(i, prose(rng, rng.randrange(1, 90))) for i in range(30)]
    rows += [row(30, None), row(31, ""), row(32, " \n\t "), row(None, prose(rng, 80)), row(None, None), row(None, prose(rng, 70)), row(33, long), row(34, long)]
    rows += [row(35 + i, shared, None, None) for i in range(4)]
    rows += [rows[3], rows[3], row(3, shared), row(40, prose(rng, 40) + " " + shared + " " + prose(rng, 40)), row(41, "a" * 400), row(42, "x y " * 200)]
    rows += [row(43, 'password = "hunter22ab" ghp_' + "a1" * 20 + " AKIA" + "B" * 16), row(44, "Licensed under the Apache License, Version 2.0 and MIT license; cc by"), row(45, "naïve ΑΣ ſK İ 日本 \x1c\x85 <|endoftext|> don't")]
    rows += [(None,) * 13]
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
