"""Small tables for the operators' tests."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("hash", T.StringType())])
LABELS = "doc_id long, quality int, toxic int"

ODD = [None, "", " ", "\n\n\n", "a", "ß ẞ Σς İ", "x" * 5000, "word " * 3000, "\x00 null\x0b\x85 sep", "é é 😀 漢字", "<|endoftext|> it's 'tis 're", "a\tb\rc\x0cd", "１２ ½ ٣"]


def documents(spark, texts, repeat=()):
    """Rows with the texts, numbered from 0, extra columns of clashing names, and
    the rows of the given numbers twice; one row has no doc_id."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[i] for i in repeat]
    rows.append((None, "no id", None, None, 5, None, None, None))
    return spark.createDataFrame(rows, DOCS).repartition(3)


def prose(seed: int, n: int, words: int = 60, vocabulary: int = 400) -> list[str]:
    rnd = random.Random(seed)
    names = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(vocabulary)]
    return [" ".join(rnd.choice(names) + rnd.choice(["", "", "", ",", ".\n"]) for _ in range(rnd.randint(1, words))) for _ in range(n)]


def by_id(df, *cols):
    """Sorted rows, as plain tuples."""
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
