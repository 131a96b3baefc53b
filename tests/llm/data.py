"""Small documents with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns under names that operators use inside.
CLASHES = ["size", "keep", "_keep", "_id", "_h", "_hid", "chunk", "part", "text_key", "component_id", "finish", "copies", "score", "position", "key", "bucket", "id", "word", "target", "n_entities", "embedding_"]


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text or ""))


def rows() -> list[tuple]:
    base = "The Quick brown fox jumps over the lazy dog and runs far away from every noisy hunter near the river bank today"
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    out = [
        (1, base, "en", "a", 10), (2, base, "en", "a", 10), (3, base + " indeed", "en", None, 10), (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \t\n", "en", "b", 3),
        (7, "one two", "en", "b", 7), (8, "ONE\ttwo", "en", "c", 7), (9, long, "en", "c", len(long)), (10, "Été éclaté\nfoo\nÉté éclaté\n\nbar", "fr", "c", 30), (11, "line x\n" * 40, "en", "a", 1),
        (12, "mail me: jo.doe@example.com or 10.1.2.3, call +1 (212) 555-0199", "en", "a", 1), (13, "x" * 250 + base * 2, "en", "a", 1), (14, base * 2 + "y" * 250, "en", "d", 1), (15, "\u0000odd \U0001f600 <|endoftext|> text", "en", "d", 1),
    ]
    out += [(100 + i, f"shared license line\nown words {i} alpha beta gamma {i * 7} delta\n  SHARED License line  ", "en", f"s{i % 4}", 1) for i in range(12)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, data=None):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES))


def with_odd_rows(data):
    """Repeated rows and rows without id besides."""
    return [*data, data[0], data[0], (None, data[0][1], "en", "a", 1), (None, None, None, None, None)]
