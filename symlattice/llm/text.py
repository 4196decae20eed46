"""Column expressions on texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: space and the controls from tab to carriage return.
BLANKS = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The runs of characters that are no blanks, in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def uniform(seed: int, *cols: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the seed and the columns alone (53 bits of their XXH64)."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / F.lit(float(2**53))


def unused(prefix: str, taken: list[str]) -> str:
    """A column name that df does not have, whatever extra columns it carries."""
    low, name = {c.lower() for c in taken}, prefix
    while name.lower() in low:
        name = "_" + name
    return name
