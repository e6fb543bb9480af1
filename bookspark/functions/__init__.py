"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip and re see it, for a Java pattern.
SPACE = r"[\s\x1c-\x1f]"


def py_strip(c: Column) -> Column:
    """Trim Unicode white space and separators at both ends."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def py_words(c: Column, pieces: int = -1) -> Column:
    """Words between runs of Unicode white space; none for an empty or null text. With `pieces` the first pieces - 2 are words, and the rest may be uncut."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), rf"(?U){SPACE}+", pieces), lambda w: w != "")


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm_title(c: Column) -> Column:
    """A heading for comparison: trimmed, without a number or letter prefix, lower case."""
    # Fixed value: the pattern of a heading's prefix.
    return F.lower(F.regexp_replace(py_strip(c), r"(?U)\A((\d+\.)+|\w+\.)\s*", ""))


def stable_id(*columns: Column) -> Column:
    """A key that a repeated task gives again."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def joined(text: Column, order: Column, gap: str) -> Column:
    """Aggregate: texts in their order with a gap between; nulls are left out."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), gap)
