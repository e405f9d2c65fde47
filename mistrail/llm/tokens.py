"""Sizes of texts in tokens of the WordPunct rule."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rule as Java's and as Python's regular expression.
JAVA_RULE = r"(?U)\w+|[^\w\s]+"
RULE = re.compile(r"\w+|[^\w\s]+")


def token_count(text: Column) -> Column:
    """Tokens of a text; 0 for a missing one."""
    return F.coalesce(F.regexp_count(text, F.lit(JAVA_RULE)), F.lit(0)).cast("long")


@lru_cache(1)
def _classes() -> np.ndarray:
    """For each code point: 1 for a word character, 0 for white space, 2 for anything else."""
    every = "".join(map(chr, range(0x110000)))
    table = np.full(0x110000, 2, np.uint8)
    for pattern, value in ((r"\w+", 1), (r"\s+", 0)):
        for m in re.finditer(pattern, every):
            table[m.start() : m.end()] = value
    return table


def token_starts(text: str) -> np.ndarray:
    """Positions at which the tokens of ``text`` begin, as RULE would find them."""
    if not text:
        return np.zeros(0, np.int64)
    kind = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    begins = kind != 0
    begins[1:] &= kind[1:] != kind[:-1]
    return np.flatnonzero(begins)
