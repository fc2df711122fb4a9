"""Column helpers shared by the operators that stay inside DataFrame functions."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    The optimiser may inline an expression into a lambda that runs once per element; a lambda
    variable cannot be inlined, so a one-element ``transform`` is a safe binding.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is (``lower`` would also change É)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def tokens(text: Column, separators: str) -> Column:
    """The non-empty pieces of ``text`` between runs of the ``separators`` character class."""
    return F.filter(F.split(text, separators), lambda w: w != F.lit(""))


def own(name: str, taken: list[str]) -> str:
    """A column name that clashes with none of ``taken`` (compared without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
