"""Severity from names and numbers."""

from __future__ import annotations

from collections.abc import Mapping
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from lograft.tables import LEVEL_NAMES, LEVEL_NUMBERS, LEVEL_UPPER_BOUNDS


def level_from_name(name: Column, custom: Mapping[str, str] | None = None) -> Column:
    """Severity number of a level name in any case, custom names first; unknown gives null."""
    chain = F
    for alias, level in (custom or {}).items():
        chain = chain.when(F.lower(name) == alias, F.lit(LEVEL_NUMBERS[level]))
    # The built-in names are ASCII: plain letter mapping is enough, and quicker than lower().
    lowered = F.translate(name, ascii_uppercase, ascii_lowercase)
    for level, names in LEVEL_NAMES.items():
        chain = chain.when(lowered.isin(list(names)), F.lit(LEVEL_NUMBERS[level]))
    return chain


def level_from_number(number: Column) -> Column:
    """Severity number of a numeric level; the bounds do the cutting of fractions."""
    chain = F
    for level, bound in LEVEL_UPPER_BOUNDS:
        chain = chain.when(number < bound, F.lit(LEVEL_NUMBERS[level]))
    return chain.when(number.isNotNull(), F.lit(LEVEL_NUMBERS["fatal"]))


def level_name(number: Column) -> Column:
    chain = F
    for level, value in LEVEL_NUMBERS.items():
        chain = chain.when(number == value, F.lit(level))
    return chain
