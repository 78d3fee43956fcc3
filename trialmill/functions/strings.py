"""Names, codes and numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .conditional import case_when

# First letter of a subject code and its paradigm.
PARADIGMS = {"a": "Dot Probe", "b": "Dual Probe"}


def file_code(path: Column, separator: str = "/", extension: str = ".") -> Column:
    """Text between the last separator and the last extension mark; either may be absent."""
    start = F.length(path) - F.length(F.substring_index(path, separator, -1)) + 1
    back = F.instr(F.reverse(path), extension[::-1])
    mark = F.length(path) - back + 2 - len(extension)
    stop = F.when((back > 0) & (mark > 1), mark - 1).otherwise(F.length(path))
    return F.substring(path, start, F.greatest(stop - start + 1, F.lit(0)))


def paradigm_of(subject: Column) -> Column:
    """Paradigm named by the first letter of the subject code."""
    return case_when(*[(subject.startswith(letter), F.lit(name)) for letter, name in PARADIGMS.items()])


def digits(text: Column) -> Column:
    """The number left when all other characters are dropped."""
    return F.regexp_replace(text, r"\D", "").try_cast("int")


def pad_number(number: Column, width: int = 2) -> Column:
    """Leading zeros up to the width; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def decimal_comma(text: Column) -> Column:
    """Read `12,5` as 12.5; anything that is no number becomes NULL."""
    return F.regexp_replace(text, ",", ".").try_cast("double")


def to_decimal_comma(number: Column) -> Column:
    """Write 12.5 as `12,5`."""
    return F.regexp_replace(number.cast("string"), r"\.", ",")
