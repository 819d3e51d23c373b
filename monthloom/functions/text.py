"""Text helpers for file names and raw cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def strip(col: Column) -> Column:
    """Remove every kind of white space at both ends (`trim` removes blanks only)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def parse_number(col: Column) -> Column:
    """Text to DOUBLE, NULL when it is no plain number. Spark's own cast would
    also take type suffixes such as `1d`, so the text is matched first."""
    text = strip(col)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_series_value(col: Column) -> Column:
    """A raw series cell: the censored reading `<1` stands for one half."""
    text = strip(col)
    return F.when(text == "<1", F.lit(0.5)).otherwise(parse_number(text))


def decode_text(content: Column) -> Column:
    """UTF-8 when the bytes are valid UTF-8, else Latin-1; a leading BOM is dropped."""
    text = F.when(
        F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")
    ).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, r"^\x{FEFF}", "")
