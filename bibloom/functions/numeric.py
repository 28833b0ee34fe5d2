"""Numbers in extracted cells and quotes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# A cell that is one number, and a number in text.
NUMERIC_CELL = r"^[<>~=\s]*[-+]?\d+([.,]\d+)?(\s*[eE][-+]?\d+)?[\s%]*$"
NUMBER = r"[-+]?\d+(?:[.,]\d+)?(?:\s*[eE][-+]?\d+)?"


def is_numeric(c: Column) -> Column:
    return F.coalesce(c.rlike(NUMERIC_CELL), F.lit(False))


def numeric_value(c: Column) -> Column:
    """The number a cell states, a comma being a decimal point; null if it states none."""
    found = F.translate(F.regexp_extract(c, f"({NUMBER})", 1), ", ", ".")
    return F.when(is_numeric(c), found.try_cast("double"))


def quote_supports(value: Column, quote: Column) -> Column:
    """Whether a number of the value, without trailing zeros, is part of a number of the quote or holds one."""
    numbers = lambda c: F.transform(F.regexp_extract_all(F.replace(c, F.lit(","), F.lit(".")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda d: F.regexp_replace(F.regexp_replace(d, "0+$", ""), r"\.$", ""))
    mine = F.filter(numbers(value), lambda d: d != "")
    theirs = F.filter(numbers(quote), lambda d: d != "")
    meets = F.exists(mine, lambda d: F.exists(theirs, lambda q: F.contains(q, d) | F.contains(d, q)))
    return F.when(is_numeric(value), meets).otherwise(F.lit(True))


@F.pandas_udf(DoubleType())
def one_digit(s: pd.Series) -> pd.Series:
    """Doubles rounded as they are, halves to even; the built-in functions round their decimal spelling."""
    return s.map(lambda x: round(x, 1))
