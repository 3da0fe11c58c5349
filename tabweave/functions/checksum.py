"""Digit checksum and CASE functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checksum_valid(text: Column) -> Column:
    """True when the weighted digit sum of ``text`` is a multiple of ten.

    Only digits count. Every second digit from the left is doubled, less nine
    when that exceeds nine. Text without digits is not valid.
    """
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")

    def weigh(digit: Column, position: Column) -> Column:
        number = digit.cast("int")
        doubled = number * 2
        return F.when(position % 2 == 0, number).when(doubled > 9, doubled - 9).otherwise(doubled)

    weighed = F.transform(F.split(digits, ""), weigh)
    total = F.aggregate(weighed, F.lit(0), lambda acc, x: acc + x)
    return F.when(F.length(digits) == 0, F.lit(False)).otherwise(total % 10 == 0)


def register_case_function(spark, name: str, body: str, argument: str = "x STRING", returns: str = "STRING") -> None:
    """Register a CASE expression as a temporary SQL function."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument}) RETURNS {returns} RETURN {body}")
