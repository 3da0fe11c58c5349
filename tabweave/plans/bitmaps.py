"""Distinct counts as bitmaps of dictionary codes, which can be stored and merged.

A dictionary gives every value a whole number without gaps. A set of values is
then a few bitmaps, one per bucket of 32,768 codes; sets are merged by OR within
a bucket, and a count adds the bits. A bitmap row has at most 4 kB, and a set that
holds most values spreads over the buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.operators.joins import anti_join, equi_join
from tabweave.operators.positions import number_rows

#: Columns of partial results that hold sets: name of the set, bucket and bits.
SET, BUCKET, BITMAP = "__set", "__bucket", "__bitmap"


def dictionary(df: DataFrame, value: Column | str) -> DataFrame:
    """``value`` and ``code`` from 1 of the distinct values; to be stored, as codes must not change."""
    return number_rows(_values(df, value), ["value"], out="code")


def extended(known: DataFrame, df: DataFrame, value: Column | str) -> DataFrame:
    """The rows to append to a stored dictionary: values that it lacks, with the codes after its largest."""
    first = known.agg(F.coalesce(F.max("code"), F.lit(0)) + 1).scalar()
    return number_rows(anti_join(_values(df, value), known, "value"), ["value"], out="code", start=first)


def _values(df: DataFrame, value: Column | str) -> DataFrame:
    return df.select((F.col(value) if isinstance(value, str) else value).alias("value")).where("value IS NOT NULL").distinct()


def bitmap_rows(df: DataFrame, by: Sequence[str], name: str, value: Column, codes: DataFrame) -> DataFrame:
    """The set of values of each group, one row per bucket. A value without code is an error.

    Values are made distinct within their group before they meet the dictionary,
    so a value that most rows hold is joined once per group.
    """
    pairs = df.select(*by, value.alias("__value")).where("__value IS NOT NULL").distinct()
    coded = equi_join(pairs, codes.select("value", "code"), {"__value": "value"}, "left")
    code = F.coalesce("code", F.raise_error(F.lit(f"{name}: a value is not in the dictionary")).cast("long"))
    placed = coded.withColumn("__code", code).withColumn(BUCKET, F.bitmap_bucket_number("__code"))
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("__code")).alias(BITMAP)
    return placed.groupBy(*by, BUCKET).agg(bits).withColumn(SET, F.lit(name))
