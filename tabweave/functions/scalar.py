"""Scalar functions of the model language as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str | int | float | bool | None


def _c(value: Value) -> Column:
    """Columns pass, everything else is a literal."""
    return value if isinstance(value, Column) else F.lit(value)


# -- logic ---------------------------------------------------------------


def divide(numerator: Value, denominator: Value, alternative: Value = None) -> Column:
    """Division that gives ``alternative`` (NULL by default) for a zero divisor."""
    return F.when(_c(denominator) == 0, _c(alternative)).otherwise(_c(numerator) / _c(denominator))


def if_(condition: Column, then: Value, otherwise: Value = None) -> Column:
    return F.when(condition, _c(then)).otherwise(_c(otherwise))


def switch(expression: Column, *cases: Value) -> Column:
    """``switch(x, v1, r1, v2, r2, ..., [default])``."""
    pairs, default = _split_cases(cases)
    return switch_true(*[part for value, result in pairs for part in (expression == _c(value), result)], default)


def switch_true(*cases: Value) -> Column:
    """``switch_true(cond1, r1, cond2, r2, ..., [default])``."""
    pairs, default = _split_cases(cases)
    chain = F
    for condition, result in pairs:
        chain = chain.when(condition, _c(result))
    return chain.otherwise(_c(default))


def _split_cases(cases: tuple) -> tuple[list[tuple], Value]:
    default = cases[-1] if len(cases) % 2 else None
    return list(zip(cases[0 : len(cases) - 1 : 2], cases[1::2])), default


def blank() -> Column:
    return F.lit(None)


def is_blank(value: Column) -> Column:
    return value.isNull()


def if_error(value: Column, alternative: Value) -> Column:
    """``value`` has to be a ``try_`` expression, which is NULL on error."""
    return F.coalesce(value, _c(alternative))


#: Text that is a decimal number, with or without exponent.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
#: A digit, or one of the words for special numbers.
FRACTION_SCREEN = r"(?i)[0-9]|^[\x00-\x20]*[+-]?(nan|inf|infinity)[\x00-\x20]*$"
#: Texts that stand for a truth value (fixed values).
LOGICAL_TEXTS = ("t", "true", "y", "yes", "1", "f", "false", "n", "no", "0")


def safe_cast(text: Column, kind: str) -> Column:
    """``try_cast`` of text; what cannot convert at all is screened first.

    A conversion that fails raises and catches an exception for its row, which
    costs a hundred times more than a pattern match. The screen only stops text
    without any digit that is not one of the words Spark converts.
    """
    family = kind.split("(")[0].lower()
    if family == "variant":
        return F.try_parse_json(text)
    if family in ("double", "float", "decimal"):
        fits = text.rlike(FRACTION_SCREEN)
    elif family in ("tinyint", "smallint", "int", "bigint", "long", "integer") or family.startswith(("date", "timestamp")):
        fits = text.rlike("[0-9]")
    else:
        return text.try_cast(kind)
    return F.when(fits, text.try_cast(kind))


def is_number(text: Column) -> Column:
    return F.coalesce(text.rlike(NUMBER_PATTERN), F.lit(False))


def is_logical(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*LOGICAL_TEXTS), F.lit(False))


def is_text(value: Column) -> Column:
    """Text that is neither a number nor a logical value."""
    return value.isNotNull() & ~is_number(value) & ~is_logical(value)


# -- numbers -------------------------------------------------------------


def int_floor(x: Column) -> Column:
    return F.floor(x)


def mod(x: Column, n: Value) -> Column:
    """Remainder with the sign of the dividend; NULL for a zero divisor."""
    return F.when(_c(n) != 0, x % _c(n))


def _to_digits(x: Column, digits: int, whole: Callable[[Column], Column]) -> Column:
    """``x`` with its digits after the given one cut off by ``whole``, away from the sign.

    A shifted value within the last bits of a whole number is that number, as the
    digits of a double that shows 0.29 stand for 0.29. From 2**53 on all are whole.
    """
    scale, size = float(10 ** abs(digits)), F.abs(x).cast("double")
    shifted = size * scale if digits >= 0 else size / scale
    near = F.rint(shifted)
    cut = F.when(F.abs(shifted - near) <= shifted * 2.0**-51, near).otherwise(whole(shifted).cast("double"))
    back = cut / scale if digits >= 0 else cut * scale
    return F.signum(x) * F.when(shifted >= 2.0**53, size).otherwise(back)


def round_up(x: Column, digits: int) -> Column:
    """Away from zero, in the decimal digits that the number shows."""
    return _to_digits(x, digits, F.ceil)


def round_down(x: Column, digits: int) -> Column:
    """Towards zero, in the decimal digits that the number shows."""
    return _to_digits(x, digits, F.floor)


def to_units(x: Column, digits: int = 2) -> Column:
    """A fractional amount as a whole number (bigint) of units of its last digit.

    Sums of whole numbers are exact and do not depend on the order of the rows;
    one beyond 2**63 is an error. They cost less than a decimal sum.
    """
    return F.rint(x * float(10**digits)).cast("bigint")


def from_units(x: Column, digits: int = 2) -> Column:
    return x / F.lit(float(10**digits))


# -- text ----------------------------------------------------------------


def mid(text: Column, start: int, length: int) -> Column:
    return F.substring(text, start, length)


def substitute(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def concatenate(*parts: Value) -> Column:
    """NULL if any part is NULL."""
    return F.concat(*[_c(p) for p in parts])


def format_number(x: Column, pattern: str = "0.00") -> Column:
    """Fixed-point text, e.g. pattern ``0.00``; integer digits are never cut off."""
    decimals = len(pattern.partition(".")[2])
    return x.cast(f"decimal(38,{decimals})").cast("string")


def value(text: Column) -> Column:
    """Number from text, NULL where it is none."""
    return safe_cast(text, "decimal(38,10)")


def find(needle: str, text: Column) -> Column:
    """1-based position, case-sensitive; 0 when absent."""
    return F.locate(needle, text)


def search(needle: str, text: Column) -> Column:
    """1-based position without regard to case; 0 when absent."""
    return F.locate(needle.lower(), F.lower(text))


def file_name(path: Column) -> Column:
    """Last part of a path."""
    return F.split_part(path, F.lit("/"), F.lit(-1))


# -- dates ---------------------------------------------------------------


def today(as_of: str | None = None) -> Column:
    """The current date, or a fixed one so that results can be repeated."""
    return F.current_date() if as_of is None else F.lit(as_of).cast("date")


def now() -> Column:
    return F.current_timestamp()


def weekday(day: Column) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(day)


def weeknum(day: Column) -> Column:
    """ISO week."""
    return F.weekofyear(day)


def edate(day: Column, months: Value) -> Column:
    """Shifted by months, clamped to the end of the month."""
    return F.add_months(day, _c(months))


def eomonth(day: Column, months: Value = 0) -> Column:
    return F.last_day(edate(day, months))


def date(year: Value, month: Value, day: Value) -> Column:
    return F.make_date(_c(year), _c(month), _c(day))


def time(hour: Value, minute: Value, second: Value) -> Column:
    """Needs ``spark.sql.timeType.enabled``."""
    return F.make_time(_c(hour), _c(minute), _c(second).cast("decimal(16,6)"))


def datediff(unit: str, start: Column, end: Column) -> Column:
    """Unit boundaries crossed from ``start`` to ``end``."""
    unit = unit.lower()
    if unit == "day":
        return F.datediff(end, start)
    if unit == "week":
        return (F.datediff(F.date_trunc("week", end), F.date_trunc("week", start)) / 7).cast("int")
    if unit in ("hour", "minute", "second"):
        return F.timestamp_diff(unit.upper(), F.date_trunc(unit, start), F.date_trunc(unit, end))
    index = {
        "month": lambda d: F.year(d) * 12 + F.month(d),
        "quarter": lambda d: F.year(d) * 4 + F.quarter(d),
        "year": F.year,
    }[unit]
    return index(end) - index(start)
