"""Column expressions on numbers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from guichet import vocabulary as V
from guichet.functions.text import map_columns

# What counts as a number in text. Spark's own cast also takes "1d" and "1f".
_NUMBER = r"(?i)^[+-]?(?:\d+\.?\d*|\.\d+|inf|infinity)(?:e[+-]?\d+)?$"


def to_number(c: Column) -> Column:
    """A lenient double: text that is not a number is null, and so is NaN."""
    return F.regexp_extract(F.trim(c.cast("string")), _NUMBER, 0).try_cast("double")


def parse_fr_decimal(c: Column) -> Column:
    """``1 234,5`` is 1234.5; only the plain blank separates thousands."""
    plain = F.replace(c.cast("string"), F.lit(","), F.lit("."))
    return to_number(F.replace(plain, F.lit(" "), F.lit("")))


def parse_amounts(df: DataFrame, units: Sequence[str] = tuple(V.AMOUNT_UNITS)) -> DataFrame:
    amounts = [c for c in df.columns if any(unit in c for unit in units)]
    return map_columns(df, amounts, parse_fr_decimal)


def require_int(c: Column, name: str = "value") -> Column:
    """An int; a null or unreadable value fails the job."""
    number = to_number(c)
    return F.when(
        number.isNull(), F.raise_error(F.lit(f"{name}: not an integer")).cast("int")
    ).otherwise(number.cast("int"))


def coerce_int(c: Column) -> Column:
    """An int, or null where the text is not a number; fractions are cut off."""
    return to_number(c).try_cast("int")


def binarize(c: Column) -> Column:
    """1 where the value is above zero, else 0 (also for null and text)."""
    return (F.coalesce(to_number(c), F.lit(0.0)) > 0).cast("int")


def binarize_markers(df: DataFrame, names: Iterable[str] = tuple(V.MARKERS)) -> DataFrame:
    return map_columns(df, names, binarize)


def marker_as_category(df: DataFrame, names: Iterable[str] = tuple(V.CATEGORY_MARKERS)) -> DataFrame:
    """Numeric markers as text categories; a null becomes the text ``nan``."""
    return map_columns(df, names, lambda c: F.coalesce(c.cast("string"), F.lit("nan")))


def grant_ratio(grant: Column, committed: Column) -> Column:
    """Grant share of the commitment in [0, 1]; null without a positive commitment."""
    num, den = finite(grant), finite(committed)
    share = F.greatest(F.least(num / den, F.lit(1.0)), F.lit(0.0))
    return F.when((den > 0) & num.isNotNull(), share)


def log_amount(c: Column) -> Column:
    return F.log1p(c)


def invert_log(c: Column) -> Column:
    return F.expm1(c)


def prediction_range(c: Column, rmse: float) -> Column:
    """Amounts one RMSE below and above a log prediction."""
    return F.struct(F.expm1(c - rmse).alias("low"), F.expm1(c + rmse).alias("high"))


def amount_band(
    c: Column,
    bounds: Sequence[float] = tuple(V.BAND_BOUNDS),
    labels: Sequence[str] = tuple(V.BAND_LABELS),
) -> Column:
    """The first band whose upper bound is not below the value."""
    band = F.lit(labels[-1])
    for bound, label in reversed(list(zip(bounds, labels))):
        band = F.when(c <= bound, label).otherwise(band)
    return F.when(c.isNotNull(), band)


def amount_label(c: Column) -> Column:
    """``950 K EUR`` below a thousand, ``1,234.5 M EUR`` from there on."""
    return F.when(c < 1000, F.concat(F.format_number(c, 0), F.lit(" K EUR"))).otherwise(
        F.concat(F.format_number(c / 1000, 1), F.lit(" M EUR"))
    )


def format_number_fr(c: Column) -> Column:
    """``1 234 567,89``; whole numbers carry no decimals."""
    number = c.cast("double")
    whole = F.translate(F.format_number(number, 0), ",", " ")
    return F.when(number == F.floor(number), whole).otherwise(
        F.translate(F.format_number(number, 2), ",.", " ,")
    )


def round_half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def to_millions(c: Column) -> Column:
    return c / 1000


def keur_to_eur(c: Column) -> Column:
    return c * 1000


# A double is cut into whole numbers of DIGIT bits, one for each of these places. A sum of 2**39
# of them fits in a long; Spark refuses a sum that does not.
DIGIT = 24
PLACES = range(-6, 6)


def _digits(number: Column) -> tuple[list[Column], Column]:
    """The digits of a double, lowest first, and what they leave out.

    The digit of place j counts 2 ** (DIGIT * j). Scaling by powers of two, ``rint`` and the
    differences here are exact, so the digits and the rest add up to the number, bit by bit. Numbers
    too large for the highest place are left out as a whole, of tiny ones the last bits.
    """
    fits = F.abs(number) < 2.0 ** (DIGIT * PLACES[-1] + DIGIT - 2)
    shifted = {j: F.rint(number * 2.0 ** (-DIGIT * j)) for j in (*PLACES, PLACES[-1] + 1)}
    digits = [F.when(fits, (shifted[j] - shifted[j + 1] * 2.0**DIGIT).cast("long")) for j in PLACES]
    low = PLACES[0]
    return digits, F.when(fits, number - shifted[low] * 2.0 ** (DIGIT * low)).otherwise(number)


def exact_sum(c: Column, scale: int | None = None) -> Column:
    """The sum of a measure; nothing sums to 0 and NaN counts as missing.

    The sum does not depend on the order of rows and partitions: digits of equal places are
    added as whole numbers, and only their sums become a double again, from the lowest place
    up. That holds for numbers between 1e-27 and 1e42 in size, and 0. Bits below 2 ** -144 and numbers
    beyond, infinities too, are added as doubles. A caller that knows the number of decimals of an
    amount can name it in ``scale``: then amounts are added as decimals.
    """
    number = finite(c)
    if scale is None:
        digits, rest = _digits(number)
        out = F.coalesce(F.sum(rest), F.lit(0.0))
        for place, digit in zip(PLACES, digits):
            out = out + F.coalesce(F.sum(digit), F.lit(0)).cast("double") * 2.0 ** (DIGIT * place)
        return out
    amount = number.try_cast(f"decimal(28,{scale})")
    rest = F.sum(F.when(amount.isNull(), number))
    return F.coalesce(F.sum(amount).cast("double"), F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))


def exact_mean(c: Column, scale: int | None = None) -> Column:
    """Mean of the non-null values, null if there are none."""
    return exact_sum(c, scale) / F.nullif(F.count(finite(c)), F.lit(0))


def finite(c: Column) -> Column:
    """Null in place of NaN."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


