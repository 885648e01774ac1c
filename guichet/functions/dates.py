"""Column expressions on dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from guichet import vocabulary as V
from guichet.functions.text import quoted


def parse_date(c: Column, formats: Sequence[str] = tuple(V.DAY_FIRST_FORMATS)) -> Column:
    """The first format that fits, else null."""
    tries = [F.try_to_timestamp(c, F.lit(f)) for f in formats]
    return F.coalesce(*tries).cast("timestamp_ntz")


def period_label(c: Column, period: str) -> Column:
    """``M`` gives ``2020-04``, ``Q`` gives ``2020Q2``; null stays null."""
    if period == "M":
        return F.date_format(c, "yyyy-MM")
    if period == "Q":
        return F.date_format(c, "yyyy'Q'q")
    raise ValueError(f"period must be M or Q, not {period!r}")


def date_parts(
    df: DataFrame,
    source: str,
    *,
    day: str | None = None,
    year: str | None = None,
    month: str | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Add the named parts of ``source`` and drop it along with ``drop``."""
    if source in df.columns:
        parts = {day: quoted(source), year: F.year(quoted(source)), month: F.month(quoted(source))}
        df = df.withColumns({k: v for k, v in parts.items() if k})
    gone = {source, *drop}
    return df.select(*[quoted(c) for c in df.columns if c not in gone])
