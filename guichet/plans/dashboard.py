"""The dashboard: filters, indicators and four charts from one pass over the table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from guichet import vocabulary as V
from guichet.functions.numbers import exact_sum, finite, to_millions
from guichet.functions.text import quoted
from guichet.operators.aggregate import distinct_values, keyed
from guichet.operators.filters import filter_in, filter_range
from guichet.operators.series import numbered
from guichet.operators.settle import settle


@dataclass(frozen=True)
class DashboardColumns:
    amount: str = V.PAID
    year: str = V.DECLARATION_YEAR
    country: str = V.COUNTRY
    region: str = V.REGION
    sector: str = V.SECTOR

    @property
    def dimensions(self) -> list[str]:
        return [self.year, self.country, self.region, self.sector]


def filter_options(df: DataFrame, names: DashboardColumns = DashboardColumns()) -> dict[str, DataFrame]:
    return {c: distinct_values(df, c) for c in (names.region, names.sector)}


def dashboard_cube(
    df: DataFrame,
    years: tuple[int, int],
    regions: Sequence[str] | None = None,
    sectors: Sequence[str] | None = None,
    names: DashboardColumns = DashboardColumns(),
    scale: int | None = None,
) -> DataFrame:
    """Sums and counts by year, country, region and sector of the filtered rows.

    The filters go into the scan; every figure of the dashboard is an aggregate of
    this table, whose size is set by the vocabularies and not by the data.
    """
    df = filter_range(df, names.year, *years)
    df = filter_in(df, names.region, regions)
    df = filter_in(df, names.sector, sectors)
    amount = quoted(names.amount)
    return df.groupBy(*[quoted(c) for c in names.dimensions]).agg(
        exact_sum(amount, scale).alias("_sum"),
        F.count(F.lit(1)).alias("_rows"),
        F.count(finite(amount)).alias("_paid"),
    )


def dashboard(
    df: DataFrame,
    years: tuple[int, int],
    regions: Sequence[str] | None = None,
    sectors: Sequence[str] | None = None,
    names: DashboardColumns = DashboardColumns(),
    scale: int | None = None,
) -> dict[str, DataFrame]:
    """Five results: indicators, top 10 countries, top 8 sectors, years, regions."""
    cube = settle(dashboard_cube(df, years, regions, sectors, names, scale))
    value = exact_sum(F.col("_sum"), scale)

    def by(key: str) -> DataFrame:
        return keyed(cube, [key]).groupBy(quoted(key)).agg(value.alias("value"))

    def top(key: str, n: int) -> DataFrame:
        return by(key).orderBy(F.desc("value"), quoted(key)).limit(n)

    indicators = cube.agg(
        to_millions(value).alias("total_millions"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("projects"),
        F.count_distinct(quoted(names.country)).alias("countries"),
        (value / F.nullif(F.sum("_paid"), F.lit(0))).alias("mean_amount"),
    )
    return {
        "kpis": indicators,
        "top_countries": top(names.country, 10),
        "sectors": top(names.sector, 8),
        "years": by(names.year).orderBy(quoted(names.year)),
        "regions": by(names.region).orderBy(quoted(names.region)),
    }


def dashboard_panels(panels: dict[str, DataFrame]) -> DataFrame:
    """The panels as one table (panel, ord, label, value)."""
    kpis = panels["kpis"]
    parts = [
        kpis.select(*[F.col(c).cast("double").alias(c) for c in kpis.columns])
        .unpivot([], kpis.columns, "label", "value")
        .withColumn("ord", F.array_position(F.array(*[F.lit(c) for c in kpis.columns]), F.col("label")).cast("long"))
        .select(F.lit("kpis").alias("panel"), "ord", "label", "value")
    ]
    for name in ("top_countries", "sectors", "years", "regions"):
        panel = panels[name]
        key = quoted(panel.columns[0])
        order = [F.desc("value"), key] if name in ("top_countries", "sectors") else [key]
        parts.append(
            numbered(
                panel, key, F.col("value"), *order, bounded=name in ("top_countries", "sectors")
            ).select(F.lit(name).alias("panel"), "ord", "label", "value")
        )
    return reduce(DataFrame.unionByName, parts)
