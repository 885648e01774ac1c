"""The given star-schema tables seen as a declaration table.

One row per line item. Only the dimensions a query names are joined, and no side is
forced to be broadcast: Spark decides by size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from guichet import vocabulary as V
from guichet.sources.files import scan_table

_FROM_LINE = {
    "project": "l_orderkey",
    "line": "l_linenumber",
    "part": "l_partkey",
    "supplier": "l_suppkey",
    "signed": "l_shipdate",
    "committed": "l_extendedprice",
    "granted": "l_extendedprice * (1 - l_discount)",
    "quantity": "l_quantity",
    "marker": "l_tax",
    "financing": "l_returnflag",
}
_FROM_ORDER = {"year": "year(o_orderdate)", "priority": "o_orderpriority"}
_FROM_CUSTOMER = {"channel": "c_mktsegment", "buyer": "c_name"}
_FROM_NATION = {"country": "n_name"}
_FROM_REGION = {"region": "r_name"}
_FROM_PART = {"sector": "p_type", "agency": "p_brand", "product": "p_name"}

LINE_KEY = ["project", "line", "part", "supplier"]


def declarations(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The named columns of the view; joins follow from them."""
    def uses(group: dict) -> bool:
        return any(n in group for n in names)

    def table(name: str) -> DataFrame:
        return scan_table(spark, sf_dir, name)

    region = uses(_FROM_REGION)
    nation = region or uses(_FROM_NATION)
    customer = nation or uses(_FROM_CUSTOMER)
    orders = customer or uses(_FROM_ORDER)
    # From the smallest table up, so that a filter on a place cuts orders before the lines join.
    side = table("region") if region else None

    def joined(name: str, key: str, foreign: str) -> DataFrame:
        rows = table(name)
        return rows if side is None else rows.join(side, F.col(foreign) == F.col(key))

    if nation:
        side = joined("nation", "r_regionkey", "n_regionkey")
    if customer:
        side = joined("customer", "n_nationkey", "c_nationkey")
    if orders:
        side = joined("orders", "c_custkey", "o_custkey")
    df = joined("lineitem", "o_orderkey", "l_orderkey")
    if uses(_FROM_PART):
        df = df.join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
    columns = _FROM_LINE | _FROM_ORDER | _FROM_CUSTOMER | _FROM_NATION | _FROM_REGION | _FROM_PART
    return df.select(*[F.expr(columns[n]).alias(n) for n in names])


def line_order(*names: str) -> list[Column]:
    """A total order of the lines of the view."""
    return [F.col(n) for n in (names or LINE_KEY)]


def raw_declarations(spark: SparkSession, sf_dir: str, extra: Sequence[str] = ()) -> DataFrame:
    """The view as it would come out of a raw file: every column is text.

    Amounts are written the French way, dates day first, and labels carry the
    spellings the cleaning steps unify.
    """
    return as_raw(raw_lines(spark, sf_dir, extra), extra)


def raw_lines(spark: SparkSession, sf_dir: str, extra: Sequence[str] = ()) -> DataFrame:
    """The columns of the view that raw text is made of."""
    return declarations(
        spark, sf_dir, *LINE_KEY, "signed", "committed", "granted", "quantity", "marker",
        "financing", "year", "priority", "channel", "country", "region", "sector", "agency", *extra,
    )


def as_raw(d: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """``raw_lines`` as text."""
    def french(c: str) -> Column:
        return F.replace(F.round(F.col(c), 4).cast("decimal(18,4)").cast("string"), F.lit("."), F.lit(","))

    financing = (
        F.when(F.col("financing") == "R", "Dons").when(F.col("financing") == "A", "Prêt").otherwise("Annulation")
    )
    channel = (
        F.when(F.col("channel") == "BUILDING", "Réseaux")
        .when(F.col("channel") == "HOUSEHOLD", "  ONG   INTERNATIONALE ")
        .otherwise(F.col("channel"))
    )
    country = F.when(F.col("country") == "NATION_7", "Türkiye").otherwise(F.col("country"))
    return d.select(
        F.when(F.col("quantity") < 50, F.col("project").cast("string")).alias(V.PROJECT_KEY),
        F.date_format("signed", "dd/MM/yyyy").alias(V.COMMITMENT_DATE),
        F.col("year").cast("string").alias(V.DECLARATION_YEAR),
        french("committed").alias(V.COMMITTED),
        french("granted").alias(V.GRANT_EQUIVALENT),
        french("granted").alias(V.PAID),
        french("committed").alias("Engagements (K USD)"),
        F.col("agency").alias(V.AGENCY),
        F.col("part").cast("string").alias("Code agence"),
        country.alias(V.COUNTRY),
        F.col("region").alias(V.REGION),
        F.col("sector").alias(V.SECTOR),
        financing.alias(V.FINANCING_TYPE),
        channel.alias(V.CHANNEL),
        F.col("priority").alias(V.MOBILISED_ORIGIN),
        F.when(F.col("line") == 1, F.col("agency")).alias("Localisation geographique"),
        F.when((F.col("line") == 7) & (F.col("marker") > 0.07), F.lit("x")).alias("Colonne creuse"),
        F.when(F.col("marker") > 0, F.col("marker").cast("string")).alias("Genre"),
        *[F.col(c) for c in LINE_KEY],
        *[F.col(c) for c in extra],
    )
