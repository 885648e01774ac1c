"""One row per project: repeated lines, group sums, earliest lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from guichet.catalogue import MONEY, register
from guichet.operators import projects
from guichet.plans.star import LINE_KEY, declarations, line_order

# Lines of quantity 50 have no project key, so null keys occur in number.
_KEY = "CASE WHEN l_quantity < 50 THEN l_orderkey END"
_VIEW = f"""WITH v AS (SELECT l_orderkey AS project, l_linenumber AS line, l_partkey AS part,
  l_suppkey AS supplier, {_KEY} AS key, l_shipdate AS signed, CAST(year(l_shipdate) AS INTEGER) AS signed_year,
  l_quantity AS quantity, l_extendedprice AS committed, l_returnflag AS financing FROM lineitem) """
_LINES = "project, line, part, supplier"


def _view(spark, sf):
    d = declarations(spark, sf, *LINE_KEY, "signed", "quantity", "committed", "financing")
    return d.withColumns(
        {
            "key": F.when(F.col("quantity") < 50, F.col("project")),
            "signed_year": F.year("signed"),
        }
    )


@register(
    "lines_without_repeats",
    _VIEW + f"""SELECT {_LINES}, signed, committed FROM v
    QUALIFY row_number() OVER (PARTITION BY project, line ORDER BY signed, part, supplier) = 1""",
)
def _(spark, sf):
    df = _view(spark, sf).select(*LINE_KEY, "signed", "committed")
    return projects.dedup_exact(df, ["project", "line"], line_order("signed", "part", "supplier"))


@register(
    "project_sums_on_every_line",
    _VIEW + f"""SELECT {_LINES}, key,
      CASE WHEN key IS NOT NULL THEN
        round(CAST(sum(CAST(committed AS DECIMAL(28,6))) OVER (PARTITION BY key) AS DOUBLE), 2) END AS committed,
      CASE WHEN key IS NOT NULL THEN sum(quantity) OVER (PARTITION BY key) END AS quantity FROM v""",
)
def _(spark, sf):
    df = _view(spark, sf).select(*LINE_KEY, "key", "committed", "quantity")
    out = projects.broadcast_group_sum(df, "key", ["committed", "quantity"], scale=MONEY)
    return out.withColumn("committed", F.round("committed", 2))


@register(
    "earliest_line_per_project",
    _VIEW + f"""SELECT {_LINES}, key, signed, committed FROM v
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY signed NULLS LAST, {_LINES}) = 1""",
)
def _(spark, sf):
    df = _view(spark, sf).select(*LINE_KEY, "key", "signed", "committed")
    return projects.keep_first(df, "key", "signed", line_order())


@register(
    "project_rollup",
    _VIEW + f""", u AS (SELECT * FROM v
      QUALIFY row_number() OVER (PARTITION BY signed_year, quantity, key ORDER BY {_LINES}) = 1)
    SELECT {_LINES}, key, signed_year, financing,
      CASE WHEN key IS NOT NULL THEN sum(quantity) OVER (PARTITION BY key) END AS quantity,
      CASE WHEN key IS NOT NULL THEN
        round(CAST(sum(CAST(committed AS DECIMAL(28,6))) OVER (PARTITION BY key) AS DOUBLE), 2) END AS committed
    FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY signed_year NULLS LAST, {_LINES}) = 1""",
)
def _(spark, sf):
    df = _view(spark, sf).drop("signed")
    out = projects.project_rollup(
        df, "key", "signed_year", "quantity", line_order(), sums=["quantity", "committed"], scale=MONEY
    )
    return out.withColumn("committed", F.round("committed", 2))
