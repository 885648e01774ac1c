"""Filters, aggregates and chart questions over the declaration view."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from guichet.catalogue import D, MONEY, average, money, register
from guichet.operators import aggregate as A, filters, series
from guichet.plans.chart import ChartSpec, chart_query, to_payload
from guichet.plans.dashboard import DashboardColumns, dashboard, dashboard_panels, filter_options
from guichet.plans.star import LINE_KEY, declarations
from guichet.sources.files import scan_table

PANEL = DashboardColumns("committed", "year", "country", "region", "sector")


def _round(df: DataFrame, digits: int = 2, name: str = "value") -> DataFrame:
    return df.withColumn(name, F.round(name, digits))


# Filters -------------------------------------------------------------------------


@register(
    "filter_year_range",
    D + "SELECT project, line, part, supplier, year FROM d WHERE year BETWEEN 1997 AND 1999",
)
def _(spark, sf):
    return filters.filter_range(declarations(spark, sf, *LINE_KEY, "year"), "year", 1997, 1999)


@register(
    "filter_in_list",
    D + "SELECT project, line, part, supplier, region FROM d WHERE region IN ('ASIA', 'EUROPE')",
)
def _(spark, sf):
    return filters.filter_in(declarations(spark, sf, *LINE_KEY, "region"), "region", ["ASIA", "EUROPE"])


@register("filter_empty_list", D + "SELECT sector, count(*) AS n FROM d GROUP BY sector")
def _(spark, sf):
    df = filters.filter_in(declarations(spark, sf, "sector"), "sector", [])
    return df.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


@register(
    "filter_one_country",
    D + "SELECT project, line, part, supplier, country FROM d WHERE country = 'NATION_7'",
)
def _(spark, sf):
    return filters.filter_eq(declarations(spark, sf, *LINE_KEY, "country"), "country", "NATION_7")


@register(
    "filter_comparison",
    D + "SELECT project, line, part, supplier, year FROM d WHERE year >= 1998",
)
def _(spark, sf):
    return filters.filter_cmp(declarations(spark, sf, *LINE_KEY, "year"), "year", ">=", 1998)


@register(
    "filter_positive_amount",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0",
)
def _(spark, sf):
    return filters.filter_positive(scan_table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


def _holes(spark, sf):
    li = scan_table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("discount"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"),
    )


_HOLES = """WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax FROM lineitem) SELECT * FROM h """


@register("drop_nulls_in_required", _HOLES + "WHERE discount IS NOT NULL")
def _(spark, sf):
    return filters.drop_nulls_subset(_holes(spark, sf), ["discount"])


@register("drop_nulls_anywhere", _HOLES + "WHERE discount IS NOT NULL AND tax IS NOT NULL")
def _(spark, sf):
    return filters.drop_nulls_any(_holes(spark, sf))


# Aggregates ----------------------------------------------------------------------

TOP_COUNTRIES = D + f"""SELECT country, {money('committed')} AS value FROM d
GROUP BY country ORDER BY value DESC, country LIMIT 10"""


@register("top_countries_by_amount", TOP_COUNTRIES)
def top_countries(spark, sf):
    return _round(A.top_n_by(declarations(spark, sf, "country", "committed"), "country", "committed", 10, scale=MONEY))


@register("amount_by_region", D + f"SELECT region, {money('committed')} AS value FROM d GROUP BY region")
def _(spark, sf):
    return _round(A.sum_by(declarations(spark, sf, "region", "committed"), "region", "committed", scale=MONEY))


_GAPS = """WITH g AS (SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_totalprice END AS amount FROM orders) """


@register(
    "sum_with_null_keys_and_empty_groups",
    _GAPS + f"SELECT priority, {money('amount')} AS value FROM g WHERE priority IS NOT NULL GROUP BY priority",
)
def _(spark, sf):
    orders = scan_table(spark, sf, "orders")
    priority = F.col("o_orderpriority")
    gaps = orders.select(
        F.when(priority != "5-LOW", priority).alias("priority"),
        F.when(priority != "4-NOT SPECIFIED", F.col("o_totalprice")).alias("amount"),
    )
    return _round(A.sum_by(gaps, "priority", "amount", scale=MONEY))


_SMALL = """WITH v AS (SELECT l_returnflag AS kind, CASE WHEN l_returnflag = 'A' THEN l_quantity * 1e-9
  WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN CAST('inf' AS DOUBLE)
  WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 1e23 ELSE l_quantity END AS amount FROM lineitem) """


@register(
    "total_of_small_values",
    _SMALL + """SELECT kind, CASE WHEN isinf(sum(amount)) THEN 'infinite' ELSE 'finite' END AS size,
      CASE WHEN NOT isinf(sum(amount)) THEN CAST(round(fsum(amount) / CASE kind WHEN 'A' THEN 1e-12 ELSE 1e13 END) AS BIGINT) END AS units
      FROM v GROUP BY kind""",
)
def _(spark, sf):
    kind, quantity, first = F.col("l_returnflag"), F.col("l_quantity"), F.col("l_linenumber") == 1
    amount = (
        F.when(kind == "A", quantity * 1e-9)
        .when((kind == "N") & first, float("inf"))
        .when((kind == "R") & first, 1e23)
        .otherwise(quantity)
    )
    lines = scan_table(spark, sf, "lineitem").select(kind.alias("kind"), amount.alias("amount"))
    infinite = F.col("value") == float("inf")
    return A.sum_by(lines, "kind", "amount").select(
        "kind",
        F.when(infinite, "infinite").otherwise("finite").alias("size"),
        F.when(~infinite, F.round(F.col("value") / F.when(F.col("kind") == "A", 1e-12).otherwise(1e13))).cast("long").alias("units"),
    )


@register(
    "amount_by_year", D + f"SELECT year, {money('committed')} AS value FROM d GROUP BY year ORDER BY year"
)
def _(spark, sf):
    return _round(A.trend_by(declarations(spark, sf, "year", "committed"), "year", "committed", scale=MONEY))


@register(
    "amount_by_month",
    f"SELECT strftime(l_shipdate, '%Y-%m') AS period, {money('l_extendedprice')} AS value "
    "FROM lineitem GROUP BY 1 ORDER BY 1",
)
def _(spark, sf):
    return _round(A.trend_by_period(declarations(spark, sf, "signed", "committed"), "signed", "M", "committed", scale=MONEY))


@register(
    "amount_by_quarter",
    f"SELECT concat(year(l_shipdate), 'Q', quarter(l_shipdate)) AS period, "
    f"{money('l_extendedprice')} AS value FROM lineitem GROUP BY 1 ORDER BY 1",
)
def _(spark, sf):
    return _round(A.trend_by_period(declarations(spark, sf, "signed", "committed"), "signed", "Q", "committed", scale=MONEY))


@register(
    "event_value_by_month",
    f"SELECT strftime(ts, '%Y-%m') AS period, {money('value')} AS value FROM events GROUP BY 1 ORDER BY 1",
)
def _(spark, sf):
    return _round(A.trend_by_period(scan_table(spark, sf, "events"), "ts", "M", "value", scale=MONEY))


@register("total_amount", f"SELECT {money('l_extendedprice')} AS value FROM lineitem")
def _(spark, sf):
    return _round(A.total(declarations(spark, sf, "committed"), "committed", scale=MONEY))


@register("mean_amount", f"SELECT {average('l_extendedprice')} AS value FROM lineitem")
def _(spark, sf):
    return _round(A.mean_of(declarations(spark, sf, "committed"), "committed", scale=MONEY), 4)


@register("mean_amount_by_sector", D + f"SELECT sector, {average('committed')} AS value FROM d GROUP BY sector")
def _(spark, sf):
    return _round(A.mean_by(declarations(spark, sf, "sector", "committed"), "sector", "committed", scale=MONEY), 4)


@register("line_count", "SELECT count(*) AS value FROM lineitem")
def _(spark, sf):
    return A.count_rows(declarations(spark, sf, "project"))


@register("lines_by_channel", D + "SELECT channel, count(*) AS value FROM d GROUP BY channel")
def _(spark, sf):
    return A.count_by(declarations(spark, sf, "channel"), "channel")


@register("distinct_projects", "SELECT count(DISTINCT l_orderkey) AS value FROM lineitem")
def _(spark, sf):
    return A.count_distinct(declarations(spark, sf, "project"), "project")


@register(
    "indicators",
    D + f"""SELECT round({money('committed')} / 1000, 3) AS total_millions, count(*) AS projects,
    count(DISTINCT country) AS countries, {average('committed')} AS mean_amount FROM d""",
)
def _(spark, sf):
    df = A.kpis(declarations(spark, sf, "country", "committed"), "committed", "country", scale=MONEY)
    return _round(_round(df, 3, "total_millions"), 4, "mean_amount")


@register(
    "sector_shares",
    D + f""", s AS (SELECT agency, {money('committed')} AS value FROM d GROUP BY agency
      ORDER BY value DESC, agency LIMIT 8)
    SELECT agency, value, round(value / sum(value) OVER (), 6) AS share FROM s""",
)
def _(spark, sf):
    df = A.share_by(declarations(spark, sf, "agency", "committed"), "agency", "committed", 8, scale=MONEY)
    return _round(_round(df), 6, "share")


@register("region_domain", "SELECT DISTINCT r_name AS region FROM region JOIN nation ON n_regionkey = r_regionkey "
          "JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey "
          "JOIN lineitem ON l_orderkey = o_orderkey ORDER BY 1")
def _(spark, sf):
    return A.distinct_values(declarations(spark, sf, "region"), "region")


# Series --------------------------------------------------------------------------

@register(
    "largest_orders",
    """SELECT o_orderkey, o_totalprice FROM orders
    ORDER BY CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END DESC NULLS LAST, o_orderkey LIMIT 25""",
)
def _(spark, sf):
    orders = scan_table(spark, sf, "orders")
    gaps = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")).alias("known")
    top = series.head(orders.select("o_orderkey", "o_totalprice", gaps), "known", 25, "o_orderkey")
    return top.drop("known")


_YEARS = f"y AS (SELECT year, {money('committed')} AS value FROM d GROUP BY year)"
_LAST = "t AS (SELECT * FROM y ORDER BY year DESC LIMIT 5)"


@register("last_five_years", D + f", {_YEARS}, {_LAST} SELECT year, value FROM t ORDER BY year")
def _(spark, sf):
    yearly = A.trend_by(declarations(spark, sf, "year", "committed"), "year", "committed", scale=MONEY)
    return _round(series.last_n(yearly, "year", 5))


@register(
    "change_against_year_before",
    D + f""", {_YEARS} SELECT year, value,
      round(coalesce((value / lag(value) OVER (ORDER BY year) - 1) * 100, 0), 6) AS change FROM y""",
)
def _(spark, sf):
    yearly = _round(A.trend_by(declarations(spark, sf, "year", "committed"), "year", "committed", scale=MONEY))
    return _round(series.pct_change(yearly, "year", "value"), 6, "change")


@register(
    "summary_of_top_sectors",
    D + f""", s AS (SELECT sector, {money('committed')} AS value FROM d GROUP BY sector),
    o AS (SELECT row_number() OVER (ORDER BY value DESC, sector) AS ord, sector AS label, value,
      CASE WHEN value = floor(value) THEN replace(format('{{:,}}', CAST(value AS BIGINT)), ',', ' ')
        ELSE replace(replace(replace(format('{{:,.2f}}', value), ',', ' '), '.', ','), '_', ' ') END AS shown FROM s),
    t AS (SELECT count(*) AS items, sum(CAST(value AS DECIMAL(28,2))) AS total FROM s)
    SELECT max(label) FILTER (ord = 1) AS leader, max(items) AS items,
      round(max(CAST(total AS DOUBLE)), 2) AS total,
      '**Secteurs**. En tête : **' || max(label) FILTER (ord = 1) || '** (' || max(shown) FILTER (ord = 1)
      || ' K EUR). Suivi de ' || max(label) FILTER (ord = 2) || ' (' || max(shown) FILTER (ord = 2) || '), '
      || max(label) FILTER (ord = 3) || ' (' || max(shown) FILTER (ord = 3) || '). Total affiché ('
      || max(items) || ' éléments) : '
      || replace(replace(format('{{:,.2f}}', max(CAST(total AS DOUBLE))), ',', ' '), '.', ',') || ' K EUR.' AS summary
    FROM o, t""",
)
def _(spark, sf):
    spec = ChartSpec(key="sector", measure="committed")
    sectors = _round(chart_query(declarations(spark, sf, "sector", "committed"), spec))
    return _round(series.summarize_series(sectors, "Secteurs", "K EUR"), 2, "total")


# Chart questions -----------------------------------------------------------------


def _chart(name: str, spec: ChartSpec, columns: list[str], sql: str, digits: int = 2) -> None:
    @register(name, D + sql)
    def query(spark, sf):
        return _round(chart_query(declarations(spark, sf, *columns), spec), digits)


_ORDERED = "SELECT row_number() OVER (ORDER BY {by}) AS ord, CAST(k AS VARCHAR) AS label, value FROM g"


def _grouped(key: str, value: str, where: str = "true") -> str:
    return f", g AS (SELECT {key} AS k, {value} AS value FROM d WHERE {where} GROUP BY 1 HAVING k IS NOT NULL) "


_BY_VALUE = _ORDERED.format(by="value DESC, k") + " ORDER BY ord LIMIT "
_BY_KEY = _ORDERED.format(by="k")

_chart(
    "chart_top_ten_countries",
    ChartSpec(key="country", measure="committed", limit=10, title="Top 10", unit="K EUR"),
    ["country", "committed"],
    _grouped("country", money("committed")) + _BY_VALUE + "10",
)
_chart(
    "chart_bar_is_limited_to_fifteen",
    ChartSpec(key="agency", measure="committed"),
    ["agency", "committed"],
    _grouped("agency", money("committed")) + _BY_VALUE + "15",
)
_chart(
    "chart_region_pie",
    ChartSpec(type="pie", key="region", measure="committed"),
    ["region", "committed"],
    _grouped("region", money("committed")) + _BY_VALUE + "15",
)
_chart(
    "chart_country_by_year",
    ChartSpec(type="line", key="year", measure="committed", filters=[("country", "==", "NATION_7")]),
    ["year", "country", "committed"],
    _grouped("year", money("committed"), "country = 'NATION_7'") + _BY_KEY,
)
_chart(
    "chart_by_month",
    ChartSpec(type="line", date="signed", period="M", measure="committed"),
    ["signed", "committed"],
    _grouped("strftime(signed, '%Y-%m')", money("committed")) + _BY_KEY,
)
_chart(
    "chart_by_quarter_since",
    ChartSpec(type="line", date="signed", period="Q", measure="committed", filters=[("year", ">=", 1998)]),
    ["signed", "year", "committed"],
    _grouped("concat(year(signed), 'Q', quarter(signed))", money("committed"), "year >= 1998") + _BY_KEY,
)
_chart(
    "chart_country_progress",
    ChartSpec(type="line", key="year", measure="committed", filters=[("country", "==", "NATION_7")],
              last_n=5, pct_change=True, unit="%"),
    ["year", "country", "committed"],
    _grouped("year", money("committed"), "country = 'NATION_7'")
    + """, t AS (SELECT * FROM g ORDER BY k DESC LIMIT 5)
    SELECT row_number() OVER (ORDER BY k) AS ord, CAST(k AS VARCHAR) AS label,
      round(coalesce((value / lag(value) OVER (ORDER BY k) - 1) * 100, 0), 4) AS value FROM t""",
    4,
)
_chart(
    "chart_mean_by_channel",
    ChartSpec(key="channel", measure="committed", how="mean"),
    ["channel", "committed"],
    _grouped("channel", average("committed")) + _BY_VALUE + "15",
    4,
)
_chart(
    "chart_projects_by_sector",
    ChartSpec(key="sector", measure="project", how="nunique", filters=[("region", "in", ["ASIA", "AFRICA"])]),
    ["sector", "project", "region"],
    _grouped("sector", "CAST(count(DISTINCT project) AS DOUBLE)", "region IN ('ASIA', 'AFRICA')") + _BY_VALUE + "15",
)
_chart(
    "chart_lines_by_financing",
    ChartSpec(key="financing", how="count"),
    ["financing"],
    _grouped("financing", "CAST(count(*) AS DOUBLE)") + _BY_VALUE + "15",
)


@register("chart_scalar_total", D + f"SELECT {money('committed')} AS value FROM d WHERE sector <> 'PROMO'")
def _(spark, sf):
    spec = ChartSpec(type="scalar", measure="committed", filters=[("sector", "!=", "PROMO")])
    return _round(chart_query(declarations(spark, sf, "sector", "committed"), spec))


@register(
    "chart_table",
    D + f"""SELECT region, sector, {money('committed')} AS sum_committed, count(*) AS count,
    count(DISTINCT project) AS nunique_project FROM d GROUP BY region, sector""",
)
def _(spark, sf):
    spec = ChartSpec(
        type="table", keys=["region", "sector"],
        measures=[("sum", "committed"), ("count", None), ("nunique", "project")],
    )
    df = chart_query(declarations(spark, sf, "region", "sector", "committed", "project"), spec)
    return _round(df, 2, "sum_committed")


@register(
    "payload_of_top_countries",
    D + f""", g AS (SELECT country AS label, {money('committed')} AS value FROM d GROUP BY country
      ORDER BY value DESC, country LIMIT 10)
    SELECT 'bar' AS type, 'Top 10' AS title, 'K EUR' AS unit,
      CAST(row_number() OVER (ORDER BY value DESC, label) - 1 AS INTEGER) AS pos, label, value FROM g""",
)
def _(spark, sf):
    spec = ChartSpec(key="country", measure="committed", limit=10, title="Top 10", unit="K EUR")
    payload = to_payload(chart_query(declarations(spark, sf, "country", "committed"), spec), spec)
    schema = "type string, title string, unit string, labels array<string>, values array<double>"
    read = payload.select(F.from_json("payload", schema).alias("p")).select("p.*")
    pairs = F.posexplode(F.arrays_zip("labels", "values"))
    return read.select("type", "title", "unit", pairs.alias("pos", "pair")).select(
        "type", "title", "unit", "pos", F.col("pair.labels").alias("label"), F.col("pair.values").alias("value")
    )


_FR = "replace(replace(format('{{:,.2f}}', {v}), ',', ' '), '.', ',')"


@register(
    "summary_of_the_total",
    f"""SELECT {money('l_extendedprice')} AS value, '**Total** : ' || CASE WHEN {money('l_extendedprice')} % 1 = 0
      THEN replace(format('{{:,}}', CAST({money('l_extendedprice')} AS BIGINT)), ',', ' ')
      ELSE {_FR.format(v=money('l_extendedprice'))} END || ' K EUR.' AS summary FROM lineitem""",
)
def _(spark, sf):
    spec = ChartSpec(type="scalar", measure="committed")
    total = _round(chart_query(declarations(spark, sf, "committed"), spec))
    return series.summarize_scalar(total, "value", "Total", "K EUR")


@register(
    "summary_of_a_table",
    D + """SELECT count(*) AS rows, '**Détail** — ' || count(*) || ' ligne(s), 3 colonne(s).' AS summary
    FROM (SELECT DISTINCT region, agency FROM d)""",
)
def _(spark, sf):
    spec = ChartSpec(type="table", keys=["region", "agency"], measures=[("sum", "committed")])
    table = chart_query(declarations(spark, sf, "region", "agency", "committed"), spec)
    return series.summarize_table(table, "Détail")


@register(
    "payload_of_monthly_line",
    f"""SELECT 'line' AS type, strftime(l_shipdate, '%Y-%m') AS label, {money('l_extendedprice')} AS value
    FROM lineitem GROUP BY 2""",
)
def _(spark, sf):
    spec = ChartSpec(type="line", date="signed", period="M", measure="committed")
    payload = to_payload(chart_query(declarations(spark, sf, "signed", "committed"), spec), spec)
    schema = "type string, labels array<string>, values array<double>"
    read = payload.select(F.from_json("payload", schema).alias("p")).select("p.*")
    return read.select("type", F.inline(F.arrays_zip(F.col("labels").alias("label"), F.col("values").alias("value"))))


@register(
    "payload_of_a_table",
    D + f""", g AS (SELECT sector, {money('committed')} AS value, count(*) AS n FROM d GROUP BY sector
      ORDER BY value DESC, sector LIMIT 5)
    SELECT ['sector', 'sum_committed', 'count'] AS columns, sector, value, n FROM g""",
)
def _(spark, sf):
    spec = ChartSpec(type="table", keys=["sector"], measures=[("sum", "committed"), ("count", None)], limit=5)
    payload = to_payload(chart_query(declarations(spark, sf, "sector", "committed"), spec), spec)
    read = payload.select(F.from_json("payload", "columns array<string>, rows array<array<string>>").alias("p"))
    return read.select("p.columns", F.explode("p.rows").alias("row")).select(
        "columns",
        F.get("row", F.lit(0)).alias("sector"),
        F.get("row", F.lit(1)).cast("double").alias("value"),
        F.get("row", F.lit(2)).cast("long").alias("n"),
    )


# Dashboard -----------------------------------------------------------------------

_CUT = "year BETWEEN 1996 AND 2000 AND region IN ('ASIA', 'EUROPE', 'AMERICA')"


@register(
    "dashboard_panels",
    D + f""", f AS (SELECT * FROM d WHERE {_CUT}),
    k AS (SELECT round({money('committed')} / 1000, 4) AS a, CAST(count(*) AS DOUBLE) AS b,
      CAST(count(DISTINCT country) AS DOUBLE) AS c, {average('committed')} AS e FROM f),
    c AS (SELECT country AS label, {money('committed', 4)} AS value FROM f GROUP BY 1 ORDER BY value DESC, label LIMIT 10),
    s AS (SELECT sector AS label, {money('committed', 4)} AS value FROM f GROUP BY 1 ORDER BY value DESC, label LIMIT 8),
    y AS (SELECT CAST(year AS VARCHAR) AS label, {money('committed', 4)} AS value FROM f GROUP BY 1),
    r AS (SELECT region AS label, {money('committed', 4)} AS value FROM f GROUP BY 1)
    SELECT 'kpis' AS panel, CAST(1 AS BIGINT) AS ord, 'total_millions' AS label, a AS value FROM k
    UNION ALL SELECT 'kpis', 2, 'projects', b FROM k
    UNION ALL SELECT 'kpis', 3, 'countries', c FROM k
    UNION ALL SELECT 'kpis', 4, 'mean_amount', e FROM k
    UNION ALL SELECT 'top_countries', row_number() OVER (ORDER BY value DESC, label), label, value FROM c
    UNION ALL SELECT 'sectors', row_number() OVER (ORDER BY value DESC, label), label, value FROM s
    UNION ALL SELECT 'years', row_number() OVER (ORDER BY label), label, value FROM y
    UNION ALL SELECT 'regions', row_number() OVER (ORDER BY label), label, value FROM r""",
)
def _(spark, sf):
    df = declarations(spark, sf, *PANEL.dimensions, "committed")
    panels = dashboard(df, (1996, 2000), ["ASIA", "EUROPE", "AMERICA"], [], PANEL, scale=MONEY)
    return _round(dashboard_panels(panels), 4)


@register(
    "dashboard_filter_options",
    D + """SELECT DISTINCT 'region' AS filter, region AS option FROM d
    UNION ALL SELECT DISTINCT 'sector', sector FROM d""",
)
def _(spark, sf):
    options = filter_options(declarations(spark, sf, "region", "sector"), PANEL)
    region, sector = options["region"], options["sector"]
    return region.select(F.lit("region").alias("filter"), F.col("region").alias("option")).unionByName(
        sector.select(F.lit("sector").alias("filter"), F.col("sector").alias("option"))
    )
