"""What columns hold: missing values, profiles, domains, medians, modes, bins, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from guichet.catalogue import D, register
from guichet.operators import aggregate, columns, profile, quantiles
from guichet.plans.star import LINE_KEY, declarations
from guichet.sources.files import scan_table


@register(
    "missing_percentages",
    """WITH h AS (SELECT nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax, l_returnflag AS flag
      FROM lineitem),
    s AS (SELECT count(*) AS n, count(discount) AS d, count(tax) AS t, count(flag) AS f FROM h)
    SELECT 'discount' AS "column", round((n - d) * 100.0 / n, 6) AS pct FROM s
    UNION ALL SELECT 'tax', round((n - t) * 100.0 / n, 6) FROM s
    UNION ALL SELECT 'flag', round((n - f) * 100.0 / n, 6) FROM s""",
)
def _(spark, sf):
    li = scan_table(spark, sf, "lineitem").select(
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("discount"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"),
        F.col("l_returnflag").alias("flag"),
    )
    return columns.missing_pct(li).withColumn("pct", F.round("pct", 6))


_PROFILED = ["region", "country", "agency", "product", "sector", "priority"]


def _profile_sql() -> str:
    parts = []
    for i, c in enumerate(_PROFILED):
        parts.append(f"""SELECT {i} AS position, '{c}' AS "column", 'string' AS type,
          count(*) AS n_distinct, round(avg(length(v)), 6) AS mean_length,
          CASE WHEN count(*) <= 12 THEN list(v ORDER BY v) ELSE list(v ORDER BY p, v)[1:3] END AS examples,
          CASE WHEN count(*) <= 12
            THEN '- ''{c}'' (texte) valeurs: ' || string_agg('''' || v || '''', ', ' ORDER BY v)
            ELSE '- ''{c}'' (texte, ' || count(*) || ' modalités, ex: '
              || array_to_string(list('''' || v || '''' ORDER BY p, v)[1:3], ', ') || ')' END AS line
          FROM (SELECT {c} AS v, min(project * 8 + line) AS p
            FROM d GROUP BY {c})""")
    parts.append(f"""SELECT {len(_PROFILED)}, 'year', 'int', NULL, NULL, NULL, '- ''year'' (int)'""")
    parts.append(f"""SELECT {len(_PROFILED) + 1}, 'committed', 'double', NULL, NULL, NULL, '- ''committed'' (double)'""")
    return D + " UNION ALL ".join(parts)


@register("column_profile", _profile_sql())
def _(spark, sf):
    d = declarations(spark, sf, *_PROFILED, "year", "committed", "project", "line")
    shown = d.withColumn("_seen", F.col("project") * 8 + F.col("line")).drop("project", "line")
    df = profile.profile_columns(shown, F.col("_seen")).where("column <> '_seen'")
    return df.withColumn("mean_length", F.round("mean_length", 6))


@register(
    "dropdown_domains",
    """SELECT 'c_name' AS "column", list(v ORDER BY v)[1:200] AS "values" FROM (SELECT DISTINCT c_name AS v FROM customer)
    UNION ALL SELECT 'c_mktsegment', list(v ORDER BY v)[1:200] FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)""",
)
def _(spark, sf):
    return profile.dropdown_domains(scan_table(spark, sf, "customer"), ["c_name", "c_mktsegment"])


@register(
    "column_medians",
    """SELECT 'l_extendedprice' AS "column", round(median(l_extendedprice), 6) AS value FROM lineitem
    UNION ALL SELECT 'l_quantity', round(median(l_quantity), 6) FROM lineitem
    UNION ALL SELECT 'l_tax', round(median(nullif(l_tax, 0)), 6) FROM lineitem""",
)
def _(spark, sf):
    li = scan_table(spark, sf, "lineitem").select(
        "l_extendedprice", "l_quantity", F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("l_tax")
    )
    df = profile.median(li, ["l_extendedprice", "l_quantity", "l_tax"])
    return df.withColumn("value", F.round("value", 6))


_MODES = ["sector", "agency", "product", "country"]


@register(
    "most_frequent_values",
    D + " UNION ALL ".join(
        f"""(SELECT '{c}' AS "column", {c} AS value FROM d GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""
        for c in _MODES
    ),
)
def _(spark, sf):
    return profile.most_frequent(declarations(spark, sf, *_MODES), _MODES)


@register(
    "cardinality_per_column",
    D + "SELECT " + ", ".join(f"count(DISTINCT {c}) AS {c}" for c in _PROFILED) + " FROM d",
)
def _(spark, sf):
    return columns.cardinalities(declarations(spark, sf, *_PROFILED), _PROFILED)


@register(
    "columns_by_type_and_cardinality",
    D + """SELECT 'low' AS kind, ['region', 'sector', 'channel'] AS names
    UNION ALL SELECT 'high', ['country', 'agency', 'product']
    UNION ALL SELECT 'number', ['year', 'quantity']""",
)
def _(spark, sf):
    d = declarations(
        spark, sf, "region", "country", "sector", "agency", "product", "channel", "year", "quantity", "committed"
    )
    texts, numbers = columns.columns_by_type(d, ["committed"])
    low, high = columns.split_by_cardinality(d, texts, 15)
    rows = [("low", low), ("high", high), ("number", numbers)]
    return spark.createDataFrame(rows, "kind string, names array<string>")


_EDGES = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"


@register(
    "decile_bins_of_amount",
    f"""WITH e AS (SELECT quantile_cont(l_extendedprice, {_EDGES}) AS edges FROM lineitem)
    SELECT l_orderkey AS project, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier,
      CAST(len(list_filter(edges, lambda x: x < l_extendedprice)) AS INTEGER) AS bin FROM lineitem, e""",
)
def _(spark, sf):
    d = declarations(spark, sf, *LINE_KEY, "committed")
    return quantiles.decile_bins(d, "committed").drop("committed")


@register(
    "decile_bins_with_repeated_edges",
    f"""WITH t AS (SELECT greatest(l_discount, 0.03) AS x FROM lineitem),
    e AS (SELECT list_sort(list_distinct(list_prepend(min(x), list_append(
      quantile_cont(x, {_EDGES}), max(x)))))[2:-2] AS inner_edges FROM t)
    SELECT CAST(len(list_filter(inner_edges, lambda y: y < x)) AS INTEGER) AS bin, count(*) AS n
      FROM t, e GROUP BY 1""",
)
def _(spark, sf):
    li = scan_table(spark, sf, "lineitem").select(F.greatest("l_discount", F.lit(0.03)).alias("x"))
    return quantiles.decile_bins(li, "x").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


_ERRORS = "l_extendedprice - l_quantity * 2000"
_METRICS = f"""round(sqrt(avg(({_ERRORS}) * ({_ERRORS}))), 4) AS rmse, round(avg(abs({_ERRORS})), 4) AS mae,
  round(1 - sum(({_ERRORS}) * ({_ERRORS})) / (var_pop(l_extendedprice) * count(*)), 8) AS r2, count(*) AS n"""


def _predictions(spark, sf):
    li = scan_table(spark, sf, "lineitem")
    return li.select(
        "l_extendedprice", F.year("l_shipdate").alias("year"), (F.col("l_quantity") * 2000).alias("prediction")
    )


def _rounded(df):
    return df.withColumns({"rmse": F.round("rmse", 4), "mae": F.round("mae", 4), "r2": F.round("r2", 8)})


@register("regression_metrics", f"SELECT {_METRICS} FROM lineitem")
def _(spark, sf):
    return _rounded(aggregate.regression_metrics(_predictions(spark, sf), "l_extendedprice", "prediction"))


@register(
    "regression_metrics_by_year",
    f"SELECT CAST(year(l_shipdate) AS INTEGER) AS year, {_METRICS} FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    return _rounded(
        aggregate.regression_metrics(_predictions(spark, sf), "l_extendedprice", "prediction", ["year"])
    )


@register(
    "score_summary",
    f"""WITH s AS (SELECT year(l_shipdate) AS year, sqrt(avg(({_ERRORS}) * ({_ERRORS}))) AS rmse,
      avg(abs({_ERRORS})) AS mae FROM lineitem GROUP BY 1)
    SELECT round(avg(rmse), 4) AS rmse_mean, round(stddev_pop(rmse), 4) AS rmse_std,
      round(avg(mae), 4) AS mae_mean, round(stddev_pop(mae), 4) AS mae_std FROM s""",
)
def _(spark, sf):
    scores = aggregate.regression_metrics(_predictions(spark, sf), "l_extendedprice", "prediction", ["year"])
    df = aggregate.cv_summary(scores, ["rmse", "mae"])
    return df.select(*[F.round(c, 4).alias(c) for c in df.columns])
