"""Encoders, imputers, feature tables, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from guichet.catalogue import D, register
from guichet.operators import aggregate, encode, splits
from guichet.operators.settle import stage
from guichet.plans.star import LINE_KEY, declarations, line_order

_ID = "project, line, part, supplier"
_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_CHANNELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _dummies(c: str, values: list[str]) -> str:
    return ", ".join(f"""CAST(coalesce({c} = '{v}', false) AS INTEGER) AS "{c}_{v}" """ for v in values)


# Every fixture column with nulls loses the lines of one financing type.
_SOME = "CASE WHEN financing <> 'N' THEN {c} END"


def _with_gaps(spark, sf, *names):
    d = declarations(spark, sf, *LINE_KEY, "financing", *names)
    kept = F.col("financing") != "N"
    return d.select(*LINE_KEY, "financing", *[F.when(kept, F.col(c)).alias(c) for c in names])


def _gaps_sql(*names: str) -> str:
    gaps = ", ".join(f"{_SOME.format(c=c)} AS {c}" for c in names)
    return D + f", g AS (SELECT {_ID}, financing, marker, {gaps} FROM d) "


@register(
    "one_hot_without_first",
    _gaps_sql("region", "channel")
    + f"SELECT {_ID}, {_dummies('region', _REGIONS[1:])}, {_dummies('channel', _CHANNELS[1:])} FROM g",
)
def _(spark, sf):
    df = _with_gaps(spark, sf, "region", "channel").drop("financing")
    return encode.one_hot_drop_first(df, ["region", "channel"])


@register(
    "one_hot_with_mode_filled",
    _gaps_sql("region")
    + f""", m AS (SELECT region AS mode FROM g WHERE region IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    f AS (SELECT {_ID}, coalesce(region, mode) AS region FROM g, m)
    SELECT {_ID}, {_dummies('region', _REGIONS)} FROM f""",
)
def _(spark, sf):
    df = _with_gaps(spark, sf, "region").drop("financing")
    return encode.one_hot_ignore(encode.impute_mode(df, ["region"]), ["region"])


@register(
    "one_hot_of_unseen_categories",
    D + f"""SELECT {_ID}, year, {_dummies('month', [f'1999-{m:02d}' for m in range(1, 13)])}
      FROM (SELECT *, strftime(signed, '%Y-%m') AS month FROM d)""",
)
def _(spark, sf):
    d = declarations(spark, sf, *LINE_KEY, "year", "signed")
    df = d.withColumn("month", F.date_format("signed", "yyyy-MM")).drop("signed")
    known = encode.fit_categories(df.where("month between '1999-01' and '1999-12'"), ["month"])
    return encode.one_hot_ignore(df, ["month"], known)


@register(
    "one_hot_of_many_categories",
    D + f""", t AS (SELECT {_ID}, buyer, CAST(project AS VARCHAR) AS file FROM d),
    x AS (SELECT buyer, row_number() OVER (ORDER BY buyer) - 2 AS place FROM (SELECT DISTINCT buyer FROM t)),
    z AS (SELECT file, row_number() OVER (ORDER BY file) - 2 AS place FROM (SELECT DISTINCT file FROM t)),
    n AS (SELECT (SELECT count(*) FROM x) AS nx, (SELECT count(*) FROM z) AS nz)
    SELECT {_ID}, concat_ws(',', CASE WHEN x.place >= 0 THEN x.place END, CASE WHEN z.place >= 0 THEN nx - 1 + z.place END) AS places,
      nx + nz - 2 AS size
    FROM t JOIN x USING (buyer) JOIN z USING (file), n""",
)
def _(spark, sf):
    """A place per customer name and project, without the first of each."""
    names = ["buyer", "file"]
    df = declarations(spark, sf, *LINE_KEY, "buyer").withColumn("file", F.col("project").cast("string"))
    fitted, size = encode.fit_one_hot(df, names, drop_first=True)
    places = F.array_join(F.col("positions").cast("array<string>"), ",")
    return encode.one_hot_positions(df, names, fitted).select(*LINE_KEY, places.alias("places"), F.lit(size).cast("long").alias("size"))


_CODES = """, c AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS code
  FROM (SELECT DISTINCT {c} FROM {t} WHERE {c} IS NOT NULL)) """


@register(
    "ordinal_codes",
    _gaps_sql("agency")
    + _CODES.format(c="agency", t="g")
    + f"SELECT {_ID}, CAST(coalesce(code, -1) AS DOUBLE) AS agency FROM g LEFT JOIN c ON agency = v",
)
def _(spark, sf):
    df = _with_gaps(spark, sf, "agency").drop("financing")
    return encode.ordinal_encode(df, ["agency"])


@register(
    "ordinal_codes_with_unseen",
    D + f""", m AS (SELECT {_ID}, year, sector, strftime(signed, '%Y-%m') AS month FROM d),
    t AS (SELECT * FROM m WHERE year < 2000)"""
    + _CODES.format(c="month", t="t")
    + f""", s AS (SELECT sector AS sv, row_number() OVER (ORDER BY sector) - 1 AS scode
      FROM (SELECT DISTINCT sector FROM t))
    SELECT {_ID}, year, CAST(coalesce(code, -1) AS DOUBLE) AS month, CAST(coalesce(scode, -1) AS DOUBLE) AS sector
      FROM m LEFT JOIN c ON month = v LEFT JOIN s ON sector = sv""",
)
def _(spark, sf):
    d = declarations(spark, sf, *LINE_KEY, "year", "sector", "signed")
    df = d.withColumn("month", F.date_format("signed", "yyyy-MM")).drop("signed")
    fitted = encode.fit_ordinal(df.where("year < 2000"), ["month", "sector"])
    return encode.ordinal_encode(df, ["month", "sector"], fitted)


_SHRINK = """(SELECT {keys}, CASE WHEN n = 0 OR var_y * n + greatest(q / n - (s / n) * (s / n), 0) = 0 THEN mean_y
  ELSE var_y * n / (var_y * n + greatest(q / n - (s / n) * (s / n), 0)) * (s / n)
    + (1 - var_y * n / (var_y * n + greatest(q / n - (s / n) * (s / n), 0))) * mean_y END AS e FROM {t})"""


@register(
    "target_encoding",
    D + f""", y AS (SELECT avg(ln(1 + committed)) AS mean_y, var_pop(ln(1 + committed)) AS var_y FROM d),
    s AS (SELECT product, count(*) AS n, sum(ln(1 + committed)) AS s, sum(ln(1 + committed) * ln(1 + committed)) AS q
      FROM d GROUP BY product),
    t AS (SELECT * FROM s, y), e AS {_SHRINK.format(keys='product', t='t')}
    SELECT {_ID}, round(e, 6) AS product FROM d JOIN e USING (product)""",
)
def _(spark, sf):
    d = declarations(spark, sf, *LINE_KEY, "product", "committed")
    df = d.withColumn("y", F.log1p("committed")).drop("committed")
    fitted, mean = encode.fit_target(df, ["product"], "y")
    out = encode.target_encode(df, ["product"], fitted, mean).drop("y")
    return out.withColumn("product", F.round("product", 6))


@register(
    "target_encoding_out_of_fold",
    D + f""", f AS (SELECT *, line % 5 AS fold, ln(1 + committed) AS v FROM d),
    y AS (SELECT a.fold, avg(b.v) AS mean_y, var_pop(b.v) AS var_y FROM (SELECT DISTINCT fold FROM f) a
      JOIN f b ON a.fold <> b.fold GROUP BY a.fold),
    p AS (SELECT product, fold, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM f GROUP BY product, fold),
    o AS (SELECT product, fold, sum(n) OVER w - n AS n, sum(s) OVER w - s AS s, sum(q) OVER w - q AS q FROM p
      WINDOW w AS (PARTITION BY product)),
    t AS (SELECT * FROM o JOIN y USING (fold)), e AS {_SHRINK.format(keys='product, fold', t='t')}
    SELECT {_ID}, round(e, 6) AS product FROM f JOIN e USING (product, fold)""",
)
def _(spark, sf):
    d = declarations(spark, sf, *LINE_KEY, "product", "committed")
    df = d.withColumn("y", F.log1p("committed")).withColumn("fold", F.col("line") % 5).drop("committed")
    fitted, mean = encode.fit_target(df, ["product"], "y", "fold")
    out = encode.target_encode(df, ["product"], fitted, mean, "fold").drop("y", "fold")
    return out.withColumn("product", F.round("product", 6))


@register(
    "imputed_values",
    _gaps_sql("agency", "sector", "quantity", "year")
    + f""", m AS (SELECT median(quantity) AS q, CAST(median(year) AS DOUBLE) AS y FROM g),
    k AS (SELECT sector AS mode FROM g WHERE sector IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT {_ID}, coalesce(agency, 'inconnu') AS agency, coalesce(sector, mode) AS sector,
      coalesce(quantity, q) AS quantity, coalesce(CAST(year AS DOUBLE), y) AS year FROM g, m, k""",
)
def _(spark, sf):
    # Both fits and the result read the lines as they were joined once.
    df = stage(_with_gaps(spark, sf, "agency", "sector", "quantity", "year").drop("financing"))
    df = encode.impute_constant(df, ["agency"])
    return encode.impute_median(encode.impute_mode(df, ["sector"]), ["quantity", "year"])


@register(
    "feature_table",
    _gaps_sql("region", "channel", "quantity")
    + f""", m AS (SELECT median(quantity) AS q FROM g)
    SELECT {_ID}, {_dummies('region', _REGIONS[1:])}, {_dummies('channel', _CHANNELS[1:])},
      coalesce(quantity, q) AS quantity, CAST(marker > 0 AS INTEGER) AS marker FROM g, m""",
)
def _(spark, sf):
    d = declarations(spark, sf, *LINE_KEY, "financing", "region", "channel", "quantity", "marker")
    kept = F.col("financing") != "N"
    df = d.select(
        *LINE_KEY,
        *[F.when(kept, F.col(c)).alias(c) for c in ("region", "channel", "quantity")],
        (F.col("marker") > 0).cast("int").alias("marker"),
    )
    return encode.feature_frame(df, ["region", "channel", "absent"], ["quantity"], ["marker"], LINE_KEY)


# Splits --------------------------------------------------------------------------

_TOKEN = "md5(concat_ws('|', project, line, part, supplier, '42'))"


@register(
    "random_split",
    D + f"""SELECT {_ID}, row_number() OVER (ORDER BY {_TOKEN}) <= ceil(count(*) OVER () * 0.2) AS is_test FROM d""",
)
def _(spark, sf):
    return splits.random_split(declarations(spark, sf, *LINE_KEY), LINE_KEY)


def _stratified_sql(stratum: str, extra: str = "") -> str:
    """Train sizes by largest remainder, the rest is test."""
    return D + f"""{extra}, b AS (SELECT {_ID}, {stratum} AS stratum, {_TOKEN} AS token FROM d{', e' if extra else ''}),
    c AS (SELECT stratum, count(*) AS n FROM b GROUP BY stratum),
    a AS (SELECT sum(n) AS n_all, sum(n) - ceil(sum(n) * 0.2) AS n_train FROM c),
    q AS (SELECT stratum, n, CAST(floor(n * n_train / n_all) AS BIGINT) AS base,
      (n * n_train) % n_all AS rest, n_train FROM c, a),
    r AS (SELECT stratum, n - base - CAST(row_number() OVER (ORDER BY rest DESC, CAST(stratum AS VARCHAR))
      <= n_train - sum(base) OVER () AS INTEGER) AS wanted FROM q)
    SELECT {_ID}, b.stratum, row_number() OVER (PARTITION BY b.stratum ORDER BY token) <= wanted AS is_test
      FROM b JOIN r ON b.stratum = r.stratum"""


@register("stratified_split", _stratified_sql("financing").replace("b.stratum, row", "b.stratum AS financing, row"))
def _(spark, sf):
    return splits.stratified_split(declarations(spark, sf, *LINE_KEY, "financing"), ["financing"], LINE_KEY)


_DECILES = ", e AS (SELECT quantile_cont(committed, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM d)"


@register(
    "decile_split",
    _stratified_sql("len(list_filter(edges, lambda x: x < committed))", _DECILES).replace("b.stratum, row", "row"),
)
def _(spark, sf):
    d = declarations(spark, sf, *LINE_KEY, "committed")
    return splits.decile_split(d, "committed", LINE_KEY).drop("committed")


@register(
    "contiguous_folds",
    D + f""", r AS (SELECT {_ID}, signed, row_number() OVER (ORDER BY signed, {_ID}) - 1 AS pos,
      count(*) OVER () AS n FROM d)
    SELECT {_ID}, signed, CAST(CASE WHEN pos < (n % 7) * (n // 7 + 1) THEN pos // (n // 7 + 1)
      ELSE n % 7 + (pos - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold FROM r""",
)
def _(spark, sf):
    return splits.kfold(declarations(spark, sf, *LINE_KEY, "signed"), 7, line_order("signed", *LINE_KEY))


@register("splits_put_together", D + f"SELECT {_ID}, committed FROM d")
def _(spark, sf):
    marked = splits.random_split(declarations(spark, sf, *LINE_KEY, "committed"), LINE_KEY)
    train, test = marked.where(~F.col("is_test")), marked.where("is_test")
    return splits.union_splits(train, test).drop("is_test")


@register(
    "dataset_statistics",
    D + f""", m AS (SELECT granted / committed AS y,
      row_number() OVER (ORDER BY {_TOKEN}) <= ceil(count(*) OVER () * 0.2) AS t FROM d)
    SELECT count(*) AS n_rows_after_dropna, 117 AS n_features, count(*) FILTER (NOT t) AS n_train,
      count(*) FILTER (t) AS n_test, round(avg(y) FILTER (NOT t), 8) AS target_mean_train,
      round(avg(y) FILTER (t), 8) AS target_mean_test FROM m""",
)
def _(spark, sf):
    d = declarations(spark, sf, *LINE_KEY, "granted", "committed")
    marked = splits.random_split(
        d.select(*LINE_KEY, (F.col("granted") / F.col("committed")).alias("ratio")), LINE_KEY
    )
    df = aggregate.dataset_stats(marked, "ratio", "is_test", 117)
    return df.withColumns(
        {c: F.round(c, 8) for c in ("target_mean_train", "target_mean_test")}
    )
