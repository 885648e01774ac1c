"""Fitting, cross-validation, selection and batch scoring."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from guichet.catalogue import D, register
from guichet.operators import aggregate, models, splits
from guichet.plans.scoring import score_batch
from guichet.plans.star import LINE_KEY, declarations, line_order
from guichet.plans.training import train_and_select, train_forest_tracked
from guichet.session import shared_folder
from guichet.sources.files import read_metrics, scan_table, write_metrics

_ID = "project, line, part, supplier"
# The tracked forest's depth here; the library's default is none. 100 trees without a limit do not
# end in time (README.md).
DEPTH = 10


def _log_lines(spark, sf, *names):
    d = declarations(spark, sf, *LINE_KEY, "committed", *names)
    return d.withColumn("log_committed", F.log1p("committed")).drop("committed")


_LOG = f", v AS (SELECT {_ID}, signed, financing, quantity, ln(1 + committed) AS y FROM d) "


@register(
    "linear_fit",
    D + _LOG + f""", c AS (SELECT regr_slope(y, quantity) AS a, regr_intercept(y, quantity) AS b FROM v)
    SELECT {_ID}, round(a * quantity + b, 6) AS prediction FROM v, c""",
)
def _(spark, sf):
    df = _log_lines(spark, sf, "quantity")
    features, model = models.fit_model(
        df, models.hourly_features([], ["quantity"]), lambda: models.fit_linear("log_committed"), "log_committed"
    )
    scored = models.predict(df, features, model, LINE_KEY)
    return scored.withColumn("prediction", F.round("prediction", 6))


@register(
    "linear_cross_validation",
    D + _LOG + f""", p AS (SELECT *, row_number() OVER (ORDER BY signed, {_ID}) - 1 AS pos, count(*) OVER () AS n FROM v),
    f AS (SELECT *, CAST(CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1)
      ELSE n % 5 + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM p),
    k AS (SELECT DISTINCT fold AS held FROM f),
    c AS (SELECT held, regr_slope(y, quantity) AS a, regr_intercept(y, quantity) AS b
      FROM k JOIN f ON fold <> held GROUP BY held),
    e AS (SELECT fold, y, y - (a * quantity + b) AS err FROM f JOIN c ON fold = held)
    SELECT fold, round(sqrt(avg(err * err)), 6) AS rmse, round(avg(abs(err)), 6) AS mae,
      round(1 - sum(err * err) / (var_pop(y) * count(*)), 6) AS r2, count(*) AS n FROM e GROUP BY fold""",
)
def _(spark, sf):
    df = _log_lines(spark, sf, "signed", "quantity")
    folded = splits.kfold(df, 5, line_order("signed", *LINE_KEY))
    scores = models.cross_validate(
        folded, models.hourly_features([], ["quantity"]),
        {"LinearRegression": lambda: models.fit_linear("log_committed")}, "log_committed", "fold", 5,
    )
    return scores.select("fold", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2")], "n")


_FOLDED = f""", p AS (SELECT *, row_number() OVER (ORDER BY signed, {_ID}) - 1 AS pos, count(*) OVER () AS n FROM v),
    f AS (SELECT *, CAST(CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1)
      ELSE n % 5 + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM p),
    k AS (SELECT DISTINCT fold AS held FROM f)"""


@register(
    "cross_validation_with_encoders",
    D + f""", v AS (SELECT {_ID}, signed, ln(1 + committed) AS y, CASE WHEN financing <> 'N' THEN quantity END AS quantity,
      coalesce(CASE WHEN line < 6 THEN strftime(signed, '%Y-%m') END, 'inconnu') AS month FROM d)"""
    + _FOLDED
    + """, m AS (SELECT held, median(quantity) AS med FROM k JOIN f ON fold <> held GROUP BY held),
    c AS (SELECT held, month, row_number() OVER (PARTITION BY held ORDER BY month) - 1 AS code
      FROM (SELECT DISTINCT held, month FROM k JOIN f ON fold <> held)),
    x AS (SELECT k.held, fold, y, coalesce(quantity, med) AS a, CAST(coalesce(code, -1) AS DOUBLE) AS b
      FROM f CROSS JOIN k JOIN m ON m.held = k.held LEFT JOIN c ON c.held = k.held AND c.month = f.month),
    g AS (SELECT held, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb,
      avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x WHERE fold <> held GROUP BY held),
    w AS (SELECT held, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS wb, ma, mb, my FROM g),
    e AS (SELECT fold, y, y - (my + wa * (a - ma) + wb * (b - mb)) AS err FROM x JOIN w ON w.held = x.held AND fold = x.held)
    SELECT fold, round(sqrt(avg(err * err)), 6) AS rmse, round(avg(abs(err)), 6) AS mae,
      round(1 - sum(err * err) / (var_pop(y) * count(*)), 6) AS r2, count(*) AS n FROM e GROUP BY fold""",
)
def _(spark, sf):
    """Months are ordered like the folds, so every held-out fold has months its training set lacks."""
    d = _log_lines(spark, sf, "signed", "quantity", "financing")
    df = d.withColumn("quantity", F.when(F.col("financing") != "N", F.col("quantity"))).withColumn(
        "month", F.when(F.col("line") < 6, F.date_format("signed", "yyyy-MM"))
    )
    folded = splits.kfold(df, 5, line_order("signed", *LINE_KEY))
    scores = models.cross_validate(
        folded, models.hourly_features(["month"], ["quantity"]),
        {"LinearRegression": lambda: models.fit_linear("log_committed")}, "log_committed", "fold", 5,
    )
    return scores.select("fold", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2")], "n")


def _fit_and_measure(spark, sf, make):
    df = _log_lines(spark, sf, "quantity", "year", "agency", "sector")
    # Fitting passes over the rows several times.
    marked = splits.random_split(df, LINE_KEY).persist(StorageLevel.MEMORY_AND_DISK)
    fit = models.hourly_features(["agency", "sector"], ["quantity", "year"])
    features, model = models.fit_model(marked.where(~F.col("is_test")), fit, make, "log_committed")
    scored = models.predict(marked.where("is_test"), features, model, ["log_committed"])
    measured = models.known(aggregate.regression_metrics(scored, "log_committed", "prediction"))
    marked.unpersist()
    return measured


@register("tree_fit")
def _(spark, sf):
    return _fit_and_measure(spark, sf, lambda: models.fit_tree("log_committed"))


@register("forest_fit")
def _(spark, sf):
    return _fit_and_measure(spark, sf, lambda: models.fit_forest("log_committed"))


# A tree of one split: the cut between two quantities that leaves the least squares.
_STUMP = (
    D + _LOG + f""", s AS (SELECT quantity AS q, count(*) AS n, sum(y) AS s FROM v GROUP BY 1),
    c AS (SELECT q, lead(q) OVER w AS next, sum(n) OVER w AS n_low, sum(s) OVER w AS s_low,
        sum(n) OVER () AS n_all, sum(s) OVER () AS s_all FROM s WINDOW w AS (ORDER BY q)),
    b AS (SELECT (q + next) / 2 AS cut, s_low / n_low AS low, (s_all - s_low) / (n_all - n_low) AS high FROM c
      WHERE next IS NOT NULL ORDER BY s_low * s_low / n_low + (s_all - s_low) * (s_all - s_low) / (n_all - n_low) DESC LIMIT 1)
    SELECT {_ID}, round(CASE WHEN quantity <= cut THEN low ELSE high END, 6) AS prediction FROM v, b"""
)


def _stump(spark, sf, make):
    df = _log_lines(spark, sf, "quantity")
    features, model = models.fit_model(df, models.hourly_features([], ["quantity"]), make, "log_committed")
    return models.predict(df, features, model, LINE_KEY).withColumn("prediction", F.round("prediction", 6))


@register("tree_of_one_split", _STUMP)
def _(spark, sf):
    return _stump(spark, sf, lambda: models.fit_tree("log_committed", max_depth=1))


@register("forest_of_whole_samples", _STUMP)
def _(spark, sf):
    """Trees that see all rows are equal, and so is their mean."""
    return _stump(spark, sf, lambda: models.fit_forest("log_committed", trees=5, max_depth=1, bootstrap=False))


_ERR = "l_extendedprice - l_quantity * 2000"


def _by_quantity(spark, sf):
    li = scan_table(spark, sf, "lineitem")
    return li.select(
        F.year("l_shipdate").alias("year"), "l_extendedprice", (F.col("l_quantity") * 2000).alias("prediction")
    )


_SCORES = f"""round(sqrt(avg(({_ERR}) * ({_ERR}))), 4) AS rmse, round(avg(abs({_ERR})), 4) AS mae,
  round(1 - sum(({_ERR}) * ({_ERR})) / (var_pop(l_extendedprice) * count(*)), 8) AS r2, count(*) AS n"""


@register(
    "metrics_round_trip",
    f"SELECT CAST(year(l_shipdate) AS INTEGER) AS year, {_SCORES} FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    measured = aggregate.regression_metrics(_by_quantity(spark, sf), "l_extendedprice", "prediction", ["year"])
    folder = shared_folder(spark)
    write_metrics(measured, folder)
    back = read_metrics(spark, folder, "year int, rmse double, mae double, r2 double, n long")
    return back.withColumns({"rmse": F.round("rmse", 4), "mae": F.round("mae", 4), "r2": F.round("r2", 8)})


@register(
    "model_card",
    f"""WITH s AS (SELECT {_SCORES} FROM lineitem)
    SELECT 'Modèle actif : LinearRegression' AS headline,
      format('R² = {{:.3f}} | RMSE = {{:.3f}} | MAE = {{:.3f}}', r2, rmse, mae) AS metrics,
      format('Entraîné sur {{:,}} projets | testé sur {{:,}} projets', CAST(n - ceil(n * 0.2) AS BIGINT),
        CAST(ceil(n * 0.2) AS BIGINT)) AS sizes, 2 AS n_features FROM s""",
)
def _(spark, sf):
    measured = aggregate.regression_metrics(_by_quantity(spark, sf), "l_extendedprice", "prediction").first()
    marked = splits.random_split(declarations(spark, sf, *LINE_KEY), LINE_KEY)
    sizes = marked.agg(F.count_if(~F.col("is_test")).alias("train"), F.count_if("is_test").alias("test")).first()
    meta = models.ModelMeta(
        "LinearRegression", measured["rmse"], measured["mae"], measured["r2"], sizes["train"], sizes["test"],
        ["quantity", "year"], [], ["quantity", "year"],
    )
    return models.model_card(meta.table(spark)).select("headline", "metrics", "sizes", "n_features")


@register(
    "best_scored_year",
    f"""SELECT CAST(year(l_shipdate) AS VARCHAR) AS model,
      round(1 - sum(({_ERR}) * ({_ERR})) / (var_pop(l_extendedprice) * count(*)), 8) AS score
      FROM lineitem GROUP BY 1 ORDER BY score DESC, model LIMIT 1""",
)
def _(spark, sf):
    rows = scan_table(spark, sf, "lineitem").select(
        F.year("l_shipdate").cast("string").alias("model"), "l_extendedprice",
        (F.col("l_quantity") * 2000).alias("prediction"),
    )
    scores = aggregate.regression_metrics(rows, "l_extendedprice", "prediction", ["model"])
    years = [str(y) for y in range(1995, 2002)]
    return models.select_best(scores.select("model", F.round("r2", 8).alias("score")), years)


@register(
    "promotion_against_champion",
    f"""WITH s AS (SELECT sqrt(avg(({_ERR}) * ({_ERR}))) AS a, stddev_pop(l_extendedprice) AS b FROM lineitem)
    SELECT 'by_quantity' AS candidate, round(a, 4) AS rmse,
      CASE WHEN a < b * 0.995 THEN 'champion' ELSE 'challenger' END AS alias FROM s
    UNION ALL SELECT 'by_mean', round(b, 4), CASE WHEN b < a * 0.995 THEN 'champion' ELSE 'challenger' END FROM s
    UNION ALL SELECT 'same', round(a, 4), 'challenger' FROM s
    UNION ALL SELECT 'alone', round(a, 4), 'champion' FROM s""",
)
def _(spark, sf):
    li = scan_table(spark, sf, "lineitem")
    by_quantity = aggregate.regression_metrics(
        li.select("l_extendedprice", (F.col("l_quantity") * 2000).alias("p")), "l_extendedprice", "p"
    ).select("rmse")
    mean = li.agg(F.avg("l_extendedprice")).scalar()
    by_mean = aggregate.regression_metrics(
        li.select("l_extendedprice", mean.alias("p")), "l_extendedprice", "p"
    ).select("rmse")
    cases = [
        ("by_quantity", by_quantity, by_mean),
        ("by_mean", by_mean, by_quantity),
        ("same", by_quantity, by_quantity),
        ("alone", by_quantity, None),
    ]
    parts = [
        models.promote(new, old).select(
            F.lit(name).alias("candidate"), F.round("rmse", 4).alias("rmse"), "alias"
        )
        for name, new, old in cases
    ]
    return reduce(DataFrame.unionByName, parts)


@register(
    "scored_requests",
    D + f""", v AS (SELECT {_ID}, financing, quantity, ln(1 + committed / 1000) AS y FROM d),
    c AS (SELECT regr_slope(y, quantity) AS a, regr_intercept(y, quantity) AS b FROM v),
    p AS (SELECT {_ID}, a * (CASE WHEN financing <> 'N' THEN quantity ELSE 0 END) + b AS p FROM v, c)
    SELECT {_ID}, round(p, 3) AS log_prediction, round(exp(p) - 1, 1) AS montant_keur,
      CASE WHEN exp(p) - 1 < 1000 THEN format('{{:,.0f}} K EUR', exp(p) - 1)
        ELSE format('{{:,.1f}} M EUR', (exp(p) - 1) / 1000) END AS montant_label,
      CASE WHEN p <= 1.792 THEN 'Petit (≤ 5 K EUR)' WHEN p <= 2.852 THEN 'Moyen (5 – 16 K EUR)'
        WHEN p <= 5.017 THEN 'Grand (16 – 150 K EUR)' ELSE 'Très grand (> 150 K EUR)' END AS tranche,
      round(exp(p - 0.9) - 1, 1) AS low, round(exp(p + 0.9) - 1, 1) AS high FROM p""",
)
def _(spark, sf):
    d = declarations(spark, sf, *LINE_KEY, "financing", "quantity", "committed")
    train = d.withColumn("y", F.log1p(F.col("committed") / 1000))
    features, model = models.fit_model(
        train, models.hourly_features([], ["quantity"]), lambda: models.fit_linear("y"), "y"
    )
    asked = d.select(*LINE_KEY, F.when(F.col("financing") != "N", F.col("quantity")).alias("quantity"))
    scored = score_batch(asked, features, model, 0.9, LINE_KEY)
    return scored.select(
        *LINE_KEY, "log_prediction", "montant_keur", "montant_label", "tranche",
        F.col("fourchette_keur.low").alias("low"), F.col("fourchette_keur.high").alias("high"),
    )


def _training_lines(spark, sf):
    return _log_lines(
        spark, sf, "signed", "quantity", "year", "financing", "country", "region", "sector", "agency", "channel"
    )


@register("models_compared_and_selected")
def _(spark, sf):
    df = _training_lines(spark, sf)
    trained = train_and_select(
        df, "log_committed", LINE_KEY, line_order("signed", *LINE_KEY), exclude=["signed"]
    )
    card = models.model_card(trained.meta.table(spark))
    return card.select("headline", "metrics", "sizes", F.lit(trained.meta.cv_scores[trained.meta.model]).alias("cv_r2"))


@register("tracked_forest")
def _(spark, sf):
    trained = train_forest_tracked(
        _training_lines(spark, sf), "log_committed", LINE_KEY, exclude=["signed"], max_depth=DEPTH
    )
    one = trained.meta.table(spark)
    return one.select("rmse", "mae", "r2", "train_size", "test_size", "cat_low", "cat_high").withColumn(
        "cv_rmse", F.lit(trained.scores.first()["rmse_mean"])
    )
