"""Encoders, splits, folds, models, selection and scoring."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from guichet import vocabulary as V
from guichet.operators import encode, models, settle, splits
from guichet.operators.aggregate import dataset_stats, regression_metrics
from guichet.plans.scoring import describe_prediction, score_batch
from guichet.plans.training import train_and_select, train_forest_tracked


def rows(df):
    return [tuple(r) for r in df.collect()]


# Encoders ------------------------------------------------------------------------


def test_one_hot(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("c", 4)], "c string, x int")
    first = encode.one_hot_drop_first(df, ["c"])
    assert first.columns == ["x", "c_b", "c_c"]
    assert rows(first) == [(1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 0, 1)]
    known = encode.fit_categories(df.where("c <> 'c'"), ["c"])
    assert rows(encode.one_hot_ignore(df, ["c"], known)) == [(1, 0, 1), (2, 1, 0), (3, 0, 0), (4, 0, 0)]


@pytest.mark.parametrize("distributed", [False, True])
def test_one_hot_vectors(spark, distributed, request):
    if distributed:
        request.getfixturevalue("small_broadcasts")
    data = [("b", "y", 1.5), ("a", None, 0.0), (None, "x", -2.0), ("c", "z", 4.0)]
    df = spark.createDataFrame(data, "c string, `d d` string, n double")
    fitted, size = encode.fit_one_hot(df, ["d d", "c"])
    assert size == 6
    assert {(r["column"], r["value"]): r["position"] for r in fitted.collect()} == {
        ("d d", "x"): 0, ("d d", "y"): 1, ("d d", "z"): 2, ("c", "a"): 3, ("c", "b"): 4, ("c", "c"): 5
    }
    new = spark.createDataFrame([*data, ("new", "x", 7.0)], df.schema)
    got = {r["n"]: r["features"].toArray().tolist() for r in encode.one_hot_vector(new, ["d d", "c"], fitted, size, [F.col("n"), F.col("n") * 2], ["n"]).collect()}
    assert got == {
        1.5: [1.5, 3.0, 0, 1, 0, 0, 1, 0], 0.0: [0, 0, 0, 0, 0, 1, 0, 0], -2.0: [-2, -4, 1, 0, 0, 0, 0, 0],
        4.0: [4, 8, 0, 0, 1, 0, 0, 1], 7.0: [7, 14, 1, 0, 0, 0, 0, 0],
    }
    fitted, size = encode.fit_one_hot(df, ["c", "d d"], drop_first=True)
    assert size == 4
    assert {r["value"]: r["position"] for r in fitted.collect()} == {"b": 0, "c": 1, "y": 2, "z": 3}
    none, size = encode.fit_one_hot(df.where("n > 100"), ["c", "d d"], drop_first=True)
    assert size == 0 and none.count() == 0


def test_one_hot_of_many_categories(spark, small_broadcasts):
    df = spark.range(5000).select(F.concat(F.lit("v"), F.format_string("%05d", "id")).alias("c"), (F.col("id") % 7).cast("string").alias("d"), "id")
    fitted, size = encode.fit_one_hot(df, ["c", "d"])
    assert size == 5007
    out = encode.one_hot_vector(df, ["c", "d"], fitted, size, [], ["id"])
    assert all(r["features"].indices.tolist() == [r["id"], 5000 + r["id"] % 7] for r in out.collect())


def test_feature_vector_equals_feature_columns(spark):
    data = [("b", 2020, None, 1, 0.5), ("a", 2021, 3, 0, 0.7), (None, None, 5, 1, 0.9)]
    df = spark.createDataFrame(data, "`Région` string, y int, m int, FTC int, target double")
    asked = ["Région", "Secteur"], ["y", "m", "zz"], ["FTC", "Genre"], ["target"]
    wide = encode.feature_frame(df, *asked).select("target", "y", "m", "FTC", "Région_b")
    vectors = encode.feature_frame(df, *asked, vector="all")
    assert [(r["target"], *r["all"].toArray()) for r in vectors.collect()] == rows(wide)


@pytest.mark.parametrize("make", [models.fit_linear, models.fit_tree])
def test_models_take_sparse_vectors(spark, make):
    rng = np.random.default_rng(3)
    data = [(f"c{rng.integers(0, 6)}", float(rng.normal()), float(rng.normal())) for _ in range(400)]
    df = spark.createDataFrame(data, "c string, n double, e double").withColumn("y", F.col("n") * 3 + F.length("c") + F.substring("c", 2, 1).cast("double") + F.col("e") / 10)
    features = models.FittedFeatures(numbers=["n"], one_hot=["c"])
    features.places, features.width = encode.fit_one_hot(df, ["c"], drop_first=True)
    model = make("y").fit(features.transform(df, ["y"]))
    wide = encode.one_hot_drop_first(df, ["c"])
    from pyspark.ml.feature import VectorAssembler

    plain = VectorAssembler(inputCols=["n", *[c for c in wide.columns if c.startswith("c_")]], outputCol="features").transform(wide)
    want = make("y").fit(plain).transform(plain).orderBy("y").select("prediction")
    got = model.transform(features.transform(df, ["y"])).orderBy("y").select("prediction")
    assert [r[0] for r in got.collect()] == pytest.approx([r[0] for r in want.collect()], rel=1e-9)


@pytest.mark.parametrize("n", [1, 5])
def test_large_dictionaries_are_looked_up_together(spark, small_broadcasts, monkeypatch, n):
    """However many columns there are, the table is written once and one join meets the dictionary."""
    names = [f"c{i}" for i in range(n)]
    df = spark.range(300).select("id", *[(F.col("id") % (i + 3)).cast("string").alias(c) for i, c in enumerate(names)])
    fitted = encode.fit_ordinal(df, names)
    written, joined = [], []
    monkeypatch.setattr(encode, "stage", lambda d, f=encode.stage: (written.append(d), f(d))[1])
    monkeypatch.setattr(encode, "attach", lambda *a, f=encode.attach: (joined.append(a), f(*a))[1])
    out = encode.ordinal_encode(df, names, fitted)
    assert len(written) == 2 and len(joined) == 1
    assert all(all(r[c] == r["id"] % (i + 3) for i, c in enumerate(names)) for r in out.collect())


def test_ordinal_codes(spark, small_broadcasts):
    df = spark.createDataFrame([("é", "x"), ("z", "y"), ("A", None), ("a", "x")], "c string, d string")
    fitted = encode.fit_ordinal(df, ["c", "d"])
    new = spark.createDataFrame([("a", "y"), ("new", None), ("é", "x")], "c string, d string")
    got = sorted(rows(encode.ordinal_encode(new, ["c", "d"], fitted)))
    # Code points: A < a < z < é.
    assert got == [(-1.0, -1.0), (1.0, 1.0), (3.0, 0.0)]


def _sklearn_like(categories, y):
    """Smoothed means by the published formula, on plain arrays."""
    out, mean, var = {}, y.mean(), y.var()
    for c in set(categories):
        part = y[categories == c]
        weight = var * len(part) / (var * len(part) + part.var())
        out[c] = weight * part.mean() + (1 - weight) * mean
    return out


def test_target_encoding(spark):
    rng = np.random.default_rng(5)
    cats = np.array([f"c{v}" for v in rng.integers(0, 8, 500)])
    y = rng.normal(100, 5, 500) + np.array([int(c[1:]) for c in cats])
    fold = rng.integers(0, 5, 500)
    df = spark.createDataFrame(
        [(i, str(c), float(v), int(f)) for i, (c, v, f) in enumerate(zip(cats, y, fold))],
        "i int, c string, y double, fold int",
    )
    fitted, mean = encode.fit_target(df, ["c"], "y", "fold")
    assert mean == pytest.approx(y.mean())
    want = _sklearn_like(cats, y)
    new = spark.createDataFrame([("c1",), ("unseen",), (None,)], "c string")
    got = [r[0] for r in encode.target_encode(new, ["c"], fitted, mean).collect()]
    assert got == pytest.approx([want["c1"], y.mean(), y.mean()])
    out = encode.target_encode(df, ["c"], fitted, mean, "fold").orderBy("i").collect()
    for f in range(5):
        without = _sklearn_like(cats[fold != f], y[fold != f])
        for r in out:
            if r["fold"] == f:
                assert r["c"] == pytest.approx(without[cats[r["i"]]])


def test_out_of_fold_encoding_ignores_the_own_target(spark):
    data = [(i, f"c{i % 3}", float(i % 7), i % 4) for i in range(40)]
    df = spark.createDataFrame(data, "i int, c string, y double, fold int")
    changed = df.withColumn("y", F.when(F.col("i") == 5, 1000.0).otherwise(F.col("y")))

    def encoded(d):
        fitted, mean = encode.fit_target(d, ["c"], "y", "fold")
        return {r["i"]: r["c"] for r in encode.target_encode(d, ["c"], fitted, mean, "fold").collect()}

    a, b = encoded(df), encoded(changed)
    same_fold = [i for i, _, _, f in data if f == 5 % 4]
    assert all(a[i] == pytest.approx(b[i]) for i in same_fold)
    assert any(a[i] != pytest.approx(b[i]) for i in a if i not in same_fold)


def test_category_of_one_fold_gets_the_mean_of_the_others(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 3.0, 0), ("b", 5.0, 1), ("b", 6.0, 1)], "c string, y double, fold int")
    fitted, mean = encode.fit_target(df, ["c"], "y", "fold")
    got = {r["y"]: r["c"] for r in encode.target_encode(df, ["c"], fitted, mean, "fold").collect()}
    assert got == pytest.approx({1.0: 5.5, 3.0: 5.5, 5.0: 2.0, 6.0: 2.0})


def test_imputers(spark):
    df = spark.createDataFrame([(1.0, "a", None), (None, "b", None), (4.0, None, "x"), (10.0, "b", "x")],
                               "n double, c string, d string")
    assert [r["n"] for r in encode.impute_median(df, ["n"]).collect()] == [1.0, 4.0, 4.0, 10.0]
    assert [r["c"] for r in encode.impute_mode(df, ["c"]).collect()] == ["a", "b", "b", "b"]
    assert [r["d"] for r in encode.impute_constant(df, ["d"]).collect()] == ["inconnu", "inconnu", "x", "x"]
    train = df.where("n < 5")
    assert [r["n"] for r in encode.impute_median(df, ["n"], fit_on=train).collect()] == [1.0, 2.5, 4.0, 10.0]


def test_numbers_without_values_stay_null(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None)], "i int, n double, c string")
    assert [r["n"] for r in encode.impute_median(df, ["n"]).collect()] == [None, None]
    assert rows(encode.feature_frame(df, ["c"], ["n", "i"], [], [])) == [(None, 1.0), (None, 2.0)]
    assert [r["v"].toArray().tolist() for r in encode.feature_frame(df, ["c"], ["n", "i"], [], [], "v").collect()] == [[0.0, 1.0], [0.0, 2.0]]


def test_feature_frame(spark):
    data = [("b", 2020, None, 1, 0.5), ("a", 2021, 3, 0, 0.7), (None, None, 5, 1, 0.9)]
    df = spark.createDataFrame(data, "`Région` string, y int, m int, FTC int, target double")
    out = encode.feature_frame(df, ["Région", "Secteur"], ["y", "m", "zz"], ["FTC", "Genre"], ["target"])
    assert out.columns == ["target", "Région_b", "y", "m", "FTC"]
    assert rows(out) == [(0.5, 1, 2020.0, 4.0, 1), (0.7, 0, 2021.0, 3.0, 0), (0.9, 0, 2020.5, 5.0, 1)]


# Splits --------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 4, 5, 101, 1000])
def test_random_split_sizes(spark, n):
    df = spark.range(n)
    marked = splits.random_split(df, ["id"], 0.2, 7)
    assert marked.count() == n
    assert marked.where("is_test").count() == math.ceil(n * 0.2)
    train, test = marked.where("not is_test"), marked.where("is_test")
    assert train.join(test, "id").count() == 0
    assert splits.union_splits(train, test).count() == n


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("s"))
    marks = []
    for n in (1, 4, 9):
        marked = splits.stratified_split(df.repartition(n), ["s"], ["id"])
        marks.append(sorted(rows(marked.select("id", "is_test"))))
    assert marks[0] == marks[1] == marks[2]
    other = splits.stratified_split(df, ["s"], ["id"], seed=43)
    assert sorted(rows(other.select("id", "is_test"))) != marks[0]


def test_stratified_sizes(spark):
    sizes = {"a": 667, "b": 101, "c": 5, None: 30}
    data = [(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(data, "id string, k string")
    marked = splits.stratified_split(df, ["k"], ["id"])
    got = {r["k"]: (r["n"], r["t"]) for r in marked.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert {k: v[0] for k, v in got.items()} == sizes
    assert sum(v[1] for v in got.values()) == math.ceil(803 * 0.2)
    assert all(abs(v[1] - v[0] * 0.2) < 1 for v in got.values())
    stats = dataset_stats(marked.withColumn("y", F.lit(0.5)), "y", "is_test", 3).first()
    assert tuple(stats) == (803, 3, 642, 161, 0.5, 0.5)


def test_decile_split(spark):
    df = spark.range(1000).select("id", (F.col("id") * F.col("id") / 7.0).alias("y"))
    marked = splits.decile_split(df, "y", ["id"])
    per_decile = marked.groupBy(F.floor((F.col("id")) / 100).alias("d")).agg(F.count_if("is_test").alias("t"))
    assert {r["t"] for r in per_decile.collect()} <= {19, 20, 21}
    assert marked.where("is_test").count() == 200


@pytest.mark.parametrize("ranked", [2, 40])
def test_cuts_are_narrowed_digit_by_digit(spark, monkeypatch, ranked):
    df = spark.range(3000).select(F.floor(F.col("id") / 2).alias("id"), (F.col("id") % 3).alias("s"), (F.col("id") % 97).cast("double").alias("y"))

    def marks():
        tables = splits.random_split(df, ["id"]), splits.stratified_split(df, ["s"], ["id"]), splits.decile_split(df, "y", ["id"])
        return [sorted(map(tuple, t.collect())) for t in tables]

    want = marks()
    monkeypatch.setattr(splits, "_PREFIX", 1)
    monkeypatch.setattr(splits, "RANKED", ranked)
    assert marks() == want
    monkeypatch.setattr(splits, "RANKED", 0)  # to the last digit
    monkeypatch.setattr(splits, "_PREFIX", 8)
    assert marks() == want


def test_splits_run_their_source_once_and_for_the_result(spark):
    from guichet.operators import encode

    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("s"), F.col("id").cast("double").alias("y"))
    df = df.mapInArrow(watch, df.schema)
    for make in (
        lambda: splits.random_split(df, ["id"]), lambda: splits.stratified_split(df, ["s"], ["id"]), lambda: splits.decile_split(df, "y", ["id"]),
        lambda: encode.feature_frame(df, ["s"], ["y"], [], ["id"]), lambda: encode.feature_frame(df, ["s"], ["y"], [], ["id"], "v"),
    ):
        before = seen.value
        marked = make()
        assert seen.value - before == 1000
        assert len(marked.collect()) == 1000
        assert seen.value - before == 2000


@pytest.mark.parametrize("n,k", [(23, 5), (10, 5), (3, 5), (100, 7)])
def test_folds_are_contiguous(spark, n, k):
    df = spark.range(n).repartition(4)
    got = [r["fold"] for r in splits.kfold(df, k, [F.col("id")]).orderBy("id").collect()]
    want = [i for i, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]
    assert got == want


# Models --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def projects(spark):
    rng = np.random.default_rng(3)
    n = 600
    agency = rng.integers(0, 20, n)
    kind = rng.integers(0, 3, n)
    year = rng.integers(2015, 2021, n)
    y = 0.3 * agency + 2.0 * (kind == 1) + 0.1 * (year - 2015) + rng.normal(0, 0.3, n)
    pdf = pd.DataFrame({
        "id": np.arange(n), "agency": [f"a{v:02d}" for v in agency], "kind": [f"k{v}" for v in kind],
        "year": year, "Genre": rng.integers(0, 2, n), "log_y": y,
    })
    return spark.createDataFrame(pdf).cache()


def test_models_learn(projects):
    marked = splits.random_split(projects, ["id"])
    fit = models.hourly_features(["agency", "kind"], ["year"])
    scores = {}
    for name, make in models.candidates("log_y", trees=10).items():
        features, model = models.fit_model(marked.where("not is_test"), fit, make, "log_y")
        scored = models.predict(marked.where("is_test"), features, model, ["log_y"])
        scores[name] = regression_metrics(scored, "log_y", "prediction").first()["r2"]
    assert scores["LinearRegression"] > 0.6
    assert scores["DecisionTreeRegressor"] > 0.85 and scores["RandomForestRegressor"] > 0.85


def test_cross_validation_scores_every_row_once(projects):
    folded = splits.kfold(projects, 3, [F.col("id")])
    makers = {"t": lambda: models.fit_tree("log_y"), "l": lambda: models.fit_linear("log_y")}
    scores = models.cross_validate(
        folded, models.hourly_features(["agency", "kind"], ["year"]), makers, "log_y", "fold", 3
    )
    assert sorted((r["model"], r["fold"], r["n"]) for r in scores.collect()) == [
        (m, f, 200) for m in ("l", "t") for f in range(3)
    ]


@pytest.fixture
def odd_folds(spark):
    """Values that one fold alone has, nulls, a column without values and a constant one."""
    pick = np.random.default_rng(8)
    data = [
        (i, i % 4, [None, "a", "b", f"only{i % 4}"][pick.integers(0, 4)], None if i % 5 == 0 else float(pick.normal(2000, 3)), None, 7.0,
         float(pick.normal()) if i % 11 else None)
        for i in range(600)
    ]
    return spark.createDataFrame(data, "i int, fold int, c string, n double, none double, one double, y double")


# Spark solves systems with constant columns iteratively, to its tolerance.
@pytest.mark.parametrize("numbers, rel", [(["n"], 1e-9), (["n", "one", "none"], 1e-5)])
@pytest.mark.parametrize("distributed", [False, True])
def test_linear_folds_equal_separate_fits(spark, odd_folds, distributed, numbers, rel, request, monkeypatch):
    if distributed:
        request.getfixturevalue("small_broadcasts")
    df = odd_folds.where("y IS NOT NULL")
    fit = models.hourly_features(["c"], numbers)
    makers = {"l": lambda: models.fit_linear("y")}
    at_once = models.cross_validate(odd_folds, fit, makers, "y", "fold", 4)
    monkeypatch.setattr(models.folds, "MOST_FEATURES", 0)
    apart = models.cross_validate(df, fit, makers, "y", "fold", 4)
    for a, b in zip(at_once.orderBy("fold").collect(), apart.orderBy("fold").collect()):
        assert tuple(a)[:2] == tuple(b)[:2] and a["n"] == b["n"]
        assert [a[c] for c in ("rmse", "mae", "r2")] == pytest.approx([b[c] for c in ("rmse", "mae", "r2")], rel=rel)


@pytest.mark.parametrize("distributed", [False, True])
def test_encoders_of_all_folds_equal_separate_fits(spark, odd_folds, distributed, request):
    if distributed:
        request.getfixturevalue("small_broadcasts")
    fit = models.hourly_features(["c"], ["n", "none"])
    for i, got in enumerate(fit.of_folds(odd_folds, "fold", 4)):
        want = fit(odd_folds.where(F.col("fold") != i))
        assert got.medians == want.medians
        assert sorted(map(tuple, got.codes.select("column", "value", "code").collect())) == sorted(
            map(tuple, want.codes.select("column", "value", "code").collect())
        )


def test_best_model_and_ties(spark):
    scores = spark.createDataFrame(
        [("RandomForestRegressor", 0.5), ("LinearRegression", 0.5), ("DecisionTreeRegressor", 0.4)], "model string, score double"
    )
    assert models.select_best(scores).first()["model"] == "LinearRegression"


def test_promotion_margin_is_strict(spark):
    def table(rmse):
        return spark.createDataFrame([(rmse,)], "rmse double")

    def alias(new, old):
        return models.promote(table(new), old).first()["alias"]

    assert alias(9.0, None) == "champion"
    assert alias(9.0, table(1.0).where("rmse < 0")) == "champion"
    assert alias(0.994, table(1.0)) == "champion"
    assert alias(0.995, table(1.0)) == "challenger"
    assert alias(2.0, table(1.0)) == "challenger"


def test_hourly_training(projects):
    trained = train_and_select(projects, "log_y", ["id"], [F.col("id")], k=3, trees=5)
    assert trained.meta.model in ("DecisionTreeRegressor", "RandomForestRegressor")
    assert (trained.meta.train_size, trained.meta.test_size) == (480, 120)
    assert trained.meta.cat_cols == ["agency", "kind"] and trained.meta.num_cols == ["year", "Genre"]
    # Measured on rows it was fitted on, against a fit without them.
    assert trained.meta.r2 > trained.holdout.first()["r2"] > 0.8


def test_tracked_training_and_scoring(spark, projects, tmp_path):
    champion = spark.createDataFrame([(100.0,)], "rmse double")
    trained = train_forest_tracked(
        projects, "log_y", ["id"], champion=champion, trees=5, max_depth=6, k=3, min_samples_leaf=2
    )
    assert trained.meta.cat_low == ["kind", "Genre"] and trained.meta.cat_high == ["agency"]
    assert trained.meta.num_cols == ["year"]
    assert trained.promotion.first()["alias"] == "champion"
    assert trained.meta.r2 > 0.8 and trained.scores.first()["r2_mean"] > 0.7
    domains = {r["column"]: r["values"] for r in trained.dropdowns.collect()}
    assert domains["kind"] == ["k0", "k1", "k2"] and domains["Genre"] == ["0", "1"]

    requests = spark.createDataFrame([(1, "a03", "k1"), (2, "unseen", None)], "id int, agency string, kind string")
    before = rows(score_batch(requests, trained.features, trained.model, 0.5, ["id"]).orderBy("id"))
    folder = str(tmp_path / "model")
    models.save_model(folder, trained.meta.model, trained.features, trained.model, spark)
    features, model = models.load_model(folder, trained.meta.model, spark)
    assert rows(score_batch(requests, features, model, 0.5, ["id"]).orderBy("id")) == before


def test_request_defaults(spark):
    df = spark.createDataFrame([(1, None, "x")], "id int, n int, t string")
    out = models.with_request_defaults(df, ["n", "absent_n"], ["t", "absent_t"])
    assert out.first().asDict() == {"id": 1, "n": 0.0, "absent_n": 0.0, "t": "x", "absent_t": None}


def test_described_predictions(spark):
    logs = [1.792, 2.852, 5.017, 5.0171, math.log1p(999.4), math.log1p(1500.0)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(logs)], "i int, p double")
    out = describe_prediction(df, "p", 1.5).orderBy("i").collect()
    assert [r["tranche"] for r in out[:4]] == V.BAND_LABELS
    assert out[4]["montant_label"] == "999 K EUR" and out[5]["montant_label"] == "1.5 M EUR"
    assert out[0]["log_prediction"] == 1.792
    assert out[0]["fourchette_keur"]["low"] == round(math.expm1(1.792 - 1.5), 1)
    assert out[0]["fourchette_keur"]["high"] == round(math.expm1(1.792 + 1.5), 1)


def test_compared_forests_have_all_their_trees(spark, monkeypatch):
    from guichet.catalogue import QUERIES, models as catalogue
    from guichet.plans import training

    class Called(Exception):
        pass

    def called(label, trees=100, **_):
        raise Called(trees)

    # The number that reaches the candidates is what every fold and the final fits use.
    monkeypatch.setattr(training, "candidates", called)
    with pytest.raises(Called) as seen:
        QUERIES["models_compared_and_selected"](spark, "/root/testdata/sf0.001")
    assert catalogue.train_and_select is training.train_and_select and seen.value.args == (100,)


def test_scratch_tables_are_deleted_after_a_job(spark, projects, tmp_path):
    import os

    from guichet.session import ensure_checkpoint_dir, scratch

    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")

    def held():
        return {n for n in os.listdir(folder) if n.startswith(("table-", "rdd-"))}

    before = held()
    with scratch(spark):
        trained = train_and_select(projects, "log_y", ["id"], [F.col("id")], exclude=["Genre"], k=2, trees=2)
        models.save_model(str(tmp_path), trained.meta.model, trained.features, trained.model, spark)
        assert held() > before
    assert held() <= before
    with pytest.raises(ZeroDivisionError), scratch(spark):
        encode.ordinal_encode(projects, ["agency"]).count()
        assert held() > before
        1 / 0
    assert held() <= before
    features, model = models.load_model(str(tmp_path), trained.meta.model, spark)
    assert models.predict(projects, features, model, ["id"]).count() == 600


def test_medians_are_fitted_on_a_copy(spark, monkeypatch):
    """The passes of the fit read the copy, not the join behind the table."""
    left = spark.createDataFrame([(1, "a", 1.0), (2, None, None), (3, "a", 4.0)], "i int, c string, n double")
    df = left.join(spark.range(1, 4).select(F.col("id").cast("int").alias("i")).hint("merge"), "i")
    plans, fit = [], encode.fit_medians

    def noted(given, *rest):
        plans.append(given._jdf.queryExecution().optimizedPlan().toString())
        return fit(given, *rest)

    monkeypatch.setattr(encode, "fit_medians", noted)
    assert sorted(r["n"] for r in encode.impute_median(df, ["n"]).collect()) == [1.0, 2.5, 4.0]
    assert plans and "Join" not in plans[0]


def test_tasks_of_long_look_ups_are_bounded_by_rows(spark, small_broadcasts, monkeypatch):
    """Packed bytes say little of what a task sorts: it gets about as many rows as it is to have."""
    monkeypatch.setattr(settle, "TASK_ROWS", 100, raising=False)
    df = spark.range(4000).select("id", F.col("id").cast("string").alias("name"))
    fitted = settle.stage(df.where("id % 2 = 0").select("name", F.col("id").alias("code")))
    joined = settle.stage(settle.attach(df, fitted, ["name"]).withColumn("task", F.spark_partition_id()))
    assert joined.where("code <=> if(id % 2 = 0, id, null)").count() == 4000
    assert joined.groupBy("task").count().agg(F.max("count")).first()[0] < 250

    places, size = encode.fit_one_hot(df, ["name"])
    found = settle.stage(encode.one_hot_positions(df, ["name"], places).withColumn("task", F.spark_partition_id()))
    assert size == 4000 and found.select(F.explode("positions")).distinct().count() == 4000
    assert found.groupBy("task").count().agg(F.max("count")).first()[0] < 250
