"""Encoders and imputers: each one is fitted to a small table and joined back.

A fitted encoder has one row per category (and fold), far fewer than the data. It is
broadcast while its counted size allows, otherwise joined by shuffle with hot
categories handled apart (see ``settle.attach``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from guichet import vocabulary as V
from guichet.functions.numbers import finite
from guichet.functions.text import map_columns, quoted
from guichet.operators.profile import column_values, median, most_frequent
from guichet.operators.ranks import number_rows
from guichet.operators.settle import attach, by_key, is_small, large_parts, settle, stage


def impute_constant(df: DataFrame, names: Sequence[str], value: str = V.MISSING_CATEGORY) -> DataFrame:
    return map_columns(df, names, lambda c: F.coalesce(c, F.lit(value)))


def impute_values(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill the nulls of each column with its own fitted value."""
    known = {c: v for c, v in values.items() if v is not None}
    return df.select(
        *[F.coalesce(quoted(c), F.lit(known[c])).alias(c) if c in known else quoted(c) for c in df.columns]
    )


def fit_medians(df: DataFrame, names: Sequence[str], empty: float | None = 0.0) -> dict[str, float | None]:
    """Median per column, one scalar each; a column without values gets ``empty``."""
    if not names:
        return {}
    found = {row["column"]: row["value"] for row in median(df, names).collect()}
    return {c: found.get(c, empty) for c in names}


def fit_modes(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column, one scalar each."""
    if not names:
        return {}
    return {row["column"]: row["value"] for row in most_frequent(df, names).collect()}


def impute_median(df: DataFrame, names: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Medians in place of nulls and NaN; a column without values stays null.

    The passes of the fit read a copy of its columns, so the table is run once for them.
    """
    numbers = map_columns(df, names, finite)
    known = (df if fit_on is None else fit_on).select(*[quoted(c) for c in names])
    return impute_values(numbers, fit_medians(stage(known) if names else known, names, None))


def impute_mode(df: DataFrame, names: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    return impute_values(df, fit_modes(df if fit_on is None else fit_on, names))


def fit_categories(df: DataFrame, names: Sequence[str]) -> dict[str, list[str]]:
    """Sorted categories per column, for results with a column per category.

    Such a result is as wide as there are categories, so this is for short lists; ``fit_one_hot``
    and ``one_hot_vector`` take any number.
    """
    if not names:
        return {}
    found: dict[str, list[str]] = {c: [] for c in names}
    for row in column_values(df, names).select("column", "value").orderBy("column", "value").collect():
        found[row["column"]].append(row["value"])
    return found


def one_hot_columns(categories: Mapping[str, Sequence[str]], drop_first: bool = False) -> list[Column]:
    """0/1 columns ``name_value``; a null or unseen category is all 0."""
    return [
        F.coalesce((quoted(c).cast("string") == v).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c, values in categories.items()
        for v in list(values)[1 if drop_first else 0 :]
    ]


def one_hot_drop_first(
    df: DataFrame, names: Sequence[str], categories: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    return _one_hot(df, names, categories, True)


def one_hot_ignore(
    df: DataFrame, names: Sequence[str], categories: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    return _one_hot(df, names, categories, False)


def _one_hot(df, names, categories, drop_first) -> DataFrame:
    categories = fit_categories(df, names) if categories is None else categories
    rest = [quoted(c) for c in df.columns if c not in names]
    return df.select(*rest, *one_hot_columns(categories, drop_first))


def fit_one_hot(df: DataFrame, names: Sequence[str], drop_first: bool = False) -> tuple[DataFrame, int]:
    """((column, value, position), number of positions): a place per category in one vector.

    The columns follow each other in the order given, each with its categories in order. Without its
    first category a column has one place less. A table, so the categories may be any number.
    """
    values = column_values(df, names).select("column", "value")
    column = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("column")).alias("_nth")
    numbered, n = number_rows(stage(values.select(column, "column", "value")), [F.col("_nth"), F.col("value")])
    if not drop_first:
        return stage(numbered.select("column", "value", "position")), n
    # One row per column.
    starts = numbered.groupBy("column").agg(F.min("position").alias("_start"))
    before = Window.partitionBy(F.lit(1)).orderBy("_start")
    starts = settle(starts.withColumn("_dropped", F.row_number().over(before)))
    kept = attach(numbered, starts, ["column"]).where("position > _start")
    places = stage(kept.select("column", "value", (F.col("position") - F.col("_dropped")).alias("position")))
    return places, n - starts.count()


def one_hot_positions(df: DataFrame, names: Sequence[str], fitted: DataFrame, out: str = "positions") -> DataFrame:
    """``df`` with the positions of its categories, ascending, in place of the columns.

    Null and unseen categories have none.
    """
    found = _look_up(df, names, fitted, "position", F.lit(None).cast("long"))
    places = F.array_sort(F.array_compact(F.array(*[quoted(c) for c in names])))
    return found.select(*[quoted(c) for c in df.columns if c not in names], places.alias(out))


def sparse_vector(size: int, indices: Column, values: Column) -> Column:
    """A sparse ML vector from its parts; ``indices`` ascend."""
    # A vector's plain form is a struct; 0 marks a sparse one.
    plain = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"),
        indices.cast("array<int>").alias("indices"), values.cast("array<double>").alias("values"),
    )
    kind = StructType([StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(plain.alias("v"))), kind)["v"]


def one_hot_vector(
    df: DataFrame, names: Sequence[str], fitted: DataFrame, size: int,
    numbers: Sequence[Column] = (), keep: Sequence[str] = (), out: str = "features",
) -> DataFrame:
    """The kept columns and a sparse vector: ``numbers`` first, then a 1 per category.

    As wide as the dictionary, yet a row holds its own categories only. ``numbers`` are not null.
    """
    m = len(numbers)
    named = [c.cast("double").alias(f"_x{i}") for i, c in enumerate(numbers)]
    kept = [quoted(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    rows = one_hot_positions(df.select(*[quoted(c) for c in names], *kept, *named), names, fitted, "_places")
    ones = F.transform("_places", lambda _: F.lit(1.0))
    indices = F.transform("_places", lambda p: (p + m).cast("int"))
    if m:
        indices = F.concat(F.array(*[F.lit(i) for i in range(m)]), indices)
        ones = F.concat(F.array(*[F.col(f"_x{i}") for i in range(m)]), ones)
    shown = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    return rows.select(*shown, sparse_vector(m + size, indices, ones).alias(out))


def fit_ordinal(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, value, code): codes 0, 1, … in the order of the values of a column."""
    values = stage(column_values(df, names).select("column", "value"))
    if is_small(values):
        nth = F.row_number().over(Window.partitionBy("column").orderBy("value"))
        return values.withColumn("code", (nth - 1).cast("double"))
    numbered, _ = number_rows(values, [F.col("column"), F.col("value")])
    starts = settle(numbered.groupBy("column").agg(F.min("position").alias("_start")))
    coded = attach(numbered, starts, ["column"])
    return stage(
        coded.select("column", "value", (F.col("position") - F.col("_start")).cast("double").alias("code"))
    )


def ordinal_encode(
    df: DataFrame, names: Sequence[str], fitted: DataFrame | None = None, unseen: int = -1
) -> DataFrame:
    """Each column replaced by its code; values not in the dictionary give ``unseen``."""
    fitted = fit_ordinal(df, names) if fitted is None else fitted
    return _look_up(df, names, fitted, "code", F.lit(float(unseen)))


def _look_up(df, names, fitted, result, default, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with what ``fitted`` has for the values of the named columns in their place.

    A column's dictionary is broadcast if it is small. All columns with a large one are looked up
    together.
    """
    shown = list(df.columns)
    large = large_parts(fitted, "column")
    for name in [c for c in names if c not in large]:
        side = fitted.where(F.col("column") == name).select(
            F.col("value").alias("_value"), *by, F.col(result).alias("_found")
        )
        joined = attach(df.withColumn("_value", quoted(name).cast("string")), side, ["_value", *by], True)
        df = joined.select(
            *[
                F.coalesce("_found", default).alias(c) if c == name else quoted(c)
                for c in shown
            ]
        )
    together = [c for c in names if c in large]
    return _look_up_together(df, together, fitted, result, default, by) if together else df


def _look_up_together(df, names, fitted, result, default, by) -> DataFrame:
    """The table is written once and its values, a row each, meet the whole dictionary in one join;
    what they find goes back to its row by number."""
    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()))
    nth = {c: f"_c{i}" for i, c in enumerate(names)}
    values = rows.select("_row", *by, *[quoted(c).cast("string").alias(nth[c]) for c in names]).unpivot(
        ["_row", *by], list(nth.values()), "_nth", "_value"
    )
    code = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(nth[c]))])
    side = fitted.where(F.col("column").isin(names)).select(
        code[F.col("column")].alias("_nth"), F.col("value").alias("_value"), *by, F.col(result).alias("_found")
    )
    found = attach(values.where("_value IS NOT NULL"), stage(side), ["_nth", "_value", *by], False)
    n = rows.count()
    packed = by_key(found.where("_found IS NOT NULL"), ["_row"], n).groupBy("_row").agg(
        *[F.max(F.when(F.col("_nth") == nth[c], F.col("_found"))).alias(f"_found{nth[c]}") for c in names]
    )
    back = {c: F.coalesce(f"_found{nth[c]}", default).alias(c) for c in names}
    return by_key(rows, ["_row"], n).join(packed, "_row", "left").select(*[back[c] if c in back else quoted(c) for c in df.columns])


def fit_target(
    df: DataFrame, names: Sequence[str], target: str, fold: str | None = None
) -> tuple[DataFrame, float]:
    """(column, value, fold, encoding) and the mean of the target.

    The mean target of a category, shrunk to the overall mean by the ratio of the
    variances within and between (Micci-Barreca 2001). Rows with a null ``fold``
    hold the encoding of all rows; the others leave out the fold they name, by
    taking the fold's sums from the totals, so no row sees its own target.
    """
    y = finite(quoted(target))
    center = df.agg(F.avg(y)).first()[0] or 0.0
    moved = y - center
    folded = quoted(fold).cast("int") if fold else F.lit(None).cast("int")
    sums = [F.count("_y").alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q")]

    rows = df.select(
        moved.alias("_y"), folded.alias("_fold"), *[quoted(c).cast("string").alias(c) for c in names]
    ).where(F.col("_y").isNotNull())
    long = rows.unpivot(["_y", "_fold"], [quoted(c) for c in names], "column", "value")
    per_fold = long.where(F.col("value").isNotNull()).groupBy("column", "value", "_fold").agg(*sums)
    overall = settle(rows.groupBy("_fold").agg(*sums))

    # One row per category and fold from here on.
    per_fold = stage(per_fold)
    totals = per_fold.groupBy("column", "value").agg(*[F.sum(c).alias(c) for c in "nsq"])
    whole = overall.agg(*[F.sum(c).alias(c) for c in "nsq"]).first()
    n_all, s_all, q_all = whole["n"] or 0, whole["s"] or 0.0, whole["q"] or 0.0

    full = totals.select(
        "column", "value", F.lit(None).cast("int").alias("_fold"), *"nsq",
        F.lit(n_all).alias("n_y"), F.lit(s_all).alias("s_y"), F.lit(q_all).alias("q_y"),
    )
    stats = full
    if fold:
        group = Window.partitionBy("column", "value")
        out_of_fold = per_fold.select(
            "column", "value", "_fold",
            *[(F.sum(c).over(group) - F.col(c)).alias(c) for c in "nsq"],
        )
        y_without = settle(
            overall.select(
                "_fold",
                (F.lit(n_all) - F.col("n")).alias("n_y"),
                (F.lit(s_all) - F.col("s")).alias("s_y"),
                (F.lit(q_all) - F.col("q")).alias("q_y"),
            )
        )
        stats = attach(out_of_fold, y_without, ["_fold"]).unionByName(full)

    mean_y = F.col("s_y") / F.nullif(F.col("n_y"), F.lit(0))
    var_y = F.col("q_y") / F.nullif(F.col("n_y"), F.lit(0)) - mean_y * mean_y
    n = F.nullif(F.col("n"), F.lit(0))
    mean_c = F.col("s") / n
    var_c = F.greatest(F.col("q") / n - mean_c * mean_c, F.lit(0.0))
    weight = var_y * n / F.nullif(var_y * n + var_c, F.lit(0.0))
    encoding = F.coalesce(weight * mean_c + (1 - weight) * mean_y, mean_y) + center
    fitted = stats.select("column", "value", F.col("_fold").alias("fold"), encoding.alias("encoding"))
    return stage(fitted), center


def target_encode(
    df: DataFrame,
    names: Sequence[str],
    fitted: DataFrame,
    mean: float,
    fold: str | None = None,
) -> DataFrame:
    """Each column replaced by its encoding; with ``fold`` the out-of-fold one."""
    if fold is None:
        return _look_up(df, names, fitted.where("fold is null").drop("fold"), "encoding", F.lit(mean))
    side = fitted.where("fold is not null").withColumnRenamed("fold", "_fold")
    kept = df.withColumn("_fold", quoted(fold).cast("int"))
    return _look_up(kept, names, side, "encoding", F.lit(mean), ["_fold"]).drop("_fold")


def feature_frame(
    df: DataFrame,
    categories: Sequence[str],
    numbers: Sequence[str],
    markers: Sequence[str],
    keep: Sequence[str] = (),
    vector: str | None = None,
) -> DataFrame:
    """Dummies without the first category, numbers with medians filled in, 0/1 markers.

    Columns the table lacks are skipped; medians are taken over all rows. ``vector`` names a column
    that holds all of them as one sparse vector, numbers and markers first, whatever the number
    of categories; without it there is a column each. A number without any value stays null in its
    column and is 0 in the vector.
    """
    cats = [c for c in categories if c in df.columns]
    nums = [c for c in numbers if c in df.columns]
    marks = [c for c in markers if c in df.columns]
    # Encoders are fitted on a copy of their columns, so the table is run once for them.
    known = stage(df.select(*[quoted(c) for c in dict.fromkeys([*cats, *nums])])) if cats or nums else df
    medians = fit_medians(known, nums, None if vector is None else 0.0)
    filled = [F.coalesce(finite(quoted(c)), F.lit(medians[c])).alias(c) for c in nums]
    if vector is not None:
        dictionary, size = fit_one_hot(known, cats, drop_first=True)
        whole = [F.coalesce(quoted(c).cast("int"), F.lit(0)) for c in marks]
        return one_hot_vector(df, cats, dictionary, size, [*filled, *whole], keep, vector)
    return df.select(
        *[quoted(c) for c in keep],
        *one_hot_columns(fit_categories(known, cats), drop_first=True),
        *filled,
        *[quoted(c).cast("int").alias(c) for c in marks],
    )
