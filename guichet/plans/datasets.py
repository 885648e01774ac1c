"""The cleaned tables: for modelling, for exploration and for the hourly job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from guichet import vocabulary as V
from guichet.functions.dates import date_parts, parse_date
from guichet.functions.numbers import (
    binarize_markers,
    grant_ratio,
    log_amount,
    parse_amounts,
    parse_fr_decimal,
    require_int,
    to_number,
)
from guichet.functions.text import (
    capitalize,
    financing_class,
    map_columns,
    merge_labels,
    normalize_texts,
    quoted,
)
from guichet.operators import columns, filters
from guichet.operators.projects import project_rollup
from guichet.operators.settle import stage
from guichet.sources.delimited import ROW_ORD


def build_model_dataset(
    raw: DataFrame,
    markers: Sequence[str] = tuple(V.MARKERS),
    merges: Mapping[str, Mapping[str, str]] = V.MODEL_LABELS,
    date_formats: Sequence[str] = tuple(V.DEFAULT_FORMATS),
) -> DataFrame:
    """One row per line, with the grant ratio as target. One projection, no shuffle."""
    df = columns.drop_columns_containing(raw, V.DOLLAR_FRAGMENT)
    df = columns.drop_columns_matching(df, V.CODE_PATTERN)
    df = columns.drop_if_present(df, [ROW_ORD])
    df = map_columns(df, [V.DECLARATION_YEAR], lambda c: require_int(c, V.DECLARATION_YEAR))
    df = map_columns(df, [V.COMMITMENT_DATE], lambda c: parse_date(c, date_formats))
    df = date_parts(df, V.COMMITMENT_DATE, month=V.COMMITMENT_MONTH)
    df = merge_labels(df, merges)
    df = binarize_markers(df, markers)
    if V.GRANT_EQUIVALENT in df.columns and V.COMMITTED in df.columns:
        df = df.withColumns(
            {"_grant": to_number(quoted(V.GRANT_EQUIVALENT)), "_committed": to_number(quoted(V.COMMITTED))}
        )
        ratio = grant_ratio(F.col("_grant"), F.col("_committed"))
    else:
        ratio = F.lit(None).cast("double")
    df = columns.drop_if_present(df.withColumn(V.GRANT_RATIO, ratio), ["_grant", "_committed"])
    if V.FINANCING_TYPE in df.columns:
        df = df.withColumn(V.FINANCING_CLASS, financing_class(quoted(V.FINANCING_TYPE)))
    return df


def build_explore_dataset(
    raw: DataFrame,
    order: Sequence[Column] | None = None,
    markers: Sequence[str] = tuple(V.MARKERS),
    merges: Mapping[str, Mapping[str, str]] = V.EXPLORE_LABELS,
    date_formats: Sequence[str] = tuple(V.DAY_FIRST_FORMATS),
    staged: bool = True,
    scale: int | None = None,
) -> DataFrame:
    """One row per project, readable labels, amounts added up.

    ``scale`` is the number of decimals of the amounts where it is known.
    ``order`` is the row order of ``raw`` (its ``row_ord`` column by default). Which
    columns are sparse is known only after a pass over the table, so the parsed rows are
    written as Parquet first and text is parsed once; ``staged=False`` parses it twice.
    """
    carried = [ROW_ORD] if ROW_ORD in raw.columns else []
    order = [F.col(c) for c in carried] if order is None else list(order)

    df = map_columns(raw, [V.COMMITMENT_DATE], lambda c: parse_date(c, date_formats))
    df = parse_amounts(df)
    df = normalize_texts(df)
    df = columns.drop_columns_containing(df, V.DOLLAR_UNIT_FRAGMENT)
    df = columns.drop_if_present(df, V.MILLION_AMOUNTS)
    df = columns.drop_if_present(
        df, V.REDUNDANT_CODES + V.IDENTIFIERS + V.LONG_TEXTS + V.OTHER_DATES + V.MISCELLANEOUS
    )
    if staged:
        df = stage(df, compression="zstd")
    df = columns.prune_sparse_columns(
        df, 90.0, protect=[V.COMMITTED, V.COMMITMENT_DATE, V.PROJECT_KEY, *carried]
    )
    df = merge_labels(df, merges)
    if V.MOBILISED_ORIGIN in df.columns:
        df = map_columns(df, [V.MOBILISED_ORIGIN], capitalize)
    df = binarize_markers(df, markers)
    if V.PROJECT_KEY in df.columns:
        amounts = [c for c in df.columns if "K EUR" in c]
        df = project_rollup(
            df, V.PROJECT_KEY, V.COMMITMENT_DATE, V.COMMITTED, order, sums=amounts, scale=scale
        )
    df = date_parts(
        df, V.COMMITMENT_DATE, day=V.COMMITMENT_DAY, year=V.COMMITMENT_YEAR, month=V.COMMITMENT_MONTH
    )
    return columns.drop_if_present(df, [V.DECLARATION_YEAR, V.PROJECT_KEY, ROW_ORD])


def build_hourly_clean(raw: DataFrame, amount: str = V.PAID) -> DataFrame:
    """Lines with a positive payment, a country, a sector and a readable year."""
    df = columns.strip_headers(raw)
    df = filters.drop_nulls_subset(df, [amount, V.COUNTRY, V.SECTOR])
    df = map_columns(df, [amount], parse_fr_decimal)
    df = filters.filter_positive(df, amount)
    return filters.coerce_int_or_drop(df, V.DECLARATION_YEAR)


def build_hourly_features(
    clean: DataFrame,
    amount: str = V.PAID,
    categories: Sequence[str] = tuple(V.HOURLY_CATEGORIES),
    numbers: Sequence[str] = tuple(V.HOURLY_NUMBERS),
    keep: Sequence[str] = (),
) -> DataFrame:
    """The features that exist, complete rows only, and the log of the payment.

    A listed category that holds nothing but numbers becomes a number.
    """
    df = clean.withColumn(V.LOG_PAID, log_amount(quoted(amount)))
    df = columns.keep_if_present(df, [*categories, *numbers, V.LOG_PAID, *keep])
    df = columns.infer_numbers(df, [c for c in categories if c in df.columns])
    return filters.drop_nulls_subset(df, [c for c in df.columns if c not in keep])


def with_log_target(df: DataFrame, amount: str = V.COMMITTED, target: str = V.LOG_COMMITTED) -> DataFrame:
    """The tracked trainer's target: the log of the committed amount."""
    return df.withColumn(target, log_amount(quoted(amount)))
