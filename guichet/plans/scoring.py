"""Scoring a table of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame, functions as F

from guichet.functions.numbers import (
    amount_band,
    amount_label,
    invert_log,
    prediction_range,
    round_half_even,
)
from guichet.operators.models import FittedFeatures, predict, with_request_defaults


def describe_prediction(df: DataFrame, prediction: str, rmse: float) -> DataFrame:
    """The answer to a request from its log prediction."""
    log = F.col(prediction)
    amount = invert_log(log)
    interval = prediction_range(log, rmse)
    return df.withColumns(
        {
            "montant_keur": round_half_even(amount, 1),
            "montant_label": amount_label(amount),
            "tranche": amount_band(log),
            "fourchette_keur": F.struct(
                round_half_even(interval["low"], 1).alias("low"),
                round_half_even(interval["high"], 1).alias("high"),
            ),
            "log_prediction": round_half_even(log, 3),
        }
    )


def score_batch(
    df: DataFrame, features: FittedFeatures, model: Model, rmse: float, keep: Sequence[str]
) -> DataFrame:
    """Predictions with amount, label, band and range, next to the kept columns."""
    texts = features.ordinal + features.one_hot + features.target
    requests = with_request_defaults(df, features.numbers, texts)
    scored = predict(requests, features, model, keep)
    return describe_prediction(scored, "prediction", rmse).drop("prediction")
