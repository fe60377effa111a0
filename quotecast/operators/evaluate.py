"""Forecast accuracy against actual values."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quotecast.functions.columns import join_on_keys

METRICS = ("rmse", "mae", "mape")


def align(forecast, actual, keys=()):
    """keys..., date, forecast, actual on the dates both have."""
    by = [*keys, "date"]
    return join_on_keys(
        forecast.select(*by, F.col("value").alias("forecast")),
        actual.select(*by, F.col("value").alias("actual")),
        by,
    )


def evaluate(forecast, actual, keys=(), metric="rmse"):
    """keys..., points and one metric (or all three for ``metric="all"``).

    Without keys a single row, NULL where no date is shared; with keys only
    groups that share dates. Percentage errors skip zero actuals and divide by
    the signed actual.
    """
    chosen = METRICS if metric == "all" else (metric,)
    unknown = [m for m in chosen if m not in METRICS]
    if unknown:
        raise ValueError(f"Unknown metric: {unknown[0]}")
    error = F.col("forecast") - F.col("actual")
    built = {
        "rmse": F.sqrt(F.avg(error * error)),
        "mae": F.avg(F.abs(error)),
        "mape": F.avg(F.try_divide(F.abs(error), F.col("actual")) * 100),
    }
    return align(forecast, actual, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), *[built[m].alias(m) for m in chosen]
    )


def holdout(series, keys=(), points=12):
    """Split each series: (all but its last ``points`` values, those values)."""
    latest = Window.partitionBy(*(list(keys) or [F.lit(0)])).orderBy(F.desc("date"))
    ranked = series.withColumn("_back", F.row_number().over(latest))
    return (
        ranked.where(F.col("_back") > points).drop("_back"),
        ranked.where(F.col("_back") <= points).drop("_back"),
    )
