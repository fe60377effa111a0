"""Forecasts of price and lead time for every group, with optional constraints."""

from functools import reduce

from pyspark.sql import functions as F

from quotecast.functions.lineage import checkpoint
from quotecast.operators.constrain import constrain_forecast, derive_constraints, fit_summary
from quotecast.operators.forecast import forecast
from quotecast.operators.series import as_number, bucket
from quotecast.schema import MEASURES


def forecast_measures(
    history,
    keys=(),
    horizon=12,
    models=None,
    params=None,
    freq="day",
    constraints=None,
    objective="l1",
    measures=MEASURES,
):
    """{measure: keys..., date, <measure>, ...} and ``errors``.

    ``models`` and ``params`` are per measure, or one for both. ``constraints`` is
    None for plain forecasts, "auto" to derive them per group from the history,
    or {measure: "auto" | dict | table}. Group columns missing from the table are
    ignored as a whole, and rows with a NULL group are left out. ``errors`` lists
    groups without any value of a measure. With constraints there are also ``fits``:
    keys..., measure, cost, violation, status (see ``fit_summary``).

    The history is read once: means and counts per key and date of all measures go
    to the shared folder, and series, errors and monthly means come from there.
    Only derived rules on changes, which count raw rows, read it again.
    """
    keys = list(keys) if all(k in history.columns for k in keys) else []
    rows = history.dropna(subset=keys) if keys else history
    means = checkpoint(_means(rows, keys, freq, measures))
    out, fits = {}, []
    for m in measures:
        series = means.select(*keys, "date", F.col(m).alias("value")).dropna(subset=["date", "value"])
        model = _for(models, m, "moving_average")
        plain = forecast(series, keys, model, horizon, gaps=False, **(_for_params(params, m)))
        rules = _for(constraints, m, None)
        if rules is not None:
            if isinstance(rules, str):
                rules = derive_constraints(rows, m, keys, rules)
            fits.append(fit_summary(plain, rules, keys, objective, series).select(*keys, F.lit(m).alias("measure"), "cost", "violation", "status"))
            plain = constrain_forecast(plain, rules, keys, objective, history=series)
        out[m] = plain.withColumnRenamed("value", m)
    out["errors"] = _errors(means, keys, measures)
    if fits:
        out["fits"] = reduce(lambda a, b: a.unionByName(b), fits)
    return out


def _for(setting, measure, default):
    if isinstance(setting, dict):
        return setting.get(measure, default)
    return default if setting is None else setting


def _for_params(params, measure):
    params = params or {}
    return params.get(measure, {}) if set(params) <= set(MEASURES) else params


def _means(rows, keys, freq, measures):
    """keys..., date, and for each measure its mean and (``_<measure>``) number of usable values."""
    usable = [
        (F.col(m).isNotNull() & F.col("date").isNotNull()).alias(f"_{m}") for m in measures
    ]
    numbers = [as_number(rows, m).alias(m) for m in measures]
    return (
        rows.select(*keys, bucket("date", freq).alias("date"), *numbers, *usable)
        .groupBy(*keys, "date")
        .agg(
            *[F.avg(m).alias(m) for m in measures],
            *[F.count_if(f"_{m}").alias(f"_{m}") for m in measures],
        )
    )


def _errors(means, keys, measures):
    """Groups whose measure has no usable value, counted for all measures in one pass."""
    counted = means.groupBy(*keys).agg(
        *[F.coalesce(F.sum(f"_{m}"), F.lit(0)).alias(f"_{m}") for m in measures]
    )
    parts = [
        counted.where(F.col(f"_{m}") == 0).select(
            *keys, F.lit(m).alias("measure"), F.lit("no data").alias("error")
        )
        for m in measures
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
