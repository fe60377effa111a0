"""Scaling numbers to a common range."""

from pyspark.sql import functions as F

from quotecast.functions.quantiles import quantile_values
from quotecast.schema import numeric_columns

METHODS = ("minmax", "zscore", "robust")


def normalize(df, columns=None, method="minmax"):
    """Shift and scale each numeric column by whole-table statistics; constant columns become 0."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: use one of {METHODS}")
    numbers = numeric_columns(df)
    columns = [c for c in (numbers if columns is None else columns) if c in numbers]
    if not columns:
        return df
    centers = _centers(df, columns, method)
    return df.withColumns({c: _scaled(c, *centers[c]) for c in columns})


def _centers(df, columns, method):
    """{column: (center, width)}: one small aggregate or one round of quantiles."""
    if method == "robust":
        found = quantile_values(df, columns, [0.25, 0.5, 0.75])
        return {
            c: (m, None if q1 is None else q3 - q1) for c, (q1, m, q3) in found.items()
        }
    stats = {"minmax": (F.min, F.max), "zscore": (F.avg, F.stddev_samp)}[method]
    row = df.agg(*[
        f(F.col(c).cast("double")).alias(f"{i}_{c}") for c in columns for i, f in enumerate(stats)
    ]).first()
    out = {}
    for c in columns:
        a, b = row[f"0_{c}"], row[f"1_{c}"]
        if method == "minmax" and a is not None:
            b = b - a
        out[c] = (a, b)
    return out


def _scaled(column, center, width):
    if width is None or not width > 0:
        return F.lit(0.0)
    return (F.col(column).cast("double") - F.lit(center)) / F.lit(width)
