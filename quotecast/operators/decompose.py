"""Trend, seasonal and residual parts of each series.

Each series is one folded row, so its own length decides its period without any
regrouping; the only shuffle is the fold on the keys.
"""

from pyspark.sql import functions as F

from quotecast.functions.folds import (
    centered_mean,
    fill_ends,
    fold,
    half,
    let,
    line,
    mean,
    rolling_mean,
    season_means,
)
from quotecast.operators.series import interpolate

MODELS = ("additive", "multiplicative")
METHODS = ("classical", "simple")


def effective_period(n, period):
    """Two full seasons are needed; shorter series get a shorter season, at least 2."""
    shorter = F.greatest(F.lit(2), F.least(period, F.floor(n / 2).cast("int")))
    return F.when(n < period * 2, shorter).otherwise(period).cast("int")


def decompose(series, keys=(), period=12, model="additive", method="classical"):
    """keys..., date, trend, seasonal, residual, original.

    ``classical``: centred moving average with the ends continued on a
    least-squares line, seasonal means adjusted to cancel out. Series it cannot
    handle (too short, or not positive for the multiplicative model) and
    ``simple``: rolling mean with the ends held flat, plain seasonal means.
    ``period`` is a number, or the name of a column of the series.
    """
    if model not in MODELS or method not in METHODS:
        raise ValueError(f"unknown model {model!r} or method {method!r}")
    parts = decomposed(interpolate(series, keys, leading=False), keys, period, model, method)
    zipped = F.explode(F.arrays_zip("d", "trend", "seasonal", "residual", "v"))
    return parts.select(*keys, zipped.alias("_r")).select(
        *keys,
        F.col("_r.d").alias("date"),
        "_r.trend",
        "_r.seasonal",
        "_r.residual",
        F.col("_r.v").alias("original"),
    )


def decomposed(series, keys, period=12, model="additive", method="classical"):
    """Folded form: keys..., d, v, n, p, trend, seasonal, residual arrays."""
    per_series = isinstance(period, str)
    folded = fold(series, [*keys, period] if per_series and period not in keys else keys)
    return decomposed_arrays(folded, period, model, method)


def decomposed_arrays(folded, period=12, model="additive", method="classical"):
    """Add p, trend, seasonal and residual to folded series (d, v, n)."""
    wanted = F.col(period) if isinstance(period, str) else F.lit(period)
    rows = folded.withColumn("_parts", decomposition(F.col("v"), F.col("n"), wanted, model, method))
    return rows.withColumns({c: F.col("_parts")[c] for c in ("p", "trend", "seasonal", "residual")}).drop("_parts")


def decomposition(v, n, period, model="additive", method="classical"):
    """struct(p, trend, seasonal, residual) of a folded series.

    Each part is bound before the next uses it, so the expression stays small
    wherever the optimizer copies it to.
    """
    additive = model == "additive"
    rest = (lambda x, y: x - y) if additive else F.try_divide

    def bound(body, **parts):
        return let(F.struct(*(c.alias(k) for k, c in parts.items())), body)

    def start(w):
        usable = F.forall(w["v"], lambda x: x.isNotNull() if additive else x > 0)
        classical = F.lit(False) if method == "simple" else (w["n"] >= w["p"] * 2) & F.coalesce(usable, F.lit(False))
        return bound(smooth, v=w["v"], n=w["n"], p=w["p"], classical=classical)

    def smooth(w):
        trend = F.when(w["classical"], _continued(centered_mean(w["v"], w["p"]), w["p"], w["n"])).otherwise(
            fill_ends(rolling_mean(w["v"], w["p"])))
        return bound(loosen, v=w["v"], p=w["p"], classical=w["classical"], trend=trend)

    def loosen(w):
        loose = F.zip_with(w["v"], w["trend"], rest)
        return bound(season, v=w["v"], p=w["p"], classical=w["classical"], trend=w["trend"], loose=loose)

    def season(w):
        means = let(season_means(w["loose"], w["p"]), lambda s: F.when(w["classical"], _cancelled(s, rest)).otherwise(s))
        seasonal = let(means, lambda s: F.transform(w["v"], lambda _, i: F.get(s, i % w["p"])))
        return bound(finish, p=w["p"], trend=w["trend"], loose=w["loose"], seasonal=seasonal)

    def finish(w):
        residual = F.zip_with(w["loose"], w["seasonal"], rest)
        return F.struct(w["p"].alias("p"), w["trend"].alias("trend"), w["seasonal"].alias("seasonal"), residual.alias("residual"))

    return bound(lambda w: bound(start, v=w["v"], n=w["n"], p=effective_period(w["n"], w["period"])), v=v, n=n, period=period)


def _cancelled(season, rest):
    """Seasonal means that cancel out over one season."""
    return let(mean(season), lambda m: F.transform(season, lambda s: rest(s, m)))


def _continued(smoothed, p, n):
    """A trend with its ends on the line through the nearest p trend points."""
    front, back = half(p), n - 1 - half(p)

    def ends(trend):
        lines = F.struct(
            line(trend, front, F.least(front + p, back)).alias("head"),
            line(trend, F.greatest(front, back - p), back).alias("tail"),
        )

        def extend(e):
            head, tail = e["head"], e["tail"]
            return F.transform(
                trend,
                lambda x, i: F.when(i < front, head["slope"] * i + head["intercept"])
                .when(i > back, tail["slope"] * i + tail["intercept"])
                .otherwise(x),
            )

        return let(lines, extend)

    return let(smoothed, ends)
