"""Features, seasonal period and seasonal profile of each series."""

from pyspark.sql import functions as F

from quotecast.functions.folds import comoments, correlation, fold, interpolated, let, mean, pairs_at, variance
from quotecast.operators.decompose import decomposed_arrays
from quotecast.operators.series import calendar

MIN_CORRELATION = 0.2
MIN_PROFILE = 12


def features(series, keys=(), period=12):
    """One row per key: statistics, trend, seasonality, autocorrelation, recent direction.

    Each series is folded once; everything is an expression over its arrays.
    """
    rows = decomposed_arrays(_filled(fold(series, keys)), period)
    known = F.filter("raw", lambda x: x.isNotNull())
    places = F.transform("raw", lambda x, i: F.struct(x.alias("a"), i.cast("double").alias("b")))
    rows = rows.withColumns({
        "_known": F.array_sort(known),
        "_line": comoments(F.filter(places, lambda p: p["a"].isNotNull())),
        "_mean": mean(known),
        "_std": F.sqrt(variance(F.col("raw"))),
    })
    n, level, std, line = F.col("n"), F.col("_mean"), F.col("_std"), F.col("_line")
    slope = F.when(line["same_a"], 0.0).otherwise(F.try_divide(line["sab"], line["sbb"]))
    slope = F.when(~line["same_b"], slope)
    strength = F.when(~line["same_a"], F.try_divide(line["sab"] * line["sab"], line["saa"] * line["sbb"]))
    value, lag1, lag2 = (F.get("raw", n - 1 - k) for k in range(3))
    recent = F.when((value > lag1) & (lag1 > lag2), "increasing").when((value < lag1) & (lag1 < lag2), "decreasing")
    rows = rows.select(
        *keys,
        n.cast("long").alias("n"),
        level.alias("mean"),
        _middle("_known").alias("median"),
        std.alias("std"),
        F.array_min("raw").alias("min"),
        F.array_max("raw").alias("max"),
        F.when(n < 2, 0.0).otherwise(slope).alias("trend_slope"),
        F.when(n < 2, "unknown").when(slope > 0, "increasing").otherwise("decreasing").alias("trend_direction"),
        F.when(n < 2, 0.0).otherwise(strength).alias("trend_strength"),
        correlation(pairs_at(F.col("raw"), F.lit(1))).alias("autocorrelation_lag1"),
        F.when(n > period, correlation(pairs_at(F.col("raw"), F.lit(period)))).otherwise(0.0).alias("autocorrelation_seasonal"),
        F.when(level == 0, 0.0).otherwise(F.try_divide(std, level)).alias("volatility"),
        F.when(n < 3, "unknown").otherwise(F.coalesce(recent, F.lit("mixed"))).alias("recent_trend"),
        *_seasonality(period),
    )
    return rows


def _filled(folded):
    """Folded series with gaps filled in ``v``; ``raw`` holds the values as they came."""
    return folded.withColumn("raw", F.transform("v", lambda x: x.cast("double"))).withColumn("v", interpolated(F.col("raw")))


def _middle(column):
    """Median of a sorted array."""
    n = F.size(column)
    low = ((n - 1) / 2).cast("int")
    return (F.get(column, low) + F.get(column, (n / 2).cast("int"))) / 2


def seasonality(series, keys=(), period=12):
    """Amplitude, strength, and for a 12-period season the peak and trough months."""
    return decomposed_arrays(_filled(fold(series, keys)), period).select(*keys, *_seasonality(period))


def _seasonality(period):
    """The columns of ``seasonality`` from a decomposed row."""
    rest = F.zip_with("v", "seasonal", lambda v, s: v - s)
    spread = F.struct(variance(F.col("seasonal")).alias("own"), variance(rest).alias("other"))
    strength = let(spread, lambda w: F.when(w["other"] > 0, w["own"] / (w["own"] + w["other"])).otherwise(0.0))
    if period == 12:
        known = F.when(F.col("n") >= 12, F.filter(_by_month(), lambda x: x["s"].isNotNull()))
        peak, trough = _peak(known), _trough(known)
    else:
        peak = trough = F.lit(None)
    return [
        F.coalesce(_amplitude(), F.lit(0.0)).alias("seasonal_amplitude"),
        strength.alias("seasonal_strength"),
        peak.cast("int").alias("peak_month"),
        trough.cast("int").alias("trough_month"),
    ]


def _amplitude():
    return (F.array_max("seasonal") - F.array_min("seasonal")) / 2


def _by_month():
    """Array of struct(s, m): mean seasonal effect of each calendar month, NULL where it does not occur."""
    dated = F.zip_with("d", "seasonal", lambda d, s: F.struct(F.month(d).alias("m"), s.alias("s")))

    def months(ds):
        def one(m):
            own = F.filter(ds, lambda x: (x["m"] == m) & x["s"].isNotNull())
            return F.struct(mean(F.transform(own, lambda x: x["s"])).alias("s"), m.alias("m"))

        return F.transform(F.sequence(F.lit(1), F.lit(12)), one)

    return let(dated, months)


def _peak(months):
    """Month of the largest value, the earliest among equals."""
    top = F.array_max(F.transform(months, lambda x: F.struct(x["s"].alias("s"), (-x["m"]).alias("m"))))
    return -top["m"]


def _trough(months):
    return F.array_min(months)["m"]


def _acf(max_lag):
    """Autocorrelations of ``v`` at lags 1 to max_lag."""
    return let(F.col("v"), lambda v: F.transform(F.sequence(F.lit(1), F.lit(max_lag)), lambda k: correlation(pairs_at(v, k))))


def autocorrelations(series, keys=(), max_lag=24):
    """keys..., lag, n, acf for every lag up to max_lag."""
    found = fold(series, keys).select(*keys, F.col("n").cast("long").alias("n"), F.posexplode(_acf(max_lag)).alias("_at", "acf"))
    return found.select(*keys, "n", (F.col("_at") + 1).alias("lag"), "acf")


def detect_period(series, keys=(), max_lag=24):
    """keys..., period: the lag of the highest inner autocorrelation peak above 0.2.

    Without a peak, monthly series get 12, quarterly ones 4, all others 1.
    """
    return fold(series, keys).select(*keys, _period(max_lag).alias("period"))


def _period(max_lag):
    """Period of a folded series: all lags are correlated in one pass over its row."""
    n = F.col("n")
    cap = F.when(n < max_lag * 2, F.floor(n / 2).cast("int")).otherwise(max_lag)
    # Differences in the last bits are not peaks: a straight line correlates fully at every lag.
    usable = F.slice(F.transform(_acf(max_lag), lambda x: F.round(x, 12)), 1, cap)

    def highest(acf):
        def peak(x, i):
            inner = (x > F.get(acf, i - 1)) & (x > F.get(acf, i + 1)) & (x > MIN_CORRELATION)
            return F.when(inner, F.struct(x.alias("acf"), (-(i + 1)).alias("lag")))

        return F.array_max(F.transform(acf, peak))

    lag = -let(usable, highest)["lag"]
    default = F.when(F.floor(F.least(n, F.lit(max_lag * 2)) / 2) < 2, 1).otherwise(
        let(calendar(F.col("d")), lambda c: F.when(c["monthly"], 12).when(c["quarterly"], 4).otherwise(1))
    )
    return F.coalesce(lag, default).cast("int")


def seasonality_profile(series, keys=(), max_lag=24):
    """keys..., period, amplitude, peak_month, trough_month, pattern.

    ``pattern`` maps month to the seasonal effect in percent of the series mean,
    for series of at least 12 points with a 12-period season. Period, decomposition and
    month means are computed on the folded series, one row each.
    """
    folded = fold(series, keys).where(F.col("n") >= MIN_PROFILE).withColumn("period", _period(max_lag))
    parts = decomposed_arrays(_filled(folded), "period")
    parts = parts.withColumns({"_months": _by_month(), "_level": mean(F.filter("v", lambda x: x.isNotNull()))})
    months = F.when(F.col("period") == 12, F.filter("_months", lambda x: x["s"].isNotNull()))
    share = lambda x: (F.try_divide(x["s"], F.col("_level")) * 100).alias("share")
    return parts.select(
        *keys,
        "period",
        _amplitude().alias("amplitude"),
        _peak(months).alias("peak_month"),
        _trough(months).alias("trough_month"),
        F.map_from_entries(F.transform(months, lambda x: F.struct(x["m"].alias("month"), share(x)))).alias("pattern"),
    )
