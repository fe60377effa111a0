"""Forecast models over folded series, all series at once.

A model is a function of one row's array ``v`` that returns an array of
``horizon`` values, so every model runs inside one projection after the single
shuffle that folds the series. New models join by ``register_forecaster``.
"""

from pyspark.sql import functions as F

from quotecast.functions.folds import (
    centered_mean,
    fold,
    last,
    let,
    line,
    mean,
    season_means,
    total,
)
from quotecast.operators.series import has_dates, interpolate, next_index

FORECASTERS = {}
FIT_POINTS = 10
MAX_CYCLES = 5


def register_forecaster(name, build):
    """Add a model: build(v, horizon, **params) -> array column of horizon values."""
    FORECASTERS[name.lower()] = build


def forecaster(name):
    try:
        return FORECASTERS[name.lower()]
    except KeyError:
        raise ValueError(f"Unknown forecaster type: {name}") from None


def forecast(series, keys=(), model="moving_average", horizon=12, gaps=True, **params):
    """keys..., date, value: ``horizon`` values after each series' last date.

    ``gaps=False`` skips interpolation for series known to have no NULLs. A model
    that yields no value for a step falls back to the series' last value.
    """
    build = forecaster(model)
    ready = interpolate(series, keys) if gaps else series
    ready = ready.dropna(subset=["value"])
    v = F.col("v")
    final = F.get(v, F.size(v) - 1)
    values = F.transform(build(v, horizon, **params), lambda x: F.coalesce(x, final))
    index = next_index(F.col("d"), has_dates(series), horizon)
    return (
        fold(ready, keys)
        .select(*keys, F.explode(F.arrays_zip(index.alias("d"), values.alias("v"))).alias("_f"))
        .select(*keys, F.col("_f.d").alias("date"), F.col("_f.v").alias("value"))
    )


def _repeat(season, horizon):
    steps = F.sequence(F.lit(0), F.lit(horizon - 1))
    return let(season, lambda s: F.transform(steps, lambda i: F.get(s, i % F.size(s))))


def moving_average(v, horizon, window_size=3):
    """Mean of the last window_size values, held over the horizon."""
    return F.array_repeat(mean(last(v, F.lit(max(1, window_size)))), horizon)


def seasonal_naive(v, horizon, seasonal_periods=12):
    """The last season over and over; a shorter series is repeated whole."""
    return _repeat(last(v, F.lit(seasonal_periods)), horizon)


def naive(v, horizon):
    """The last value."""
    return F.array_repeat(F.get(v, F.size(v) - 1), horizon)


def average(v, horizon):
    """The mean of all history."""
    return F.array_repeat(mean(v), horizon)


def seasonal_or_last(v, horizon, seasonal_periods=12):
    """The last season over and over; the last value where there is no full season."""
    return F.when(F.size(v) >= seasonal_periods, seasonal_naive(v, horizon, seasonal_periods)).otherwise(
        naive(v, horizon)
    )


NAIVE_METHODS = {"naive": naive, "average": average, "seasonal_naive": seasonal_or_last}


def forecast_naive(series, keys=(), horizon=12, method="seasonal_naive", seasonal_period=12):
    """Naive forecasts by method; an unknown method gives the last value."""
    params = {"seasonal_periods": seasonal_period} if method == "seasonal_naive" else {}
    name = "seasonal_or_last" if method == "seasonal_naive" else method
    if method not in NAIVE_METHODS:
        name = "naive"
    return forecast(series, keys, name, horizon, **params)


def exponential_smoothing(
    v,
    horizon,
    smoothing_level=0.3,
    smoothing_trend=0.1,
    smoothing_seasonal=0.1,
    trend=None,
    seasonal=None,
    seasonal_periods=12,
    damped_trend=False,
    damping_trend=0.98,
    init="auto",
):
    """Exponential smoothing with fixed parameters; trend and seasonal are None, add or mul.

    Start values (``init``): ``simple`` takes them from the first values or first
    two seasons; ``heuristic`` from a line through ten points, deseasonalized
    where needed; ``auto`` uses the heuristic once 10 + 2 * (m // 2) values exist.
    Under two seasons the season shrinks to half the series, and up to three
    values have none. A multiplicative part needs positive values and damping
    needs a trend; otherwise simple smoothing is used.
    """
    for part in (trend, seasonal):
        if part not in (None, "add", "mul"):
            raise ValueError(f"trend and seasonal are None, 'add' or 'mul', not {part!r}")
    if init not in ("auto", "simple", "heuristic"):
        raise ValueError(f"unknown init {init!r}")
    n = F.size(v)
    level_only = _smoothed(v, horizon, smoothing_level, init)
    if (trend is None and seasonal is None) or (damped_trend and trend is None):
        return level_only
    phi = damping_trend if damped_trend else 1.0
    rates = (smoothing_level, smoothing_trend, smoothing_seasonal, phi)
    out = level_only
    if trend is not None:
        out = F.when(n >= 2, _trended(v, horizon, rates, trend, init)).otherwise(level_only)
    if seasonal is not None:
        m = F.when(
            n < seasonal_periods * 2, F.least(F.lit(seasonal_periods), F.floor(n / 2).cast("int"))
        ).otherwise(seasonal_periods)
        fitted = _seasonal(v, horizon, rates, trend, seasonal, m, init)
        out = F.when((n > 3) & (m > 1), fitted).when(n > 3, level_only).otherwise(out)
    if "mul" in (trend, seasonal):
        out = F.when(F.forall(v, lambda x: x > 0), out).otherwise(level_only)
    return out


def _ten_point_line(xs):
    """Level one step before, and slope of, the line through the first ten values."""
    fit = line(xs, F.lit(0), F.lit(FIT_POINTS))
    return fit["intercept"] - fit["slope"], fit["slope"]


def _choose(n, enough, simple, heuristic, init):
    if init == "simple":
        return simple
    return F.when(n >= enough, heuristic).otherwise(simple)


def _smoothed(v, horizon, alpha, init):
    start = _choose(F.size(v), FIT_POINTS, F.get(v, F.lit(0)), _ten_point_line(v)[0], init)
    level = F.aggregate(v, start, lambda l, y: y * alpha + l * (1 - alpha))
    return F.array_repeat(level, horizon)


def _moved(level, slope, times, trend):
    """Level after ``times`` (damped) steps of the trend."""
    if trend is None:
        return level
    return level + slope * times if trend == "add" else level * F.pow(slope, times)


def _new_slope(level, before, slope, beta, phi, trend):
    if trend == "add":
        return (level - before) * beta + slope * (phi * (1 - beta))
    return level / before * beta + F.pow(slope, F.lit(phi)) * (1 - beta)


def _damped_steps(horizon, phi):
    sums, power = [], 1.0
    for _ in range(horizon):
        power *= phi
        sums.append((sums[-1] if sums else 0.0) + power)
    return sums


def _state(**parts):
    return F.struct(*[c.alias(k) for k, c in parts.items()])


def _trended(v, horizon, rates, trend, init):
    alpha, beta, _, phi = rates
    first, second = F.get(v, F.lit(0)), F.get(v, F.lit(1))
    level, slope = _ten_point_line(v)
    if trend == "add":
        simple, fitted = second - first, slope
    else:
        simple, fitted = F.try_divide(second, first), F.try_divide(slope, level) + 1
    n = F.size(v)
    start = _state(
        l=_choose(n, FIT_POINTS, first, level, init).cast("double"),
        b=_choose(n, FIT_POINTS, simple, fitted, init).cast("double"),
    )

    def step(s, y):
        expected = _moved(s["l"], s["b"], F.lit(phi), trend)
        new = y * alpha + expected * (1 - alpha)
        return _state(l=new, b=_new_slope(new, s["l"], s["b"], beta, phi, trend))

    end = F.aggregate(v, start, step)
    times = F.array(*[F.lit(t) for t in _damped_steps(horizon, phi)])
    return let(end, lambda s: F.transform(times, lambda t: _moved(s["l"], s["b"], t, trend)))


def _seasonal(v, horizon, rates, trend, seasonal, m, init):
    alpha, beta, gamma, phi = rates
    off = (lambda y, s: y - s) if seasonal == "add" else (lambda y, s: y / s)
    on = (lambda y, s: y + s) if seasonal == "add" else (lambda y, s: y * s)
    start = _choose(
        F.size(v),
        F.floor(m / 2) * 2 + FIT_POINTS,
        _simple_season(v, m, off),
        _heuristic_season(v, m, trend, off),
        init,
    )

    def step(s, y):
        expected = _moved(s["l"], s["b"], F.lit(phi), trend)
        due = F.get(s["s"], F.lit(0))
        new = off(y, due) * alpha + expected * (1 - alpha)
        slope = s["b"] if trend is None else _new_slope(new, s["l"], s["b"], beta, phi, trend)
        again = off(y, expected) * gamma + due * (1 - gamma)
        rest = F.slice(s["s"], 2, F.size(s["s"]) - 1)
        return _state(l=new, b=slope, s=F.concat(rest, F.array(again)))

    end = F.aggregate(v, start, step)
    times = F.array(*[F.lit(t) for t in _damped_steps(horizon, phi)])

    def ahead(s):
        return F.transform(
            times,
            lambda t, i: on(_moved(s["l"], s["b"], t, trend), F.get(s["s"], i % F.size(s["s"]))),
        )

    return let(end, ahead)


def _simple_season(v, m, off):
    first = F.slice(v, 1, m)
    slope = (total(F.slice(v, m + 1, m)) - total(first)) / (m * m)
    return let(mean(first), lambda level: _state(
        l=level.cast("double"),
        b=slope.cast("double"),
        s=F.transform(first, lambda y: off(y, level).cast("double")),
    ))


def _heuristic_season(v, m, trend, off):
    """Seasonal means of the detrended first cycles; level and slope from the trend line."""
    need = F.floor(m / 2) * 2 + FIT_POINTS
    cycles = F.greatest(
        F.least(F.lit(MAX_CYCLES), F.floor(F.size(v) / m)), F.ceil(need / m)
    ).cast("int")
    early = F.slice(v, 1, m * cycles)

    def start(smooth):
        effects = season_means(F.zip_with(early, smooth, off), m)
        fit = line(F.filter(smooth, lambda x: x.isNotNull()), F.lit(0), F.lit(FIT_POINTS))
        known = F.struct(effects.alias("e"), fit.alias("f"))
        return let(known, state)

    def state(k):
        level = k["f"]["intercept"] - k["f"]["slope"]
        slope = k["f"]["slope"]
        if trend == "mul":
            slope = F.try_divide(slope, level) + 1
        balanced = let(
            mean(k["e"]), lambda center: F.transform(k["e"], lambda e: off(e, center).cast("double"))
        )
        return _state(l=level.cast("double"), b=slope.cast("double"), s=balanced)

    return let(centered_mean(early, m), start)


for _name, _build in (
    ("moving_average", moving_average),
    ("exponential_smoothing", exponential_smoothing),
    ("seasonal_naive", seasonal_naive),
    ("naive", naive),
    ("average", average),
    ("seasonal_or_last", seasonal_or_last),
):
    register_forecaster(_name, _build)
