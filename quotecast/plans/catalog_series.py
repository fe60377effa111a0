"""Queries over series: construction, decomposition, features, forecasts, rules, reports."""

from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotecast.functions.lineage import shared_folder
from quotecast.operators import compare, constrain, decompose, evaluate, features, filters, forecast, series
from quotecast.plans import export
from quotecast.plans.forecasting import forecast_measures
from quotecast.plans.registry import (
    DIRTY,
    HISTORY,
    calendar_sql,
    placed_sql,
    query,
    rounded,
    select,
    series_sql,
)
from quotecast.schema import HISTORY_SCHEMA
from quotecast.sources import files
from quotecast.sources.history import daily_events, dirty_history, history

BY = ["country"]
MONTHLY = series_sql()
H = 12


def monthly(spark, d, value="price", keys=("country",), freq="month", **options):
    return series.to_series(history(spark, d), value, list(keys), freq, **options)


@query(
    "series_projection",
    select(HISTORY, "date value~=price", "history"),
)
def _(spark, d):
    return rounded(history(spark, d).select("date", F.col("price").alias("value")))


@query("series_daily", select(series_sql(keys="vendor", freq="day"), "vendor date value~", "series"))
def _(spark, d):
    return rounded(monthly(spark, d, keys=["vendor"], freq="day"))


_SPINE = {
    "week": "generate_series(lo, hi, INTERVAL 7 DAY)",
    "month": "generate_series(lo, hi, INTERVAL 1 MONTH)",
    "quarter": "generate_series(lo, hi, INTERVAL 3 MONTH)",
}


def _spined(freq, keys="vendor"):
    return series_sql(keys=keys, freq=freq) + f""", spine AS (
      SELECT {keys}, CAST(unnest({_SPINE[freq]}) AS DATE) AS date
      FROM (SELECT {keys}, CAST(min(date) AS TIMESTAMP) AS lo, CAST(max(date) AS TIMESTAMP) AS hi
            FROM series GROUP BY 1)),
    filled AS (SELECT {keys}, date, value FROM spine LEFT JOIN series USING ({keys}, date))"""


for _freq in _SPINE:

    @query(f"resample_{_freq}", select(_spined(_freq), "vendor date value~", "filled"))
    def _(spark, d, freq=_freq):
        return rounded(monthly(spark, d, keys=["vendor"], freq=freq, fill_spine=True))


@query(
    "month_key",
    f"WITH {HISTORY} SELECT part_number, date, strftime(date, '%Y-%m') AS month FROM history",
)
def _(spark, d):
    return series.month_key(history(spark, d)).select("part_number", "date", "month")


def _interpolated(source, keys="vendor"):
    return placed_sql(keys, source) + f""", edged AS (
      SELECT *, last_value(value IGNORE NULLS) OVER b AS back, first_value(value IGNORE NULLS) OVER a AS ahead,
             max(CASE WHEN value IS NOT NULL THEN pos END) OVER b AS p0,
             min(CASE WHEN value IS NOT NULL THEN pos END) OVER a AS p1
      FROM placed WINDOW
        b AS (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        a AS (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    smooth AS (SELECT {keys}, date, CASE WHEN p1 > p0 THEN back + (ahead - back) / (p1 - p0) * (pos - p0)
                      ELSE coalesce(back, ahead) END AS value FROM edged)"""


@query(
    "interpolate_series",
    select(_spined("week") + _interpolated("filled"), "vendor date value~", "smooth"),
)
def _(spark, d):
    weekly = monthly(spark, d, keys=["vendor"], freq="week", fill_spine=True)
    return rounded(series.interpolate(weekly, ["vendor"]))


@query(
    "future_dates",
    select(
        series_sql(keys="part_number") + calendar_sql("part_number"),
        ["part_number", "step=CAST(i + 1 AS INTEGER)", "date"],
        "ahead",
    ),
)
def _(spark, d):
    return series.future_dates(monthly(spark, d, keys=["part_number"]), ["part_number"], H)


@query(
    "index_continuation",
    f"""WITH {HISTORY}, s AS (
          SELECT vendor, CAST(year(date) * 12 + month(date) AS BIGINT) AS i, avg(price) AS v
          FROM history GROUP BY 1, 2),
        e AS (SELECT vendor, max(i) AS m, arg_max(v, i) AS v FROM s GROUP BY 1)
        SELECT vendor, m + k AS date, floor(v * 1e4 + 0.4321) / 1e4 AS value
        FROM e, generate_series(1, 12) AS t(k)""",
)
def _(spark, d):
    month = (F.year("date") * 12 + F.month("date")).cast("long")
    indexed = history(spark, d).groupBy("vendor", month.alias("date")).agg(F.avg("price").alias("value"))
    return rounded(forecast.forecast(indexed, ["vendor"], "naive", H))


@query(
    "moving_averages",
    select(
        MONTHLY + placed_sql(),
        [
            "country", "date", "value~",
            *[
                f"ma_{w}~=CASE WHEN pos >= {w - 1} AND n > {w} THEN avg(value) OVER "
                f"(PARTITION BY country ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) END"
                for w in (3, 6, 12)
            ],
        ],
        "placed",
    ),
)
def _(spark, d):
    return rounded(series.moving_averages(monthly(spark, d), BY))


def _classical(rest, placed=None):
    """Decomposition with a 12-period season; ``rest`` takes y and x to y - x or y / x."""
    part = "PARTITION BY country"
    return (placed_sql() if placed is None else placed) + f""", centred AS (
      SELECT *, CASE WHEN pos >= 6 AND pos < n - 6 THEN
        (sum(value) OVER ({part} ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)
         + sum(value) OVER ({part} ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 24 END AS t
      FROM placed),
    ends AS (
      SELECT country, regr_slope(t, pos) FILTER (pos BETWEEN 6 AND 17) AS s0,
             regr_intercept(t, pos) FILTER (pos BETWEEN 6 AND 17) AS i0,
             regr_slope(t, pos) FILTER (pos BETWEEN n - 19 AND n - 8) AS s1,
             regr_intercept(t, pos) FILTER (pos BETWEEN n - 19 AND n - 8) AS i1
      FROM centred GROUP BY ALL),
    trended AS (
      SELECT c.*, CASE WHEN pos < 6 THEN s0 * pos + i0 WHEN pos >= n - 6 THEN s1 * pos + i1 ELSE t END AS trend
      FROM centred c JOIN ends USING (country)),
    effects AS (SELECT country, pos % 12 AS r, avg({rest("value", "trend")}) AS e FROM trended GROUP BY ALL),
    balanced AS (SELECT country, r, {rest("e", f"avg(e) OVER ({part})")} AS seasonal FROM effects),
    parts AS (
      SELECT t.*, seasonal, {rest(rest("value", "trend"), "seasonal")} AS residual
      FROM trended t JOIN balanced b ON t.pos % 12 = b.r AND t.country = b.country)"""


def _minus(y, x):
    return f"({y} - {x})"


def _over(y, x):
    return f"({y} / {x})"


PARTS = "country date trend~ seasonal~ residual~ original~=value"


@query("decompose_additive", select(MONTHLY + _classical(_minus), PARTS, "parts"))
def _(spark, d):
    return rounded(decompose.decompose(monthly(spark, d), BY))


@query("decompose_multiplicative", select(MONTHLY + _classical(_over), PARTS, "parts"))
def _(spark, d):
    return rounded(decompose.decompose(monthly(spark, d), BY, model="multiplicative"))


@query(
    "decompose_simple",
    select(
        MONTHLY + placed_sql() + """, rolled AS (
          SELECT *, CASE WHEN pos >= 6 AND pos - 6 + 12 <= n THEN
            avg(value) OVER (PARTITION BY country ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) END AS t
          FROM placed),
        trended AS (
          SELECT *, CASE WHEN pos < 6 THEN first_value(t IGNORE NULLS) OVER w
                         ELSE coalesce(t, last_value(t IGNORE NULLS) OVER w) END AS trend
          FROM rolled WINDOW w AS (PARTITION BY country ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        parts AS (
          SELECT *, value - trend - seasonal AS residual FROM (
            SELECT *, avg(value - trend) OVER (PARTITION BY country, pos % 12) AS seasonal FROM trended))""",
        PARTS,
        "parts",
    ),
)
def _(spark, d):
    return rounded(decompose.decompose(monthly(spark, d), BY, method="simple"))


_SEASONS = MONTHLY + _classical(_minus) + """, months AS (
  SELECT country, month(date) AS m, avg(seasonal) AS s FROM parts GROUP BY 1, 2),
peaks AS (SELECT country, CAST(arg_max(m, s) AS INTEGER) AS peak_month, CAST(arg_min(m, s) AS INTEGER) AS trough_month
          FROM months GROUP BY 1),
seasons AS (
  SELECT country, (max(seasonal) - min(seasonal)) / 2 AS seasonal_amplitude,
         var_samp(seasonal) / (var_samp(seasonal) + var_samp(value - seasonal)) AS seasonal_strength
  FROM parts GROUP BY 1),
lagged AS (
  SELECT *, lag(value) OVER w AS l1, lag(value, 2) OVER w AS l2, lag(value, 12) OVER w AS l12 FROM placed
  WINDOW w AS (PARTITION BY country ORDER BY pos)),
basics AS (
  SELECT country, count(*) AS n, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std,
         min(value) AS min, max(value) AS max, regr_slope(value, pos) AS trend_slope,
         CASE WHEN regr_slope(value, pos) > 0 THEN 'increasing' ELSE 'decreasing' END AS trend_direction,
         regr_r2(value, pos) AS trend_strength, corr(value, l1) AS autocorrelation_lag1,
         corr(value, l12) AS autocorrelation_seasonal, stddev_samp(value) / avg(value) AS volatility,
         arg_max(CASE WHEN value > l1 AND l1 > l2 THEN 'increasing' WHEN value < l1 AND l1 < l2 THEN 'decreasing'
                      ELSE 'mixed' END, pos) AS recent_trend
  FROM lagged GROUP BY 1)"""


@query(
    "features",
    select(
        _SEASONS,
        """country n mean~ median~ std~ min~ max~ trend_slope~ trend_direction trend_strength~
           autocorrelation_lag1~ autocorrelation_seasonal~ volatility~ recent_trend
           seasonal_amplitude~ seasonal_strength~ peak_month trough_month""",
        "basics JOIN seasons USING (country) JOIN peaks USING (country)",
    ),
)
def _(spark, d):
    return rounded(features.features(monthly(spark, d), BY))


_LAGS = MONTHLY + placed_sql() + """, pairs AS (
  SELECT a.country, a.n, k AS lag, corr(a.value, b.value) AS acf
  FROM generate_series(1, 24) AS t(k) JOIN placed a ON true JOIN placed b
    ON a.country = b.country AND a.pos = b.pos + k GROUP BY ALL)"""


@query("autocorrelations", select(_LAGS, ["country", "n", "lag=CAST(lag AS INTEGER)", "acf~"], "pairs", 6))
def _(spark, d):
    return rounded(features.autocorrelations(monthly(spark, d), BY), 6)


_PERIODS = _LAGS + calendar_sql() + """, peaked AS (
  SELECT *, lag(acf) OVER w AS p, lead(acf) OVER w AS q FROM pairs
  WHERE lag <= CASE WHEN n < 48 THEN n // 2 ELSE 24 END WINDOW w AS (PARTITION BY country ORDER BY lag)),
best AS (
  SELECT DISTINCT ON (country) country, lag FROM peaked WHERE acf > p AND acf > q AND acf > 0.2
  ORDER BY country, acf DESC, lag),
periods AS (
  SELECT country, CAST(coalesce(lag, CASE WHEN kind = 'r' AND mx = 1 THEN 12 WHEN kind = 'r' AND mx = 3 THEN 4
                                          ELSE 1 END) AS INTEGER) AS period
  FROM rule LEFT JOIN best USING (country))"""


@query("detect_period", select(_PERIODS, "country period", "periods"))
def _(spark, d):
    return features.detect_period(monthly(spark, d), BY)


# Only a 12-period season has a monthly pattern, so the other series yield no rows.
@query(
    "seasonality_profile",
    select(
        _PERIODS + _classical(_minus, "") + """, months AS (
          SELECT country, month(date) AS m, avg(seasonal) AS s FROM parts GROUP BY ALL),
        sizes AS (SELECT country, (max(seasonal) - min(seasonal)) / 2 AS amplitude, avg(value) AS level
                  FROM parts GROUP BY 1),
        peaks AS (SELECT country, CAST(arg_max(m, s) AS INTEGER) AS peak_month,
                         CAST(arg_min(m, s) AS INTEGER) AS trough_month FROM months GROUP BY 1)""",
        [
            "country", "period", "amplitude~", "peak_month", "trough_month",
            "month=CAST(m AS INTEGER)", "percent~=s / level * 100",
        ],
        """months JOIN sizes USING (country) JOIN peaks USING (country) JOIN periods USING (country)
           WHERE period = 12""",
    ),
)
def _(spark, d):
    found = features.seasonality_profile(monthly(spark, d), BY)
    months = F.explode("pattern").alias("month", "percent")
    return rounded(found.select("country", "period", "amplitude", "peak_month", "trough_month", months))


def _last_rows(keys, w, source="series"):
    part = f"PARTITION BY {keys} " if keys else ""
    return f""", ranked AS (
      SELECT *, row_number() OVER ({part}ORDER BY date DESC) AS back FROM {source}),
    tail AS (SELECT * FROM ranked WHERE back <= {w})"""


def _moving_sql(keys="country", w=3, horizon=H, base=None, **options):
    ctes = (base or series_sql(keys=keys, **options)) + calendar_sql(keys, horizon) + _last_rows(keys, w)
    by = f"{keys}, " if keys else ""
    join = f"USING ({keys})" if keys else "ON true"
    return ctes + f""", level AS (SELECT {by}avg(value) AS value FROM tail GROUP BY ALL),
    plain AS (SELECT {by}date, value, i FROM ahead JOIN level {join})"""


FORECAST = "country date value~"


@query("forecast_moving_average", select(_moving_sql(), FORECAST, "plain"))
def flagship(spark, d):
    return rounded(forecast.forecast(monthly(spark, d), BY, "moving_average", H, gaps=False, window_size=3))


@query(
    "forecast_moving_average_by_part",
    select(_moving_sql("part_number", 6), "part_number date value~", "plain"),
)
def _(spark, d):
    by = ["part_number"]
    return rounded(
        forecast.forecast(monthly(spark, d, keys=by), by, "moving_average", H, gaps=False, window_size=6)
    )


def _seasonal_sql(keys, horizon=H, short="repeat", **options):
    """Last season repeated; where shorter: repeat what there is, or hold the last value."""
    size = "least(n, 12)" if short == "repeat" else "CASE WHEN n < 12 THEN 1 ELSE 12 END"
    return series_sql(keys=keys, **options) + calendar_sql(keys, horizon) + f""", folded AS (
      SELECT {keys}, list(value ORDER BY date) AS v, count(*) AS n FROM series GROUP BY 1),
    plain AS (SELECT {keys}, date, v[n - {size} + 1 + i % {size}] AS value FROM ahead JOIN folded USING ({keys}))"""


@query("forecast_seasonal_naive", select(_seasonal_sql("vendor", 24), "vendor date value~", "plain"))
def _(spark, d):
    by = ["vendor"]
    return rounded(forecast.forecast(monthly(spark, d, keys=by), by, "seasonal_naive", 24, gaps=False))


@query(
    "forecast_naive_seasonal",
    select(_seasonal_sql("part_number", short="last"), "part_number date value~", "plain"),
)
def _(spark, d):
    by = ["part_number"]
    return rounded(forecast.forecast_naive(monthly(spark, d, keys=by), by, H))


@query("forecast_naive_last", select(_moving_sql("vendor", 1), "vendor date value~", "plain"))
def _(spark, d):
    by = ["vendor"]
    return rounded(forecast.forecast_naive(monthly(spark, d, keys=by), by, H, "naive"))


@query("forecast_registered", select(_moving_sql("vendor", 1), "vendor date value~", "plain"))
def _(spark, d):
    """A model of the user's own; a step it has no value for takes the last known one."""
    by = ["vendor"]
    forecast.register_forecaster(
        "undecided", lambda v, horizon: F.array_repeat(F.lit(None).cast("double"), horizon)
    )
    return rounded(forecast.forecast(monthly(spark, d, keys=by), by, "undecided", H, gaps=False))


@query("forecast_naive_average", select(_moving_sql("vendor", 1000000), "vendor date value~", "plain"))
def _(spark, d):
    by = ["vendor"]
    return rounded(forecast.forecast_naive(monthly(spark, d, keys=by), by, H, "average"))


_START = """, placed AS (
  SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY {k}) AS n
  FROM series),
line AS (
  SELECT {k}, regr_intercept(value, pos + 1) FILTER (pos < 10) AS l, regr_slope(value, pos + 1) FILTER (pos < 10) AS b,
         arg_min(value, pos) AS first, max(value) FILTER (pos = 1) AS second, max(n) AS n,
         list(value ORDER BY pos) AS v FROM placed GROUP BY 1)"""


def _smoothing_sql(keys):
    return series_sql(keys=keys) + calendar_sql(keys) + _START.format(k=keys) + f""", level AS (
      SELECT {keys}, list_reduce(v, lambda a, y: 0.3::DOUBLE * y + 0.7::DOUBLE * a,
        CAST(CASE WHEN n >= 10 THEN l ELSE first END AS DOUBLE)) AS value FROM line),
    plain AS (SELECT {keys}, date, value FROM ahead JOIN level USING ({keys}))"""


@query("forecast_smoothing", select(_smoothing_sql("part_number"), "part_number date value~", "plain"))
def _(spark, d):
    by = ["part_number"]
    return rounded(
        forecast.forecast(monthly(spark, d, keys=by), by, "exponential_smoothing", H, gaps=False)
    )


def _holt_sql(kind, phi):
    b0 = ("b", "second - first") if kind == "add" else ("1 + b / l", "second / first")
    move = "({l} + {b} * {t})" if kind == "add" else "({l} * pow({b}, {t}))"
    expected = move.format(l="l", b="b", t=phi)
    slope = (
        f"0.1::DOUBLE * (x - l) + 0.9::DOUBLE * {phi} * b"
        if kind == "add"
        else f"0.1::DOUBLE * (x / l) + 0.9::DOUBLE * pow(b, {phi})"
    )
    damped = " + ".join(f"pow({phi}, {j}) * CAST(i >= {j - 1} AS INTEGER)" for j in range(1, H + 1))
    return MONTHLY + calendar_sql() + _START.format(k="country") + f""", walk AS (
      SELECT country, 0 AS k, v, n, CASE WHEN n >= 10 THEN l ELSE first END AS l,
             CASE WHEN n >= 10 THEN {b0[0]} ELSE {b0[1]} END AS b FROM line
      UNION ALL
      SELECT country, k + 1, v, n, x, {slope} FROM (
        SELECT *, 0.3::DOUBLE * v[k + 1] + 0.7::DOUBLE * {expected} AS x FROM walk WHERE k < n)),
    plain AS (SELECT country, date, {move.format(l="l", b="b", t=f"({damped})")} AS value
              FROM ahead JOIN walk USING (country) WHERE k = n)"""


for _kind, _phi in (("add", None), ("mul", None), ("add", 0.9)):
    _name = f"forecast_holt_{_kind}" + ("_damped" if _phi else "")

    @query(_name, select(_holt_sql(_kind, f"{_phi or 1.0}::DOUBLE"), FORECAST, "plain"))
    def _(spark, d, kind=_kind, phi=_phi):
        params = {"trend": kind}
        if phi:
            params.update(damped_trend=True, damping_trend=phi)
        return rounded(
            forecast.forecast(monthly(spark, d), BY, "exponential_smoothing", H, gaps=False, **params)
        )


def _winters_sql(trend, seasonal):
    rest, join = (_minus, "+") if seasonal == "add" else (_over, "*")
    move = "l + b" if trend else "l"
    ahead = "l + b * (i + 1)" if trend else "l"
    slope = "0.1::DOUBLE * (x - l) + 0.9::DOUBLE * b" if trend else "b"
    return MONTHLY + calendar_sql() + placed_sql() + f""", early AS (
      SELECT *, CASE WHEN pos BETWEEN 6 AND 53 THEN
        (sum(value) OVER (PARTITION BY country ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)
         + sum(value) OVER (PARTITION BY country ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 24 END AS t
      FROM placed WHERE pos < 60),
    effects AS (SELECT country, pos % 12 AS r, avg({rest("value", "t")}) AS e FROM early GROUP BY ALL),
    balanced AS (
      SELECT country, list(e2 ORDER BY r) AS s
      FROM (SELECT country, r, {rest("e", "avg(e) OVER (PARTITION BY country)")} AS e2 FROM effects) GROUP BY 1),
    line AS (
      SELECT country, regr_intercept(t, pos - 5) FILTER (pos BETWEEN 6 AND 15) AS l,
             regr_slope(t, pos - 5) FILTER (pos BETWEEN 6 AND 15) AS b FROM early GROUP BY 1),
    folded AS (SELECT country, list(value ORDER BY pos) AS v, max(n) AS n FROM placed GROUP BY 1),
    walk AS (
      SELECT country, 0 AS k, v, n, l, b, s FROM folded JOIN line USING (country) JOIN balanced USING (country)
      UNION ALL
      SELECT country, k + 1, v, n, x, {slope}, list_append(s[2:12], g) FROM (
        SELECT *, 0.3::DOUBLE * {rest("v[k + 1]", "s[1]")} + 0.7::DOUBLE * ({move}) AS x,
               0.1::DOUBLE * {rest("v[k + 1]", f"({move})")} + 0.9::DOUBLE * s[1] AS g FROM walk WHERE k < n)),
    plain AS (SELECT country, date, ({ahead}) {join} s[1 + i % 12] AS value
              FROM ahead JOIN walk USING (country) WHERE k = n)"""


for _trend, _seasonal in (("add", "add"), ("add", "mul"), (None, "add")):

    @query(
        f"forecast_winters_{_trend or 'level'}_{_seasonal}",
        select(_winters_sql(_trend, _seasonal), FORECAST, "plain"),
    )
    def _(spark, d, trend=_trend, seasonal=_seasonal):
        return rounded(forecast.forecast(
            monthly(spark, d), BY, "exponential_smoothing", H, gaps=False, trend=trend, seasonal=seasonal
        ))


@query(
    "forecast_daily_events",
    """WITH s AS (SELECT event_type, CAST(ts AS DATE) AS date, avg(value) AS value FROM events GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY date DESC) AS back FROM s),
       m AS (SELECT event_type, avg(value) AS value, max(date) AS final FROM r WHERE back <= 7 GROUP BY 1)
       SELECT event_type, CAST(final + CAST(i AS INTEGER) AS DATE) AS date, floor(value * 1e4 + 0.4321) / 1e4 AS value
       FROM m, generate_series(1, 12) AS t(i)""",
)
def _(spark, d):
    daily = series.to_series(daily_events(spark, d), "value", ["event_type"])
    return rounded(forecast.forecast(daily, ["event_type"], "moving_average", H, gaps=False, window_size=7))


def _both_sql(keys="country"):
    """Plain forecasts of both measures side by side in CTEs ``p`` and ``l``."""
    by = f"{keys}, " if keys else ""
    out = [HISTORY]
    for name, value in (("p", "price"), ("l", "lead_time")):
        body = _moving_sql(keys, 3, base=series_sql(value, keys).removeprefix(HISTORY + ", "))
        out.append(f"{name} AS (WITH {body} SELECT {by}date, value AS {value} FROM plain)")
    return ", ".join(out)


BOTH = _both_sql()


def both(spark, d, keys=("country",), **options):
    found = forecast_measures(history(spark, d), list(keys), H, freq="month", **options)
    return found["price"], found["lead_time"]


@query("forecast_measures_price", select(BOTH, "country date price~", "p"))
def _(spark, d):
    return rounded(both(spark, d)[0])


@query("forecast_measures_lead_time", select(BOTH, "country date lead_time~", "l"))
def _(spark, d):
    return rounded(both(spark, d)[1])


@query("forecast_overall", select(_both_sql(""), "date price~ lead_time~", "p JOIN l USING (date)"))
def _(spark, d):
    return rounded(compare.combine_measures(*both(spark, d, keys=())))


@query(
    "forecast_errors",
    f"""WITH {DIRTY}, g AS (SELECT part_number, vendor, count(price) AS p FROM dirty GROUP BY ALL)
        SELECT part_number, vendor, 'price' AS measure, 'no data' AS error FROM g WHERE p = 0""",
)
def _(spark, d):
    return forecast_measures(dirty_history(spark, d), ["part_number", "vendor"])["errors"]


_ORDERED = HISTORY + """, ordered AS (
  SELECT country, price, row_number() OVER w - 1 AS pos, abs(price - lag(price) OVER w) AS step
  FROM history WINDOW w AS (PARTITION BY country ORDER BY date, price)),
rules AS (
  SELECT country, greatest(0, min(price) - 0.1::DOUBLE * (max(price) - min(price))) AS min_value,
         max(price) + 0.1::DOUBLE * (max(price) - min(price)) AS max_value,
         quantile_cont(step, 0.95::DOUBLE) AS smoothness_factor,
         CASE WHEN count(*) >= 6 AND abs(regr_slope(price, pos)) > 0.01 * avg(price) THEN
           CASE WHEN regr_slope(price, pos) > 0 THEN 'increasing' ELSE 'decreasing' END END AS monotonic
  FROM ordered GROUP BY 1)"""


@query(
    "derive_constraints",
    select(
        _ORDERED,
        ["country", "min_value~", "max_value~", "smoothness_factor~", "monotonic",
         "preserve_seasonality=CAST(NULL AS BOOLEAN)"],
        "rules",
    ),
)
def _(spark, d):
    return rounded(constrain.derive_constraints(history(spark, d), "price", BY))


@query(
    "derive_trend_constraints",
    f"""WITH {DIRTY}, s AS (SELECT part_number, lead_time,
          row_number() OVER (PARTITION BY part_number ORDER BY date, lead_time) - 1 AS pos FROM dirty)
        SELECT part_number, CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value,
          CAST(NULL AS DOUBLE) AS smoothness_factor, CASE WHEN count(*) >= 6
            AND abs(regr_slope(lead_time, pos)) > 0.01 * avg(lead_time) THEN
            CASE WHEN regr_slope(lead_time, pos) > 0 THEN 'increasing' ELSE 'decreasing' END END AS monotonic,
          CAST(NULL AS BOOLEAN) AS preserve_seasonality FROM s GROUP BY 1""",
)
def _(spark, d):
    return constrain.derive_constraints(dirty_history(spark, d), "lead_time", ["part_number"], "trend")


def seasonal_forecast(spark, d, keys=("vendor",)):
    found = monthly(spark, d, keys=keys)
    return found, forecast.forecast(found, list(keys), "seasonal_naive", H, gaps=False)


_SEASONAL = _seasonal_sql("vendor")
FITTED = ["vendor", "date", "value~", "status='optimal'"]


@query(
    "constrain_bounds",
    select(_SEASONAL, ["vendor", "date", "value~=least(greatest(value, 3000), 6000)", "status='optimal'"], "plain"),
)
def _(spark, d):
    rules = constrain.user_constraints(min_value=3000, max_value=6000)
    return rounded(constrain.constrain_forecast(seasonal_forecast(spark, d)[1], rules, ["vendor"]))


@query(
    "constrain_infeasible",
    select(_SEASONAL, ["vendor", "date", "value~", "status='infeasible'"], "plain"),
)
def _(spark, d):
    rules = constrain.user_constraints(min_value=6000, max_value=3000, smoothness_factor=10)
    return rounded(constrain.constrain_forecast(seasonal_forecast(spark, d)[1], rules, ["vendor"]))


def _monotone_sql(middle, low, direction="increasing"):
    """Largest over starts of the smallest over ends of the middle of each stretch."""
    order = "date" if direction == "increasing" else "date DESC"
    return _SEASONAL + f""", steps AS (
      SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY {order}) AS p,
             {low} AS lo, 1.5::DOUBLE * max(value) OVER (PARTITION BY vendor) AS hi FROM plain),
    stretches AS (
      SELECT a.vendor, a.p AS j, b.p AS k, {middle} AS m FROM steps a JOIN steps b
        ON a.vendor = b.vendor AND a.p <= b.p JOIN steps c ON c.vendor = a.vendor AND c.p BETWEEN a.p AND b.p
      GROUP BY ALL),
    least_end AS (
      SELECT s.vendor, s.p, j, min(m) AS m FROM steps s JOIN stretches t
        ON s.vendor = t.vendor AND j <= s.p AND k >= s.p GROUP BY ALL),
    fitted AS (
      SELECT s.vendor, date, least(greatest(max(m), any_value(lo)), any_value(hi)) AS value
      FROM steps s JOIN least_end e ON s.vendor = e.vendor AND s.p = e.p GROUP BY ALL)"""


_HALF = "0.5::DOUBLE * min(value) OVER (PARTITION BY vendor)"


@query(
    "constrain_monotone_absolute",
    select(_monotone_sql("quantile_disc(c.value, 0.5)", _HALF), FITTED, "fitted"),
)
def _(spark, d):
    rules = constrain.user_constraints(monotonic="increasing")
    return rounded(constrain.constrain_forecast(seasonal_forecast(spark, d)[1], rules, ["vendor"]))


@query(
    "constrain_monotone_squares",
    select(_monotone_sql("avg(c.value)", "0::DOUBLE", "decreasing"), FITTED, "fitted"),
)
def _(spark, d):
    rules = constrain.user_constraints(monotonic="decreasing")
    return rounded(
        constrain.constrain_forecast(seasonal_forecast(spark, d)[1], rules, ["vendor"], objective="lp")
    )


def _chain_sql(objective, horizon=H):
    """Least cost fit of ``problem`` (vendor, p, v, low, up, lo, hi; low and up limit the step
    from p to p + 1), by trying all sets of steps that stand at a limit.

    Between steps that do not, a run of values has one free height: its mean or one of its
    medians, moved inside the bounds. Runs are put together from left to right, the
    cheapest for each last run. CTE ``solved``: vendor, cost, xs.
    """
    height = {"l1": "unnest([us[(len(us) + 1) // 2], us[len(us) // 2 + 1]])", "l2": "list_avg(us)"}[objective]
    move = {"l1": "abs(u - c)", "l2": "(u - c) * (u - c)"}[objective]
    text = f""", grown AS (
      SELECT vendor, p AS a, p AS b, 0::DOUBLE AS off, [v] AS us, [0::DOUBLE] AS offs FROM problem
      UNION ALL
      SELECT g.vendor, a, n.p, off + s, list_append(us, n.v - (off + s)), list_append(offs, off + s)
      FROM grown g JOIN problem n ON n.vendor = g.vendor AND n.p = g.b + 1
      JOIN (SELECT vendor, p, unnest(list_distinct(list_filter([low, up], lambda x: isfinite(x)))) AS s FROM problem) l
        ON l.vendor = g.vendor AND l.p = g.b),
    heights AS (
      SELECT vendor, a, b, off, us, offs, {height} AS h
      FROM (SELECT vendor, a, b, off, list_sort(us) AS us, offs FROM grown)),
    runs AS (
      SELECT row_number() OVER () AS id, r.vendor, a, b, off, c, c + off AS final, list_transform(offs, lambda o: c + o) AS xs,
             list_sum(list_transform(us, lambda u: {move})) AS cost
      FROM (SELECT g.*, least(greatest(h, lo - list_min(offs)), hi - list_max(offs)) AS c, lo - list_min(offs) AS at_least
            FROM heights g JOIN problem q ON q.vendor = g.vendor AND q.p = g.a) r WHERE c >= at_least),
    upto1 AS (SELECT vendor, b, final, cost, xs FROM runs WHERE a = 1)"""
    for i in range(2, horizon + 1):
        text += f""", upto{i} AS (
      SELECT vendor, b, final, cost, xs FROM upto{i - 1} WHERE b >= {i}
      UNION ALL
      SELECT any_value(r.vendor), any_value(r.b), any_value(r.final), any_value(r.cost) + min(w.cost), arg_min(w.xs, w.cost) || any_value(r.xs)
      FROM runs r JOIN upto{i - 1} w ON w.vendor = r.vendor AND w.b = {i - 1} JOIN problem q ON q.vendor = r.vendor AND q.p = {i - 1}
      WHERE r.a = {i} AND r.c - w.final >= q.low - 1e-9 AND r.c - w.final <= q.up + 1e-9 GROUP BY r.id)"""
    return text + f""", solved AS (SELECT vendor, min(cost) AS cost, arg_min(xs, cost) AS xs FROM upto{horizon} GROUP BY 1)"""


def _problem_sql(low, up, lo, hi, joined=""):
    over = "OVER (PARTITION BY vendor)"
    lo, hi = lo.replace("OVER", over), hi.replace("OVER", over)
    return f""", problem AS (
      SELECT vendor, date, row_number() OVER (PARTITION BY vendor ORDER BY date) AS p, value AS v, {low}::DOUBLE AS low, {up}::DOUBLE AS up,
             {lo} AS lo, {hi} AS hi FROM plain {joined})"""


_ABSOLUTE = ("greatest(0, 0.5::DOUBLE * min(value) OVER)", "1.5::DOUBLE * max(value) OVER")
_SQUARES = ("0::DOUBLE", "1.5::DOUBLE * max(value) OVER")
SUMMARY = ["vendor", "cost~", "violation=0::DOUBLE", "status='optimal'"]


@query(
    "constrain_smoothness",
    select(_SEASONAL + _problem_sql("-250", "250", *_ABSOLUTE) + _chain_sql("l1"), SUMMARY, "solved"),
)
def _(spark, d):
    rules = constrain.user_constraints(smoothness_factor=250)
    return rounded(constrain.fit_summary(seasonal_forecast(spark, d)[1], rules, ["vendor"]))


@query(
    "constrain_smoothness_squares",
    select(
        _SEASONAL + _problem_sql("-250", "250", *_SQUARES) + _chain_sql("l2"),
        ["vendor", "date", "value~=xs[p]", "status='optimal'"],
        "problem JOIN solved USING (vendor)",
    ),
)
def _(spark, d):
    rules = constrain.user_constraints(smoothness_factor=250)
    return rounded(constrain.constrain_forecast(seasonal_forecast(spark, d)[1], rules, ["vendor"], "l2"))


_USUAL = """, usual AS (
      SELECT vendor, list(m ORDER BY month) AS season, sum(n) AS n
      FROM (SELECT vendor, month(date) AS month, avg(value) AS m, count(*) AS n FROM series GROUP BY ALL) GROUP BY 1),
    known AS (SELECT vendor, season FROM usual WHERE n >= 12 AND len(season) = 12)"""
_TURN = """CASE WHEN month(lead(date) OVER (PARTITION BY vendor ORDER BY date)) <> month(date)
      THEN season[month(date) % 12 + 1] - season[month(date)] ELSE 0 END"""


@query(
    "constrain_seasonality",
    select(
        _SEASONAL + _USUAL + _problem_sql(
            f"CASE WHEN {_TURN} > 0 THEN 0 ELSE '-inf'::DOUBLE END", f"CASE WHEN {_TURN} < 0 THEN 0 ELSE 'inf'::DOUBLE END", *_ABSOLUTE,
            "LEFT JOIN known USING (vendor)") + _chain_sql("l1"),
        SUMMARY,
        "solved",
    ),
)
def _(spark, d):
    past, ahead = seasonal_forecast(spark, d)
    rules = constrain.user_constraints(preserve_seasonality=True)
    return rounded(constrain.fit_summary(ahead, rules, ["vendor"], history=past))


_AUTO = _ORDERED.removeprefix(HISTORY).replace("country", "vendor")


@query(
    "constrain_auto",
    select(
        _SEASONAL + _AUTO + _problem_sql(
            "CASE WHEN monotonic = 'increasing' THEN 0 ELSE coalesce(-smoothness_factor, '-inf'::DOUBLE) END",
            "CASE WHEN monotonic = 'decreasing' THEN 0 ELSE coalesce(smoothness_factor, 'inf'::DOUBLE) END",
            f"coalesce(min_value, {_ABSOLUTE[0]})", f"coalesce(max_value, {_ABSOLUTE[1]})", "LEFT JOIN rules USING (vendor)") + _chain_sql("l1"),
        ["vendor", "measure='price'", *SUMMARY[1:]],
        "solved",
    ),
)
def _(spark, d):
    found = forecast_measures(
        history(spark, d), ["vendor"], H, "seasonal_naive", freq="month", constraints="auto", measures=("price",)
    )
    return rounded(found["fits"])


@query(
    "constrain_registered",
    select(
        _SEASONAL,
        ["vendor", "date", "value~=least(greatest(avg(value) OVER (PARTITION BY vendor), 0), 1.5 * max(value) OVER (PARTITION BY vendor))",
         "status='optimal'"],
        "plain",
    ),
)
def _(spark, d):
    """A rule of the user's own: no steps at all, which leaves the mean."""
    def level(dates, c):
        return F.transform(F.slice(dates, 2, F.size(dates)), lambda _: F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("up")))

    constrain.register_constraint("level", level)
    try:
        return rounded(constrain.constrain_forecast(seasonal_forecast(spark, d)[1], {}, ["vendor"], "l2"))
    finally:
        constrain.STEP_RULES.pop("level")


_HOLDOUT = _last_rows("country", 12) + """, rest AS (SELECT * FROM ranked WHERE back > 12),
level AS (SELECT country, avg(value) AS f FROM rest WHERE back <= 15 GROUP BY 1),
ends AS (SELECT country, max(date) AS final FROM rest GROUP BY 1)"""


@query(
    "evaluate_forecast",
    select(
        MONTHLY + _HOLDOUT + calendar_sql("country", H, "rest") + """, errors AS (
          SELECT a.country, f - t.value AS e, t.value AS y FROM ahead a JOIN level USING (country)
          JOIN tail t ON a.country = t.country AND a.date = t.date)""",
        ["country", "points=count(*)", "rmse~=sqrt(avg(e * e))", "mae~=avg(abs(e))", "mape~=avg(abs(e) / y * 100)"],
        "errors GROUP BY country",
    ),
)
def _(spark, d):
    train, test = evaluate.holdout(monthly(spark, d), BY, 12)
    ahead = forecast.forecast(train, BY, "moving_average", H, gaps=False)
    return rounded(evaluate.evaluate(ahead, test, BY, "all"))


PAIR = "country date price~ lead_time~"


@query("combine_measures", select(BOTH, PAIR, "p JOIN l USING (country, date)"))
def _(spark, d):
    return rounded(compare.combine_measures(*both(spark, d)))


@query(
    "combine_on_date",
    select(
        BOTH + ", o AS (SELECT date, avg(lead_time) AS lead_time FROM l GROUP BY 1)",
        PAIR, "p JOIN o USING (date)",
    ),
)
def _(spark, d):
    price, lead_time = both(spark, d)
    overall = lead_time.groupBy("date").agg(F.avg("lead_time").alias("lead_time"))
    return rounded(compare.combine_measures(price, overall, ["date"]))


@query(
    "tidy_measures",
    select(
        BOTH,
        "country date measure value~",
        """(SELECT country, date, 'price' AS measure, price AS value FROM p
            UNION ALL SELECT country, date, 'lead_time', lead_time FROM l)""",
    ),
)
def _(spark, d):
    return rounded(compare.tidy_measures(*both(spark, d), BY))


@query(
    "label_union",
    select(
        BOTH,
        "country date price~ data_source",
        """(SELECT country, date, price, 'Historical' AS data_source FROM history
            UNION ALL SELECT country, date, price, 'Forecast' FROM p)""",
    ),
)
def _(spark, d):
    rows = history(spark, d)
    return rounded(compare.label_union(rows, both(spark, d)[0], ["country", "date", "price"]))


@query(
    "label_union_lead_time",
    select(
        BOTH,
        "country date lead_time~ data_source",
        """(SELECT country, date, lead_time, 'Historical' AS data_source FROM history
            UNION ALL SELECT country, date, lead_time, 'Forecast' FROM l)""",
    ),
)
def _(spark, d):
    rows = history(spark, d)
    return rounded(compare.label_union(rows, both(spark, d)[1], ["country", "date", "lead_time"]))


@query(
    "label_union_measures",
    select(
        BOTH,
        "country date price~ lead_time~ data_source",
        """(SELECT country, date, price, lead_time, 'Historical' AS data_source FROM history
            UNION ALL SELECT country, date, price, NULL, 'Forecast' FROM p)""",
    ),
)
def _(spark, d):
    columns = ["country", "date", "price", "lead_time"]
    return rounded(compare.label_union(history(spark, d), both(spark, d)[0], columns))


_CHOSEN = "country IN ('NATION_1', 'NATION_2', 'NATION_3') AND date <= DATE '2001-12-31'"


@query("export_table", select(BOTH, PAIR, f"p JOIN l USING (country, date) WHERE {_CHOSEN}"))
def _(spark, d):
    chosen = {"country": ["NATION_1", "NATION_2", "NATION_3"]}
    return rounded(export.assemble(*both(spark, d), groups=chosen, end="2001-12-31"))


@query(
    "export_one_measure",
    select(BOTH, "date lead_time~", "l WHERE date >= DATE '2002-01-01'"),
)
def _(spark, d):
    lead = both(spark, d)[1]
    return rounded(export.assemble(None, lead, start="2002-01-01", columns=["date", "lead_time"]))


@query(
    "export_csv",
    f"""WITH {HISTORY} SELECT CAST(date AS VARCHAR) || ',' || part_number || ',' || vendor || ','
        || CAST(CAST(lead_time AS INTEGER) AS VARCHAR) AS line FROM history""",
)
def _(spark, d):
    rows = history(spark, d).select(
        "date", "part_number", "vendor", F.col("lead_time").cast("int").alias("lead_time")
    )
    return export.csv_lines(rows)


@query(
    "export_json",
    f"""WITH {DIRTY} SELECT '{{"date":"' || CAST(date AS VARCHAR) || '","part_number":"' || part_number
        || '","price":' || coalesce(CAST(CAST(floor(price) AS BIGINT) AS VARCHAR), 'null') || '}}' AS line FROM dirty""",
)
def _(spark, d):
    rows = dirty_history(spark, d).select(
        "date", "part_number", F.floor("price").cast("long").alias("price")
    )
    return export.json_lines(rows)


def _plain_history(spark, d):
    return history(spark, d).withColumn("quantity", F.col("quantity").cast("long"))


@query(
    "csv_round_trip",
    select(
        HISTORY,
        ["date", "part_number", "vendor", "country", "price~", "lead_time~", "quantity=CAST(quantity AS BIGINT)"],
        "history",
    ),
)
def _(spark, d):
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    export.write_csv(_plain_history(spark, d), path)
    return rounded(files.read_history(spark, path, schema=HISTORY_SCHEMA))


@query(
    "read_two_layouts",
    select(
        HISTORY,
        ["date", "part_number", "vendor=CASE WHEN CAST(quantity AS BIGINT) % 2 = 1 THEN vendor END", "price~",
         "lead_time~=CASE WHEN CAST(quantity AS BIGINT) % 2 = 0 THEN lead_time END"],
        "history",
    ),
)
def _(spark, d):
    """Files of two layouts in one folder: other columns, in another order."""
    path, rows = f"{shared_folder(spark)}/{uuid4().hex}", history(spark, d)
    odd = F.col("quantity").cast("long") % 2 == 1
    export.write_csv(rows.where(odd).select("date", "part_number", "vendor", "price"), f"{path}/a")
    export.write_csv(rows.where(~odd).select("lead_time", "price", "part_number", "date"), f"{path}/b")
    schema = T.StructType([f for f in HISTORY_SCHEMA if f.name not in ("country", "quantity")])
    return rounded(files.read_layouts(spark, f"{path}/*", schema=schema)[0])


@query("report_round_trip", select(BOTH, "country date price~", "p"))
def _(spark, d):
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    export.write_tables(export.report_tables(*both(spark, d), BY), path)
    return rounded(spark.read.parquet(f"{path}/price_forecast"))


@query("json_round_trip", select(HISTORY, ["date=CAST(date AS VARCHAR)", "part_number", "price~"], "history"))
def _(spark, d):
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    export.write_json(history(spark, d).select("date", "part_number", "price"), path)
    return rounded(spark.read.schema("date string, part_number string, price double").json(path))


@query(
    "report_metadata",
    f"""WITH {BOTH} SELECT '2024-01-01 00:00:00' AS creation_date, (SELECT count(*) FROM p) AS points,
        (SELECT count(*) FROM l) AS lead_time_points, 'date, price, lead_time, country' AS selected_columns,
        'Yes' AS includes_price, 'Yes' AS includes_lead_time, 'country' AS group_columns,
        'All Groups' AS group_option""",
)
def _(spark, d):
    return export.metadata(*both(spark, d), BY, created="2024-01-01")


def _overview_sql(title, cte, c):
    return f"""SELECT '{title}' AS metric, CAST(min(date) AS VARCHAR) || ' to ' || CAST(max(date) AS VARCHAR)
      AS date_range, count(*) AS points, floor(min({c}) * 1e4 + 0.4321) / 1e4 AS min, floor(max({c}) * 1e4 + 0.4321) / 1e4 AS max,
      floor(avg({c}) * 1e4 + 0.4321) / 1e4 AS mean FROM {cte}"""


@query(
    "report_overview",
    f"WITH {BOTH} {_overview_sql('Price Forecast', 'p', 'price')} UNION ALL "
    + _overview_sql("Lead Time Forecast", "l", "lead_time"),
)
def _(spark, d):
    return rounded(export.overview(*both(spark, d)))


def _stats_sql(c):
    return f"""floor(min({c}) * 1e4 + 0.4321) / 1e4 AS min, floor(max({c}) * 1e4 + 0.4321) / 1e4 AS max, floor(avg({c}) * 1e4 + 0.4321) / 1e4 AS mean,
      floor(stddev_samp({c}) * 1e4 + 0.4321) / 1e4 AS std, floor((max({c}) - min({c})) * 1e4 + 0.4321) / 1e4 AS "range", count({c}) AS count,
      floor(quantile_cont({c}, 0.5::DOUBLE) * 1e4 + 0.4321) / 1e4 AS median"""


@query(
    "report_statistics",
    f"""WITH {BOTH} SELECT 'Price' AS metric, {_stats_sql("price")} FROM p
        UNION ALL SELECT 'Lead Time', {_stats_sql("lead_time")} FROM l""",
)
def _(spark, d):
    return rounded(export.statistics(*both(spark, d)))


@query(
    "report_by_group",
    f"""WITH {BOTH} SELECT 'all' AS "group", '' AS key, {_stats_sql("price")} FROM p
        UNION ALL SELECT 'country', country, {_stats_sql("price")} FROM p GROUP BY country""",
)
def _(spark, d):
    return rounded(export.report_tables(*both(spark, d), BY)["price_by_group"])


@query(
    "report_group_values",
    f"""WITH {HISTORY} SELECT unnest(['country', 'vendor', 'part_number']) AS "column",
        unnest([count(DISTINCT country), count(DISTINCT vendor), count(DISTINCT part_number)]) AS distinct_values
        FROM history""",
)
def _(spark, d):
    return export.group_values(history(spark, d), ["country", "vendor", "part_number"])


@query("report_combined", select(BOTH, PAIR, "p JOIN l USING (country, date)"))
def _(spark, d):
    return rounded(export.report_tables(*both(spark, d), BY)["combined"])


@query(
    "top_forecast_groups",
    select(
        _moving_sql("vendor", 3) + """, top AS (
          SELECT vendor FROM plain GROUP BY 1 ORDER BY avg(value) DESC, vendor LIMIT 10)""",
        "vendor date value~",
        "plain WHERE vendor IN (SELECT vendor FROM top)",
    ),
)
def _(spark, d):
    by = ["vendor"]
    ahead = forecast.forecast(monthly(spark, d, keys=by), by, "moving_average", H, gaps=False)
    return rounded(compare.compare_over_time(ahead, compare.top_groups(ahead, "value", "vendor"), "vendor"))


@query("filter_forecast", select(BOTH, "country date price~", "p WHERE country = 'NATION_4'"))
def _(spark, d):
    return rounded(filters.filter_eq(both(spark, d)[0], {"country": "NATION_4"}))
