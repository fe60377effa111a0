import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotecast.operators import forecast as models
from quotecast.operators.evaluate import evaluate, holdout
from quotecast.operators.series import to_series
from quotecast.plans.forecasting import forecast_measures

RNG = np.random.default_rng(4)
ALPHA, BETA, GAMMA = 0.3, 0.1, 0.1


def monthly(values, start="2020-01-01"):
    values = np.asarray(values, float)
    return pd.Series(values, pd.date_range(start, periods=len(values), freq="MS"))


def run(df, model, horizon=5, **params):
    got = models.forecast(df, ["k"], model, horizon, **params).toPandas().sort_values(["k", "date"])
    return {k: part.value.to_numpy() for k, part in got.groupby("k")}


def line(y):
    return np.polyfit(np.arange(1, 11), y[:10], 1)


def smoothing(y, h, trend=None, seasonal=None, m=12, phi=1.0):
    """Plain loop over the recursions, with the documented start values."""
    n = len(y)
    if seasonal and n < 2 * m:
        m = min(m, n // 2)
        seasonal = None if n <= 3 else seasonal
    off = np.subtract if seasonal == "add" else np.divide
    if seasonal and n >= 10 + 2 * (m // 2):
        cycles = max(min(5, n // m), -(-(10 + 2 * (m // 2)) // m))
        early = pd.Series(y[: m * cycles])
        weights = np.r_[0.5, np.ones(m - 1), 0.5] / m if m % 2 == 0 else np.ones(m) / m
        smooth = np.convolve(early, weights, "valid")
        inner = off(early.to_numpy()[m // 2 : len(early) - m // 2], smooth)
        place = (np.arange(len(inner)) + m // 2) % m
        s = np.array([inner[place == r].mean() for r in range(m)])
        s = list(off(s, s.mean()))
        b, l = line(smooth)
    elif seasonal:
        l, b = y[:m].mean(), (y[m : 2 * m] - y[:m]).mean() / m
        s = list(off(y[:m], l))
    elif n >= 10:
        b, l = line(y)
    else:
        l = y[0]
        b = (y[1] / y[0] if trend == "mul" else y[1] - y[0]) if n > 1 else 0.0
    if trend == "mul" and (seasonal is None and n >= 10 or seasonal and n >= 10 + 2 * (m // 2)):
        b = 1 + b / l
    move = {None: lambda l, b, t: l, "add": lambda l, b, t: l + b * t, "mul": lambda l, b, t: l * b**t}[trend]
    for v in y:
        e = move(l, b, phi)
        due = s.pop(0) if seasonal else None
        new = ALPHA * (off(v, due) if seasonal else v) + (1 - ALPHA) * e
        if trend == "add":
            b = BETA * (new - l) + (1 - BETA) * phi * b
        elif trend == "mul":
            b = BETA * (new / l) + (1 - BETA) * b**phi
        if seasonal:
            s.append(GAMMA * off(v, e) + (1 - GAMMA) * due)
        l = new
    times = np.cumsum(phi ** np.arange(1, h + 1))
    out = np.array([move(l, b, t) for t in times])
    if seasonal:
        again = np.resize(s, h)
        out = out + again if seasonal == "add" else out * again
    return out


LENGTHS = (2, 3, 4, 5, 8, 9, 10, 14, 21, 22, 25, 61)
CASES = [
    {}, {"trend": "add"}, {"trend": "mul"}, {"trend": "add", "damped_trend": True, "damping_trend": 0.9},
    {"trend": "mul", "damped_trend": True, "damping_trend": 0.9}, {"seasonal": "add"}, {"seasonal": "mul"},
    {"trend": "add", "seasonal": "add"}, {"trend": "add", "seasonal": "mul"},
    {"trend": "mul", "seasonal": "mul", "damped_trend": True, "damping_trend": 0.95},
    {"seasonal": "add", "seasonal_periods": 5},
]


@pytest.fixture(scope="module")
def many(spark):
    cases = {f"n{n}": RNG.uniform(5, 15, n).round(3) for n in LENGTHS}
    rows = [(k, d.date(), float(v)) for k, y in cases.items() for d, v in monthly(y).items()]
    return cases, spark.createDataFrame(rows, "k string, date date, value double")


@pytest.mark.parametrize("params", CASES, ids=str)
def test_smoothing_matches_plain_recursion(many, params):
    cases, df = many
    got = run(df, "exponential_smoothing", 15, **params)
    phi = params.get("damping_trend", 1.0)
    for k, y in cases.items():
        want = smoothing(
            y, 15, params.get("trend"), params.get("seasonal"), params.get("seasonal_periods", 12), phi
        )
        np.testing.assert_allclose(got[k], want, rtol=1e-9, err_msg=k)


def test_smoothing_fallbacks(series_of):
    y = RNG.uniform(-5, 5, 30)
    df = series_of(a=monthly(y))
    level = smoothing(y, 3)
    for params in (
        {"trend": "mul"},
        {"seasonal": "mul", "trend": "add"},
        {"damped_trend": True, "seasonal": "add"},
    ):
        np.testing.assert_allclose(run(df, "exponential_smoothing", 3, **params)["a"], level)
    one = run(series_of(a=monthly([4.0])), "exponential_smoothing", 3, trend="add", seasonal="add")
    assert list(one["a"]) == [4.0] * 3
    with pytest.raises(ValueError):
        run(df, "exponential_smoothing", trend="up")


def test_simple_models(series_of):
    y = np.arange(1.0, 16.0)
    df = series_of(a=monthly(y), b=monthly(y[:5]))
    assert run(df, "moving_average")["a"].tolist() == [14.0] * 5
    assert run(df, "moving_average", window_size=0)["a"].tolist() == [15.0] * 5
    assert run(df, "moving_average", window_size=99)["b"].tolist() == [3.0] * 5
    assert run(df, "Seasonal_Naive", 14)["a"].tolist() == [*y[-12:], *y[-12:-10]]
    assert run(df, "seasonal_naive", 7)["b"].tolist() == [1, 2, 3, 4, 5, 1, 2]
    with pytest.raises(ValueError, match="Unknown forecaster type"):
        run(df, "prophecy")


def test_naive_methods(series_of):
    y = np.arange(1.0, 16.0)
    df = series_of(a=monthly(y), b=monthly(y[:5]))

    def values(method):
        got = models.forecast_naive(df, ["k"], 13, method).toPandas().sort_values(["k", "date"])
        return {k: p.value.tolist() for k, p in got.groupby("k")}

    assert values("naive")["a"] == values("anything")["a"] == [15.0] * 13
    assert values("average")["b"] == [3.0] * 13
    assert values("seasonal_naive") == {"a": [*y[-12:], y[3]], "b": [5.0] * 13}


def test_gaps_are_filled_before_fitting(series_of):
    s = monthly([1, np.nan, 3, 4, np.nan])
    assert run(series_of(a=s), "moving_average", window_size=4)["a"][0] == (2 + 3 + 4 + 4) / 4


def test_row_order_does_not_matter(many):
    _, df = many
    a = run(df.orderBy("value").repartition(5), "exponential_smoothing", trend="add")
    b = run(df.orderBy(F.desc("date")).coalesce(1), "exponential_smoothing", trend="add")
    for k in a:
        np.testing.assert_array_equal(a[k], b[k])


def test_registered_model(series_of):
    models.register_forecaster("double_last", lambda v, h: F.array_repeat(F.get(v, F.size(v) - 1) * 2, h))
    try:
        assert run(series_of(a=monthly([1, 4])), "double_last", 2)["a"].tolist() == [8.0, 8.0]
        models.register_forecaster("nothing", lambda v, h: F.array_repeat(F.lit(None).cast("double"), h))
        assert run(series_of(a=monthly([1, 4])), "nothing", 2)["a"].tolist() == [4.0, 4.0]
    finally:
        models.FORECASTERS.pop("double_last"), models.FORECASTERS.pop("nothing", None)


def test_registered_python_model(series_of):
    def build(v, horizon):
        @F.pandas_udf("array<double>")
        def trimmed(values: pd.Series) -> pd.Series:
            return values.map(lambda y: [float(np.median(y))] * horizon)

        return trimmed(v)

    models.register_forecaster("median", build)
    try:
        assert run(series_of(a=monthly([1, 9, 2])), "median", 2)["a"].tolist() == [2.0, 2.0]
    finally:
        models.FORECASTERS.pop("median")


@pytest.fixture
def history(table):
    rows = []
    for i, g in enumerate(["a", "b", None]):
        for t, d in enumerate(pd.date_range("2022-01-01", periods=30, freq="MS")):
            rows.append((d.date(), g, 10.0 + i + t % 12, 20.0 - t / 10))
            rows.append((d.date(), g, 12.0 + i + t % 12, None if g == "b" else 22.0))
    return table(rows, "date date, vendor string, price double, lead_time double")


def test_measures_per_group(history, table):
    hollow = table([(pd.Timestamp(2022, 1, 1).date(), "c", None, 4.0)], history.schema)
    out = forecast_measures(history.unionByName(hollow), ["vendor"], 6, models={"price": "seasonal_naive"})
    price = out["price"].toPandas().sort_values(["vendor", "date"])
    assert price.columns.tolist() == ["vendor", "date", "price"]
    assert price.groupby("vendor").size().to_dict() == {"a": 6, "b": 6}
    assert price[price.vendor == "a"].price.tolist() == [11.0 + t % 12 for t in range(30 - 12, 30 - 6)]
    lead = out["lead_time"].toPandas()
    assert set(lead.vendor) == {"a", "b", "c"}
    assert [tuple(r) for r in out["errors"].collect()] == [("c", "price", "no data")]


def test_unknown_groups_are_ignored(history):
    assert forecast_measures(history, ["planet"], 3)["price"].columns == ["date", "price"]
    assert forecast_measures(history, (), 3)["price"].count() == 3


def test_automatic_constraints_apply(history):
    out = forecast_measures(history, ["vendor"], 6, models="seasonal_naive", constraints="auto")
    rows = out["price"].toPandas()
    assert set(rows.status) == {"optimal"}
    rules = {"price": {"min_value": 15.0, "max_value": 16.0}}
    held = forecast_measures(history, ["vendor"], 6, constraints=rules)
    assert held["price"].toPandas().price.between(15, 16).all()
    assert "status" not in held["lead_time"].columns


def test_evaluation(series_of):
    actual = series_of(a=monthly([1, 2, 0, 4]), b=monthly([5.0], "2030-01-01"))
    guess = series_of(a=monthly([2, 2, 1, 2, 9]), b=monthly([5.0]))
    row = evaluate(guess, actual, ["k"], "all").collect()
    assert len(row) == 1 and row[0].points == 4
    assert row[0].rmse == pytest.approx(np.sqrt(6 / 4))
    assert row[0].mae == pytest.approx(1.0)
    assert row[0].mape == pytest.approx(50.0)
    none = evaluate(guess.where("k = 'b'"), actual.where("k = 'b'"))
    assert none.first().rmse is None
    with pytest.raises(ValueError):
        evaluate(guess, actual, ["k"], "r2")
    train, test = holdout(actual, ["k"], 3)
    assert train.count() == 1 and test.count() == 4


def test_series_of_text_numbers(table):
    df = table([("a", pd.Timestamp(2024, 1, 1).date(), "2.5")], "k string, date date, price string")
    assert to_series(df, "price", ["k"]).first().value == 2.5
