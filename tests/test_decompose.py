import numpy as np
import pandas as pd
import pytest

from quotecast.operators.decompose import decompose
from quotecast.operators.features import autocorrelations, detect_period, features, seasonality_profile

RNG = np.random.default_rng(7)


def wave(n, period=12, noise=1.0, start="2015-01-01", freq="MS"):
    index = pd.date_range(start, periods=n, freq=freq)
    t = np.arange(n)
    return pd.Series(
        100 + 0.5 * t + 10 * np.sin(2 * np.pi * t / period) + RNG.normal(0, noise, n), index=index
    )


def classical(y, p, multiplicative=False):
    """Plain numpy restatement of the definition."""
    n, h = len(y), p // 2
    weights = np.r_[0.5, np.ones(p - 1), 0.5] / p if p % 2 == 0 else np.ones(p) / p
    trend = np.full(n, np.nan)
    trend[h : n - h] = np.convolve(y, weights, "valid")
    front, back = h, n - 1 - h
    for xs, where in (
        (np.arange(front, min(front + p, back)), np.arange(front)),
        (np.arange(max(front, back - p), back), np.arange(back + 1, n)),
    ):
        fit = np.linalg.lstsq(np.c_[xs, np.ones(len(xs))], trend[xs], rcond=None)[0]
        trend[where] = fit[0] * where + fit[1]
    loose = y / trend if multiplicative else y - trend
    means = np.array([loose[i::p].mean() for i in range(p)])
    means = means / means.mean() if multiplicative else means - means.mean()
    seasonal = np.resize(means, n)
    rest = loose / seasonal if multiplicative else loose - seasonal
    return trend, seasonal, rest


@pytest.mark.parametrize("model", ["additive", "multiplicative"])
def test_classical_matches_definition(series_of, model):
    cases = {f"n{n}": wave(n) for n in (4, 5, 6, 7, 11, 23, 24, 25, 60)}
    got = decompose(series_of(**cases), ["k"], model=model).toPandas()
    for k, s in cases.items():
        n = len(s)
        p = 12 if n >= 24 else max(2, min(12, n // 2))
        part = got[got.k == k].sort_values("date")
        want = classical(s.to_numpy(), p, model == "multiplicative")
        for column, expected in zip(("trend", "seasonal", "residual"), want):
            np.testing.assert_allclose(part[column], expected, rtol=1e-8, atol=1e-8, err_msg=f"{k} {column}")


@pytest.mark.parametrize("method", ["classical", "simple"])
def test_parts_add_up(series_of, method):
    got = decompose(series_of(a=wave(50), b=wave(9)), ["k"], method=method).toPandas()
    np.testing.assert_allclose(got.trend + got.seasonal + got.residual, got.original)


def test_simple_matches_pandas(series_of):
    s = wave(40)
    trend = s.rolling(12, center=True).mean().interpolate().bfill().ffill()
    loose = s - trend
    seasonal = loose.groupby(np.arange(40) % 12).transform("mean")
    got = decompose(series_of(a=s), ["k"], method="simple").toPandas().sort_values("date")
    np.testing.assert_allclose(got.trend, trend)
    np.testing.assert_allclose(got.seasonal, seasonal)


def test_what_the_classical_form_cannot_do_falls_back(series_of):
    negative = wave(40) - 200
    got = decompose(series_of(a=negative, b=wave(3), c=wave(1)), ["k"], model="multiplicative")
    rows = got.toPandas().sort_values("date")
    trend = negative.rolling(12, center=True).mean().interpolate().bfill().ffill()
    np.testing.assert_allclose(rows[rows.k == "a"].trend, trend)
    assert rows[rows.k == "b"].trend.notna().all()
    assert rows[rows.k == "c"].trend.isna().all()


def test_gaps_are_interpolated_first(series_of):
    s = wave(40)
    holed = s.copy()
    holed.iloc[[5, 6, 39]] = np.nan
    got = decompose(series_of(a=holed), ["k"]).toPandas().sort_values("date")
    np.testing.assert_allclose(got.original, holed.interpolate())


def test_features_match_pandas(series_of):
    cases = {"long": wave(50, noise=4), "short": wave(9), "flat": wave(20) * 0 + 3.0}
    cases |= {"two": wave(2), "one": wave(1)}
    got = features(series_of(**cases), ["k"]).toPandas().set_index("k")
    for k, s in cases.items():
        row, n = got.loc[k], len(s)
        assert row["mean"] == pytest.approx(s.mean())
        assert row["median"] == pytest.approx(s.median())
        if n > 1:
            assert row["std"] == pytest.approx(s.std())
            assert row.volatility == pytest.approx(s.std() / s.mean())
            slope, base = np.polyfit(np.arange(n), s.to_numpy(), 1)
            assert row.trend_slope == pytest.approx(slope, abs=1e-9)
        if k in ("long", "short"):
            rest = s - (slope * np.arange(n) + base)
            assert row.trend_strength == pytest.approx(1 - (rest**2).sum() / ((s - s.mean()) ** 2).sum())
            assert row.autocorrelation_lag1 == pytest.approx(s.autocorr(1))
            _, seasonal, _ = classical(s.to_numpy(), 12 if n >= 24 else max(2, n // 2))
            seasonal = pd.Series(seasonal, s.index)
            assert row.seasonal_amplitude == pytest.approx((seasonal.max() - seasonal.min()) / 2)
            own, other = seasonal.var(), (s - seasonal).var()
            assert row.seasonal_strength == pytest.approx(own / (own + other))
    by_month = pd.Series(classical(cases["long"].to_numpy(), 12)[1], cases["long"].index)
    by_month = by_month.groupby(by_month.index.month).mean()
    assert got.loc["long"].peak_month == by_month.idxmax()
    assert got.loc["long"].trough_month == by_month.idxmin()
    assert got.loc["long"].autocorrelation_seasonal == pytest.approx(cases["long"].autocorr(12))
    assert got.loc["short"].autocorrelation_seasonal == 0
    assert np.isnan(got.loc["short"].peak_month)
    assert got.loc["two"].recent_trend == got.loc["one"].trend_direction == "unknown"
    assert np.isnan(got.loc["flat"].trend_strength)
    assert got.loc["flat"].seasonal_strength == 0


def test_one_series_without_keys(series_of):
    df = series_of(a=wave(60, noise=0.1))
    for found in (features, detect_period, seasonality_profile):
        (one,), (keyed,) = found(df.drop("k")).collect(), found(df, ["k"]).collect()
        assert one.asDict() == {c: v for c, v in keyed.asDict().items() if c != "k"}


def test_recent_trend(series_of):
    index = pd.date_range("2024-01-01", periods=4)
    cases = {"up": [9, 1, 2, 3], "down": [0, 3, 2, 1], "mixed": [1, 2, 2, 3]}
    df = series_of(**{k: pd.Series(v, index) for k, v in cases.items()})
    got = {r.k: r.recent_trend for r in features(df, ["k"]).collect()}
    assert got == {"up": "increasing", "down": "decreasing", "mixed": "mixed"}


def expected_period(s, max_lag=24):
    """The rule stated over pandas autocorrelations, for series without a calendar default."""
    if len(s) < max_lag * 2:
        max_lag = len(s) // 2
    if max_lag < 2:
        return 1
    acf = [s.autocorr(k) for k in range(1, max_lag + 1)]
    peaks = [
        (acf[i], -(i + 1)) for i in range(1, len(acf) - 1)
        if acf[i] > max(acf[i - 1], acf[i + 1], 0.2)
    ]
    return -max(peaks)[1] if peaks else None


def test_periods(series_of):
    noise = pd.Series(RNG.normal(size=30).cumsum(), pd.date_range("2024-01-01", periods=30))
    cases = {
        "year": wave(60), "half": wave(60, 6), "week": wave(100, 7, freq="D"), "walk": noise,
        "monthly": pd.Series(np.arange(20.0), pd.date_range("2024-01-01", periods=20, freq="MS")),
        "quarterly": pd.Series(np.arange(20.0), pd.date_range("2024-01-01", periods=20, freq="QS")),
        "tiny": wave(3),
    }
    got = {r.k: r.period for r in detect_period(series_of(**cases), ["k"]).collect()}
    for k, s in cases.items():
        default = {"monthly": 12, "quarterly": 4}.get(k, 1)
        assert got[k] == (expected_period(s) or default), k
    acf = {r.lag: r.acf for r in autocorrelations(series_of(a=cases["year"]), ["k"]).collect()}
    assert acf[7] == pytest.approx(cases["year"].autocorr(7))


def test_seasonality_profile(series_of):
    s = wave(60, noise=0.1)
    df = series_of(a=s, b=wave(11), c=wave(100, 7, freq="D"))
    got = {r.k: r for r in seasonality_profile(df, ["k"]).collect()}
    assert set(got) == {"a", "c"}
    seasonal = pd.Series(classical(s.to_numpy(), 12)[1], s.index)
    by_month = seasonal.groupby(s.index.month).mean()
    assert got["a"].period == 12 and got["c"].pattern is None
    assert got["a"].peak_month == by_month.idxmax()
    assert got["a"].pattern[3] == pytest.approx(by_month[3] / s.mean() * 100)


def test_one_pass_over_folded_series(series_of):
    """Each of these shuffles once, for the fold, and needs no window or join."""
    df = series_of(a=wave(60), b=wave(30))
    for found in (features, detect_period, seasonality_profile):
        plan = found(df, ["k"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan and "Generate" not in plan


def test_features_with_gaps(series_of):
    """Missing values are no part of statistics and pairs, but keep their places."""
    s = wave(40)
    s.iloc[[0, 3, 20, 39]] = np.nan
    row = features(series_of(a=s), ["k"]).first()
    assert (row["n"], row["mean"], row["median"]) == (40, pytest.approx(s.mean()), pytest.approx(s.median()))
    assert row["std"] == pytest.approx(s.std())
    assert row.autocorrelation_lag1 == pytest.approx(s.autocorr(1))
    assert row.autocorrelation_seasonal == pytest.approx(s.autocorr(12))
    known = s.dropna()
    assert row.trend_slope == pytest.approx(np.polyfit(np.flatnonzero(s.notna()), known.to_numpy(), 1)[0])
    assert row.recent_trend == "mixed"
