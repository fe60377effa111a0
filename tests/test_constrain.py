import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotecast.operators import constrain
from quotecast.plans.registry import rounded

RNG = np.random.default_rng(9)


def monthly(values, start="2024-01-01"):
    return pd.Series(np.asarray(values, float), pd.date_range(start, periods=len(values), freq="MS"))


def fitted(df, rules, **options):
    got = constrain.constrain_forecast(df, rules, ["k"], **options).toPandas()
    got = got.sort_values(["k", "date"])
    return {k: p.value.to_numpy() for k, p in got.groupby("k")}, set(got.status)


@pytest.fixture(scope="module")
def small(spark):
    cases = {f"s{i}": RNG.integers(0, 9, int(RNG.integers(1, 6))) for i in range(25)}
    rows = [(k, d.date(), float(v)) for k, y in cases.items() for d, v in monthly(y).items()]
    return cases, spark.createDataFrame(rows, "k string, date date, value double")


def brute(y, allowed, lo, hi, cost):
    grid = range(lo, hi + 1)
    return min(
        sum(cost(a - b) for a, b in zip(x, y))
        for x in itertools.product(grid, repeat=len(y))
        if all(allowed(b - a) for a, b in zip(x, x[1:]))
    )


RULES = {
    "increasing": ({"monotonic": "increasing"}, lambda s: s >= 0),
    "decreasing": ({"monotonic": "decreasing"}, lambda s: s <= 0),
    "smooth": ({"smoothness_factor": 2.0}, lambda s: abs(s) <= 2),
    "both": ({"smoothness_factor": 1.0, "monotonic": "increasing"}, lambda s: 0 <= s <= 1),
}


@pytest.mark.parametrize("name", RULES)
def test_least_absolute_fit(small, name):
    cases, df = small
    rule, allowed = RULES[name]
    got, status = fitted(df, {"min_value": 1.0, "max_value": 7.0, **rule})
    assert status == {"optimal"}
    for k, y in cases.items():
        x = got[k]
        assert len(x) == len(y) and x.min() >= 1 and x.max() <= 7
        assert all(allowed(round(s, 9)) for s in np.diff(x))
        assert np.abs(x - y).sum() == pytest.approx(brute(y, allowed, 1, 7, abs)), k


@pytest.mark.parametrize("name", RULES)
def test_least_squares_fit(small, name):
    cases, df = small
    rule, allowed = RULES[name]
    got, _ = fitted(df, {"min_value": 1.0, "max_value": 7.0, **rule}, objective="lp")
    for k, y in cases.items():
        x = got[k]
        assert x.min() >= 1 - 1e-9 and x.max() <= 7 + 1e-9
        assert all(allowed(round(s, 9)) for s in np.diff(x))
        cost = ((x - y) ** 2).sum()
        assert cost <= brute(y, allowed, 1, 7, lambda d: d * d) + 1e-9
        for _ in range(20):
            other = np.clip(x + RNG.normal(scale=0.03, size=len(x)), 1, 7)
            if all(allowed(s) for s in np.diff(other)):
                assert ((other - y) ** 2).sum() >= cost - 1e-9


def test_increasing_fit_is_the_isotonic_regression(small):
    """Least squares: the largest over starts of the smallest over ends of the means."""
    raw, df = small
    rule = {"monotonic": "increasing", "min_value": -100.0, "max_value": 100.0}
    squares, _ = fitted(df, rule, objective="l2")
    absolute, _ = fitted(df, rule, objective="l1")
    for k, x in squares.items():
        y = np.asarray(raw[k], dtype=float)
        n = len(y)
        want = [
            max(min(y[j:e + 1].mean() for e in range(i, n)) for j in range(i + 1)) for i in range(n)
        ]
        np.testing.assert_allclose(x, want, atol=1e-9)
        medians = [
            max(min(np.sort(y[j:e + 1])[(e - j) // 2] for e in range(i, n)) for j in range(i + 1))
            for i in range(n)
        ]
        assert np.abs(absolute[k] - y).sum() == pytest.approx(np.abs(np.array(medians) - y).sum())


def test_default_bounds(series_of):
    df = series_of(a=monthly([2, 10, 4]))
    got, _ = fitted(df, {})
    assert got["a"].tolist() == [2, 10, 4]
    assert fitted(series_of(a=monthly([-2, 10])), {})[0]["a"].tolist() == [0, 10]
    assert fitted(series_of(a=monthly([2, 10])), {"max_value": 1.0, "min_value": 0.0})[0]["a"].tolist() == [1, 1]


def test_contradicting_rules_keep_the_forecast(series_of):
    df = series_of(a=monthly([2, 10, 4]))
    for rules in ({"min_value": 5.0, "max_value": 3.0}, {"smoothness_factor": -1.0}):
        got, status = fitted(df, rules)
        assert got["a"].tolist() == [2, 10, 4] and status == {"infeasible"}


def test_seasonal_direction(series_of):
    usual = [5, 6, 7, 8, 9, 8, 7, 6, 5, 4, 3, 4]
    history = series_of(a=monthly(usual * 2, "2020-01-01"), b=monthly(usual[:11], "2020-01-01"))
    wild = RNG.uniform(2, 9, 12)
    df = series_of(a=monthly(wild), b=monthly(wild))
    got, _ = fitted(df, {"preserve_seasonality": True}, history=history)
    signs = np.sign(np.diff(usual))
    assert (np.diff(got["a"]) * signs >= -1e-9).all()
    np.testing.assert_allclose(got["b"], np.clip(wild, wild.min() / 2, None))
    loose, _ = fitted(df, {"preserve_seasonality": True}, history=history, objective="l2")
    np.testing.assert_allclose(loose["a"], wild)


def test_rules_per_key(series_of, table):
    df = series_of(a=monthly([1, 9]), b=monthly([9, 1]), c=monthly([1, 9]))
    rules = table(
        [("a", None, None, 2.0, None, None), ("b", None, 5.0, None, "increasing", None)],
        "k string, min_value double, max_value double, smoothness_factor double, monotonic string, preserve_seasonality boolean",
    )
    got, _ = fitted(df, rules)
    assert abs(got["a"][1] - got["a"][0]) <= 2
    assert got["b"][0] == got["b"][1] <= 5
    assert got["c"].tolist() == [1, 9]


def test_rules_without_keys(series_of, raw):
    past = series_of(a=monthly([5, 6, 7, 8, 9, 8, 7, 6, 5, 4, 3, 4] * 2, "2020-01-01")).drop("k")
    ahead = series_of(a=monthly([4, 9, 1])).drop("k")
    rules = constrain.derive_constraints(raw, "price")
    for given in (rules, {"preserve_seasonality": True, "smoothness_factor": 100.0}):
        got = constrain.constrain_forecast(ahead, given, history=past).toPandas()
        assert len(got) == 3 and set(got.status) == {"optimal"}
    assert got.sort_values("date").value.diff().dropna().ge(0).all()
    short = constrain.constrain_forecast(ahead, {"preserve_seasonality": True}, history=past.limit(5))
    assert sorted(r.value for r in short.collect()) == [1.0, 4.0, 9.0]


def test_registered_rule(series_of):
    def flat(d, c):
        zero = F.lit(0.0)
        return F.transform(constrain._steps(d), lambda i: constrain._limits(zero, zero))

    constrain.register_constraint("flat", flat)
    try:
        got, _ = fitted(series_of(a=monthly([1, 5, 6])), {})
        assert got["a"].tolist() == [5, 5, 5]
    finally:
        constrain.STEP_RULES.pop("flat")


def test_unknown_names(series_of):
    df = series_of(a=monthly([1]))
    with pytest.raises(ValueError, match="Unknown optimizer type"):
        constrain.constrain_forecast(df, {}, ["k"], "simplex")
    with pytest.raises(ValueError):
        constrain.derive_constraints(df, "value", ["k"], "magic")


@pytest.fixture
def raw(table):
    rows = []
    for k, n in (("a", 40), ("b", 5), ("c", 30)):
        for t in range(n):
            slope = {"a": 3.0, "b": 1.0, "c": 0.0}[k]
            rows.append((k, pd.Timestamp(2024, 1, 1 + t // 2).date(), 50 + slope * t + float(RNG.normal())))
    return table(rows, "k string, date date, price double")


@pytest.mark.parametrize("layout", [1, 7])
def test_derived_constraints(raw, layout):
    raw = raw.repartition(layout)
    got = {r.k: r for r in constrain.derive_constraints(raw, "price", ["k"]).collect()}
    for k, part in raw.toPandas().sort_values(["date", "price"]).groupby("k"):
        y, row = part.price, got[k]
        span = y.max() - y.min()
        assert row.min_value == pytest.approx(max(0, y.min() - 0.1 * span))
        assert row.max_value == pytest.approx(y.max() + 0.1 * span)
        assert row.smoothness_factor == pytest.approx(y.diff().abs().quantile(0.95))
        slope = np.polyfit(np.arange(len(y)), y, 1)[0]
        trend = ("increasing" if slope > 0 else "decreasing") if abs(slope) > 0.01 * y.mean() else None
        assert row.monotonic == (trend if len(y) >= 6 else None)


def test_kinds_and_user_rules(raw):
    bounds = constrain.derive_constraints(raw, "price", ["k"], "bounds").first()
    assert bounds.min_value is not None and bounds.smoothness_factor is None
    smooth = constrain.derive_constraints(raw, "price", [], "smoothness").first()
    assert smooth.smoothness_factor is not None and smooth.min_value is None
    assert set(constrain.user_constraints().values()) == {None}
    rules = constrain.user_constraints(1, 0, 2.5, "increasing", True)
    assert rules["max_value"] is None and rules["preserve_seasonality"] is True


def test_comparison_rounding(table):
    assert rounded(table([(-0.00001, "x")], "v double, s string")).first().v == 0.0
