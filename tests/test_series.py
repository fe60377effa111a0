import numpy as np
import pandas as pd
import pytest

from quotecast.operators import series

RNG = np.random.default_rng(11)


def as_pandas(df, columns=("k", "date")):
    return df.toPandas().sort_values(list(columns)).reset_index(drop=True)


def random_series(index):
    return pd.Series(RNG.normal(100, 10, len(index)), index=pd.DatetimeIndex(index))


def test_mean_per_date_whatever_the_row_order(table):
    rows = [("a", pd.Timestamp(2024, 1, 1).date(), v) for v in (1.0, 2.0, 6.0, None)]
    rows += [("a", None, 9.0), (None, pd.Timestamp(2024, 1, 2).date(), 4.0)]
    df = table(rows, "k string, date date, value double")
    for layout in (df, df.orderBy("value").repartition(3)):
        got = {(r.k, str(r.date)): r.value for r in series.to_series(layout, "value", ["k"]).collect()}
        assert got == {("a", "2024-01-01"): 3.0, (None, "2024-01-02"): 4.0}


@pytest.mark.parametrize("freq, rule", [("week", "W"), ("month", "MS"), ("quarter", "QS")])
def test_resample_matches_pandas(series_of, freq, rule):
    days = pd.to_datetime("2024-01-03") + pd.to_timedelta(sorted(RNG.choice(400, 30, False)), "D")
    s = random_series(days)
    got = as_pandas(series.to_series(series_of(a=s), "value", ["k"], freq, fill_spine=True))
    want = s.resample(rule).mean()
    assert got.date.tolist() == [d.date() for d in want.index]
    np.testing.assert_allclose(got.value, want.to_numpy())


def test_interpolation_matches_pandas(series_of):
    s = random_series(pd.date_range("2024-01-01", periods=12))
    s.iloc[[0, 1, 4, 5, 6, 11]] = np.nan
    df = series_of(a=s, b=s[::-1].set_axis(s.index))
    got = as_pandas(series.interpolate(df, ["k"]))
    np.testing.assert_allclose(got[got.k == "a"].value, s.interpolate().bfill())
    inner = as_pandas(series.interpolate(df, ["k"], leading=False))
    np.testing.assert_allclose(inner[inner.k == "a"].value, s.interpolate())


def test_moving_averages_match_pandas(series_of):
    s = random_series(pd.date_range("2024-01-01", periods=12))
    short = s[:6]
    got = as_pandas(series.moving_averages(series_of(a=s, b=short), ["k"]))
    for w in (3, 6, 12):
        want = s.rolling(w).mean() if len(s) > w else pd.Series(np.nan, s.index)
        np.testing.assert_allclose(got[got.k == "a"][f"ma_{w}"].astype(float), want)
    assert got[got.k == "b"]["ma_6"].isna().all()
    assert got[got.k == "b"]["ma_3"].notna().sum() == 4


INDEXES = {
    "monthly": pd.date_range("2023-01-01", periods=14, freq="MS"),
    "month_end": pd.date_range("2023-01-31", periods=14, freq="ME"),
    "quarterly": pd.date_range("2020-02-01", periods=9, freq="QS-FEB"),
    "yearly": pd.date_range("2015-04-01", periods=5, freq="YS-APR"),
    "half_year": pd.date_range("2015-01-01", periods=5, freq="2QS"),
    "two_months": pd.date_range("2015-01-01", periods=5, freq="2MS"),
    "daily": pd.date_range("2024-02-20", periods=10),
    "every_third_day": pd.date_range("2024-02-20", periods=10, freq="3D"),
    "weekly": pd.date_range("2024-01-02", periods=10, freq="W-TUE"),
    "fortnightly": pd.date_range("2024-01-02", periods=10, freq="2W-TUE"),
    "business": pd.bdate_range("2024-01-03", periods=13),
}


@pytest.fixture(scope="module")
def regular(spark):
    rows = [(k, d.date(), 1.0) for k, ix in INDEXES.items() for d in ix]
    df = spark.createDataFrame(rows, "k string, date date, value double")
    return as_pandas(series.future_dates(df, ["k"], 7), ("k", "step"))


@pytest.mark.parametrize("name", INDEXES)
def test_dates_of_regular_series_match_pandas(regular, name):
    index = INDEXES[name]
    want = pd.date_range(index[-1] + pd.Timedelta(days=1), periods=7, freq=pd.infer_freq(index))
    got = regular[regular.k == name].date.tolist()
    assert got == [d.date() for d in want]


IRREGULAR = {
    ("2024-01-05",): ["2024-02-01", "2024-03-01"],
    ("2024-01-01", "2024-02-01"): ["2024-03-01", "2024-04-01"],
    ("2024-01-15", "2024-02-15", "2024-03-15"): ["2024-04-01", "2024-05-01"],
    ("2023-01-01", "2023-02-01", "2023-04-01"): ["2023-04-02", "2023-04-03"],
    ("2023-01-10", "2023-02-01", "2023-05-01"): ["2023-07-01", "2023-10-01"],
    ("2024-01-01", "2024-01-03", "2024-01-10"): ["2024-01-14", "2024-01-21"],
    ("2024-01-02", "2024-01-16", "2024-01-23"): ["2024-01-30", "2024-02-06"],
    ("2024-01-01", "2024-01-03", "2024-01-04"): ["2024-01-05", "2024-01-06"],
}


def test_dates_of_irregular_series(spark):
    rows = [
        (str(i), pd.Timestamp(d).date(), 1.0) for i, ds in enumerate(IRREGULAR) for d in ds
    ]
    df = spark.createDataFrame(rows, "k string, date date, value double")
    got = as_pandas(series.future_dates(df, ["k"], 2), ("k", "step"))
    for i, want in enumerate(IRREGULAR.values()):
        assert got[got.k == str(i)].date.map(str).tolist() == want


def test_dates_always_increase(regular):
    for _, part in regular.groupby("k"):
        assert part.date.is_monotonic_increasing and part.date.is_unique and len(part) == 7


def test_integer_index_continues(table):
    df = table([(3, 1.0), (9, 2.0)], "date long, value double")
    assert [r.date for r in series.future_dates(df, (), 3).collect()] == [10, 11, 12]
