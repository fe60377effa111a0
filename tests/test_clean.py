import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotecast.operators import anomaly, clean, scale

SCHEMA = "i long, g string, price double, other double, name string"


@pytest.fixture
def dirty(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        price = None if i % 7 == 0 or i in (1, 58, 59) else float(rng.lognormal(2, 1))
        other = None if i % 11 == 5 else float(rng.normal(0, 3)) * (20 if i % 13 == 0 else 1)
        name = None if i % 9 == 4 else "abc"[i % 3]
        rows.append((i, "xy"[i % 2], price, other, name))
    return spark.createDataFrame(rows, SCHEMA)


def as_pandas(df):
    return df.toPandas().sort_values("i").reset_index(drop=True)


def test_missing_strategies_match_pandas(dirty):
    raw = as_pandas(dirty)
    want = {
        "mean": raw.price.fillna(raw.price.mean()),
        "median": raw.price.fillna(raw.price.median()),
        "mode": raw.price.fillna(raw.price.mode().iloc[0]),
        "zero": raw.price.fillna(0),
        "interpolate": raw.price.interpolate().bfill().ffill(),
        "ffill": raw.price.ffill().bfill(),
        "bfill": raw.price.bfill().ffill(),
        "drop": raw.price.dropna(),
    }
    for how, expected in want.items():
        got = as_pandas(clean.clean(dirty, {"price": {"missing": how}}, order_by=["i"]))
        assert got.price.tolist() == pytest.approx(expected.tolist()), how


def test_fill_along_keys_and_in_chunks(dirty):
    raw = as_pandas(dirty)
    expected = raw.groupby("g").price.transform(lambda s: s.interpolate().bfill().ffill())
    for layout in (1, 7):
        got = clean.clean(
            dirty.repartition(layout), {"price": {"missing": "interpolate"}}, ["g"], ["i"]
        )
        assert as_pandas(got).price.tolist() == pytest.approx(expected.tolist())


def test_outlier_strategies_match_pandas(dirty):
    raw = as_pandas(dirty)
    q1, q3 = raw.other.quantile([0.25, 0.75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    tails = raw.other.quantile([0.05, 0.95]).tolist()
    base = raw[raw.price.notna()]
    want = {
        "clip": base.other.clip(lo, hi),
        "winsorize": base.other.clip(*tails),
        "remove": base.other[base.other.between(lo, hi)],
        "iqr": base.other[base.other.between(lo, hi)],
    }
    for how, expected in want.items():
        got = as_pandas(clean.clean(dirty, {"other": {"outlier": how}}))
        pd.testing.assert_series_equal(
            got.other, expected.reset_index(drop=True), check_names=False
        )


def test_price_bounds_do_not_go_below_zero(dirty):
    assert clean.outlier_bounds(dirty, ["price"])["price"]["fence"][0] == 0.0


def test_a_drop_changes_the_statistics_of_later_columns(dirty):
    config = {
        "other": {"missing": "mean", "outlier": "clip"},
        "name": {"missing": "drop"},
        "price": {"missing": "median", "outlier": "winsorize"},
    }
    got = as_pandas(clean.clean(dirty, config))
    want = as_pandas(dirty)
    want["other"] = want.other.fillna(want.other.mean())
    q1, q3 = want.other.quantile([0.25, 0.75])
    want["other"] = want.other.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    want = want.dropna(subset=["name"]).reset_index(drop=True)
    want["price"] = want.price.fillna(want.price.median())
    want["price"] = want.price.clip(*want.price.quantile([0.05, 0.95]))
    pd.testing.assert_frame_equal(got, want)


def test_default_config_and_fallbacks(dirty, table):
    config = clean.default_config(dirty)
    assert config["price"] == {"missing": "median", "outlier": "winsorize"}
    assert config["other"] == {"missing": "mean", "outlier": "clip"}
    assert config["name"] == {"missing": "mode"}
    empty = table([(1, None, None), (2, None, None)], "i long, other double, s string")
    filled = clean.clean(empty, {"other": {"missing": "mean"}})
    assert [r.other for r in filled.collect()] == [0.0, 0.0]
    assert clean.clean(empty, {"s": {"missing": "ffill"}}, order_by=["i"]).count() == 0
    with pytest.raises(ValueError):
        clean.clean(empty, {"s": {"missing": "mode"}})
    with pytest.raises(ValueError):
        clean.clean(empty, {"other": {"missing": "guess"}})


def test_default_cleaning_is_the_same_in_any_layout(dirty):
    small = as_pandas(clean.clean(dirty.repartition(1)))
    large = as_pandas(clean.clean(dirty.repartition(7)))
    pd.testing.assert_frame_equal(small, large)


def test_tied_order_gives_one_answer(spark):
    """Many rows share a date: the other columns complete the order, whatever the layout."""
    rows = spark.range(2000).select(
        F.expr("date_add(date'2024-01-01', cast(id % 5 as int))").alias("date"),
        (F.col("id") * 7919 % 2003).alias("part"),
        F.when(F.col("id") % 9 > 0, F.col("id") * 31 % 997).cast("double").alias("price"),
        F.lit(1.0).alias("lead_time"),
    )

    def filled(n):
        got = clean.clean(rows.repartition(n), {"price": {"missing": "interpolate"}})
        return sorted(map(tuple, got.collect()))

    assert filled(2) == filled(7)


def test_isolation_forest_is_the_same_in_any_layout(spark):
    rows = spark.range(40_000).select("id", (F.col("id") * 7919 % 10_007 / 3.0).alias("x"))

    def flagged(n):
        got = anomaly.flag_anomalies(rows.repartition(n), "x", "isolation_forest")
        return sorted(r.id for r in got.where("anomaly").collect())

    assert flagged(2) == flagged(7)


def test_isolation_forest_splits_a_hot_value(spark, monkeypatch):
    """One value in half of the rows is expanded range by range, with the same draws."""
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.col("id") % 101 / 3.0).alias("x"))

    def flagged():
        got = anomaly.flag_anomalies(rows, "x", "isolation_forest")
        return sorted(r.id for r in got.where("anomaly").collect())

    whole = flagged()
    monkeypatch.setattr(anomaly, "RANGE", 1000)
    assert flagged() == whole and whole


def test_cleaning_summary(dirty):
    rows = {r["column"]: r for r in clean.cleaning_summary(dirty, clean.clean(dirty)).collect()}
    assert rows["price"].raw_missing == as_pandas(dirty).price.isna().sum()
    assert rows["price"].clean_missing == 0
    assert rows["i"].raw_rows == 60


def test_scaling(dirty, table):
    raw = as_pandas(dirty).other
    q1, q3 = raw.quantile([0.25, 0.75])
    want = {
        "minmax": (raw - raw.min()) / (raw.max() - raw.min()),
        "zscore": (raw - raw.mean()) / raw.std(),
        "robust": (raw - raw.median()) / (q3 - q1),
    }
    for method, expected in want.items():
        got = as_pandas(scale.normalize(dirty, ["other", "name"], method)).other
        pd.testing.assert_series_equal(got, expected, check_names=False)
        flat = scale.normalize(table([(3.0,), (3.0,)], "x double"), method=method)
        assert [r.x for r in flat.collect()] == [0.0, 0.0]


def test_anomalies(dirty):
    raw = as_pandas(dirty).other
    z = ((raw - raw.mean()) / raw.std()).abs() > 2.0
    got = as_pandas(anomaly.flag_anomalies(dirty, "other", "zscore", 2.0)).anomaly
    assert got.tolist() == z.tolist()
    q1, q3 = raw.quantile([0.25, 0.75])
    want = (raw < q1 - 3 * (q3 - q1)) | (raw > q3 + 3 * (q3 - q1))
    got = as_pandas(anomaly.flag_anomalies(dirty, "other", "iqr")).anomaly
    assert got.tolist() == want.tolist()
    assert not any(as_pandas(anomaly.flag_anomalies(dirty, "name")).anomaly)


def test_isolation_forest_finds_far_values(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(50, 1, 1900), rng.uniform(200, 400, 100)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(6)
    flagged = anomaly.flag_anomalies(df, "v", "isolation_forest").toPandas()
    assert 0.03 < flagged.anomaly.mean() <= 0.05
    assert (flagged[flagged.anomaly].v > 100).mean() > 0.9
    again = anomaly.flag_anomalies(df, "v", "isolation_forest").toPandas()
    assert sorted(again[again.anomaly].v) == sorted(flagged[flagged.anomaly].v)


def test_filled_table_is_not_filled_again_by_later_steps(spark):
    rows = spark.range(200).select(
        F.lit("k").alias("k"), F.lit(1.0).alias("lead_time"), F.expr("date_add(DATE '2020-01-01', int(id))").alias("date"),
        F.when(F.col("id") % 10 != 5, F.col("id").cast("double")).alias("price"))
    done = clean.clean(rows, {"price": {"missing": "interpolate"}}, ["k"], ["date"])
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" not in plan
    assert sorted(r["price"] for r in done.collect()) == [float(i) for i in range(200)]
