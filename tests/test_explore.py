import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotecast.operators import compare, explore
from quotecast.plans import export

RNG = np.random.default_rng(21)


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for i in range(240):
        price = None if i % 17 == 0 else float(RNG.lognormal(3, 0.6))
        data.append((
            pd.Timestamp(2024, 1 + i % 6, 1).date(), "abc"[i % 3], None if i % 31 == 0 else f"v{i % 4}",
            price, float(RNG.integers(5, 60)), 7,
        ))
    schema = "date date, country string, vendor string, price double, lead_time double, quantity int"
    return spark.createDataFrame(data, schema).repartition(6)


@pytest.fixture(scope="module")
def frame(rows):
    return rows.toPandas()


def indexed(df, *by):
    return df.toPandas().set_index(list(by)).sort_index()


def test_describe(rows, frame):
    got = indexed(explore.describe(rows), "column")
    want = frame[["price", "lead_time", "quantity"]].describe().T.sort_index()
    want.columns = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    np.testing.assert_allclose(got[want.columns].astype(float), want)


def test_missing_table(rows, frame):
    got = [(r["column"], r.missing) for r in explore.missing_table(rows).collect()]
    assert got == [("price", frame.price.isna().sum()), ("vendor", frame.vendor.isna().sum())]


def test_histogram(rows, frame):
    got = explore.histogram(rows, "price", 12).toPandas().sort_values("bin")
    counts, edges = np.histogram(frame.price.dropna(), 12)
    assert got["count"].tolist() == [c for c in counts if c]
    np.testing.assert_allclose(got.lower, edges[:-1][counts > 0])
    assert (got.density * (got.upper - got.lower)).sum() == pytest.approx(1)


def test_histogram_of_one_value(table):
    got = explore.histogram(table([(3.0,), (3.0,)], "x double"), "x").collect()
    assert [(r.bin, r["count"]) for r in got] == [(0, 2)]
    assert explore.histogram(table([], "x double"), "x").count() == 0


def test_box_stats(rows, frame):
    got = indexed(explore.box_stats(rows, "price", ["country"]), "country")
    for k, v in frame.dropna(subset=["price"]).groupby("country").price:
        q1, q3 = v.quantile([0.25, 0.75])
        inside = v[v.between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))]
        row = got.loc[k]
        assert [row.q1, row.q3] == pytest.approx([q1, q3])
        assert [row.lower_whisker, row.upper_whisker] == pytest.approx([inside.min(), inside.max()])
        assert row.outliers == len(v) - len(inside)
    assert explore.box_stats(rows, "price").first().outliers >= 0


def test_correlations(rows, frame):
    got = indexed(explore.correlation_matrix(rows), "x", "y").correlation
    want = frame[["price", "lead_time", "quantity"]].corr()
    assert got["price", "lead_time"] == pytest.approx(want.loc["price", "lead_time"])
    assert np.isnan(got["price", "quantity"]) and len(got) == 9
    straight = rows.withColumn("double_price", F.col("price") * -2)
    row = explore.correlation(straight, "price", "double_price").first()
    assert row.correlation == pytest.approx(-1) and row.strength == "strong"
    assert explore.correlation(rows, "price", "quantity").first().strength is None


def test_trendline(rows, frame):
    got = indexed(explore.ols_trend(rows, "lead_time", "price", ["country"]), "country")
    for k, part in frame.dropna(subset=["price"]).groupby("country"):
        slope, base = np.polyfit(part.lead_time, part.price, 1)
        assert [got.loc[k].slope, got.loc[k].intercept] == pytest.approx([slope, base])
        assert got.loc[k].points == len(part)
    assert explore.ols_trend(rows, "quantity", "price").first().slope is None


def test_statistics(rows, frame):
    got = indexed(explore.stats(rows, "price", ["vendor"]), "vendor")
    want = frame.groupby("vendor").price.agg(["min", "max", "mean", "median", "std", "count"])
    np.testing.assert_allclose(got[want.columns].astype(float), want)
    np.testing.assert_allclose(got["range"], want["max"] - want["min"])
    each = indexed(explore.stats_by_each(rows, "price", ["vendor", "country"]), "group", "key")
    assert len(each) == 1 + 4 + 3
    assert each.loc[("all", ""), "median"] == pytest.approx(frame.price.median())
    assert each.loc[("vendor", "v1"), "std"] == pytest.approx(want.loc["v1", "std"])


def test_monthly_and_bubble(rows, frame):
    month = pd.to_datetime(frame.date).dt.strftime("%Y-%m")
    got = indexed(explore.monthly_mean(rows, "price", ["country"]), "month", "country")["mean"]
    np.testing.assert_allclose(got, frame.groupby([month, "country"]).price.mean())
    sizes = {"count": "count", "std": "std", "range": lambda x: x.max() - x.min()}
    for size, how in sizes.items():
        got = indexed(explore.bubble(rows, "price", "vendor", size), "vendor")
        np.testing.assert_allclose(got["size"], frame.groupby("vendor").price.agg(how))
    by_month = indexed(explore.bubble(rows, "price"), "month")
    np.testing.assert_allclose(by_month.y, frame.groupby(month).price.mean())
    with pytest.raises(ValueError):
        explore.bubble(rows, "price", size="colour")


def test_top_groups_and_comparisons(rows, frame, table):
    want = frame.groupby("vendor").price.mean().nlargest(2).index.tolist()
    top = compare.top_groups(rows, "price", "vendor", 2)
    assert [r.vendor for r in top.collect()] == want
    day = pd.Timestamp(2024, 2, 1).date()
    at = compare.compare_at(rows, day, "price", "vendor", top).toPandas()
    picked = frame[(frame.date == day) & frame.vendor.isin(want)]
    assert len(at) == len(picked) and at.price.dropna().is_monotonic_decreasing
    assert compare.compare_over_time(rows, top, "vendor").count() == frame.vendor.isin(want).sum()
    price = table([("a", 3.0), ("b", 2.0), ("c", 1.0)], "g string, price double")
    lead = table([("a", 1.0), ("b", 2.0), ("c", 3.0)], "g string, lead_time double")
    merged = compare.top_groups_merged(price, lead, "g", 2)
    assert [(r.g, r["rank"]) for r in merged.collect()] == [("a", 1), ("c", 1)]


def test_ties_go_to_the_smallest_key(table):
    df = table([("b", 1.0), ("a", 1.0), ("c", 1.0)], "g string, x double")
    assert [r.g for r in compare.top_groups(df, "x", "g", 2).collect()] == ["a", "b"]


def test_pivots(rows, frame):
    got = indexed(compare.pivot_mean(rows, "vendor", "country", "price"), "vendor")
    want = frame.pivot_table(index="vendor", columns="country", values="price", aggfunc="mean")
    np.testing.assert_allclose(got[want.columns].astype(float), want)
    months = compare.pivot_mean(rows, "country", "month", "price", ["2024-01", "2024-05"])
    assert months.columns == ["country", "2024-01", "2024-05"]
    with pytest.raises(ValueError):
        compare.pivot_mean(rows, "vendor", "country", "price", most=2)


@pytest.fixture
def forecasts(table):
    days = [pd.Timestamp(2024, m, 1).date() for m in (1, 2, 3)]
    price = [(g, d, 10.0 * i + j) for i, g in enumerate(["a", "b", None]) for j, d in enumerate(days)]
    lead = [(g, d, 5.0 + i) for i, g in enumerate(["a", "b", None]) for d in days[:2]]
    return (
        table(price, "g string, date date, price double"),
        table(lead, "g string, date date, lead_time double"),
    )


def test_joins_of_measures(forecasts, table):
    price, lead = forecasts
    both = compare.combine_measures(price, lead)
    assert both.columns == ["g", "date", "price", "lead_time"] and both.count() == 6
    with pytest.raises(ValueError, match="several rows"):
        compare.combine_measures(price, lead, ["date"])
    overall = lead.where("g = 'a'").drop("g")
    assert compare.combine_measures(price, overall).count() == 6
    tidy = compare.tidy_measures(price, lead, ["g"])
    assert tidy.groupBy("measure").count().collect()[0]["count"] in (9, 6) and tidy.count() == 15


def test_labelled_union(forecasts):
    price, lead = forecasts
    past = compare.combine_measures(price, lead)
    out = compare.label_union(past, price, ["date", "price", "lead_time", "g"])
    assert out.count() == 15
    assert out.where("data_source = 'Forecast' and lead_time is null").count() == 9


def test_export_assembly(forecasts):
    price, lead = forecasts
    out = export.assemble(price, lead, {"g": ["a"]}, "2024-01-15", None, ["date", "g"])
    assert [tuple(r) for r in out.collect()] == [(pd.Timestamp(2024, 2, 1).date(), "a", 1.0, 5.0)]
    assert export.assemble(price, None, columns=["price", "date"]).columns == ["price", "date"]
    with pytest.raises(ValueError):
        export.assemble(price, lead, combine=False)
    assert export.assemble(price, combine=False).columns == ["g", "date", "price"]
    with pytest.raises(ValueError):
        export.assemble(price, lead, columns=["g"])
    with pytest.raises(ValueError):
        export.assemble()


def test_sinks(spark, forecasts, tmp_path):
    price, lead = forecasts
    export.write_csv(price, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, schema=price.schema)
    assert back.exceptAll(price).count() == 0 and back.count() == 9
    export.write_json(price, str(tmp_path / "json"))
    back = spark.read.json(str(tmp_path / "json"))
    assert dict(back.dtypes)["date"] == "string" and back.count() == 9
    lines = {r.line for r in export.json_lines(price).collect()}
    assert '{"g":null,"date":"2024-01-01","price":20.0}' in lines
    assert "a,2024-01-01,0.0" in {r.line for r in export.csv_lines(price).collect()}
    tables = export.report_tables(price, lead, ["g"])
    assert set(tables) == {
        "metadata", "overview", "statistics", "price_forecast", "lead_time_forecast",
        "price_by_group", "lead_time_by_group", "group_values", "combined",
    }
    export.write_tables(tables, str(tmp_path / "report"))
    stats = spark.read.parquet(str(tmp_path / "report/statistics")).toPandas().set_index("metric")
    assert stats.loc["Price", "count"] == 9 and stats.loc["Lead Time", "max"] == 7.0
    over = {r.metric: r for r in tables["overview"].collect()}
    assert over["Price Forecast"].date_range == "2024-01-01 to 2024-03-01"
    meta = export.metadata(price, None, ["g"], "One Consolidated Report").first()
    assert (meta.points, meta.lead_time_points, meta.includes_lead_time) == (9, 0, "No")
    assert meta.selected_columns == "date, price, g"
    assert export.group_values(price, ["g"]).first().distinct_values == 2
