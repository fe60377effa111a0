from datetime import date

import pytest

from quotecast.operators import filters, validate

FULL = "date date, part_number string, vendor string, country string, price double, lead_time double"


def rows(n=14):
    return [(date(2024, 1, 1 + i), "p", f"v{i % 3}", "c", 1.0 + i, 7.0) for i in range(n)]


def verdict(df, level="forecasting"):
    return tuple(validate.validate(df, level).first())


def test_first_failing_check_wins(table):
    assert verdict(table(rows(), FULL)) == (True, validate.PASSED)
    assert verdict(table([], FULL)) == (False, validate.EMPTY)
    assert verdict(table([(1,)], "x int")) == (False, "Missing required columns: date, price, lead_time")
    assert verdict(table([(1,)], "x int"), "basic") == (False, "Missing required columns: date")
    assert verdict(table(rows(11), FULL))[1].endswith("Need at least 12, found 11")
    negative = [(*r[:4], -1.0, 7.0) for r in rows()]
    assert "price" in verdict(table(negative, FULL))[1]
    missing = [(*r[:5], None) for r in rows()]
    assert "lead_time" in verdict(table(missing, FULL))[1]
    text = table([("2024-01-01", "1", "2")] * 12, "date string, price string, lead_time string")
    assert verdict(text) == (True, validate.PASSED)
    bad = table([("someday", "1", "2")] * 12, "date string, price string, lead_time string")
    assert verdict(bad, "basic") == (False, validate.BAD_DATE)
    signed = table([("2024-01-01", "-1", "2")] * 12, "date string, price string, lead_time string")
    assert "price" in verdict(signed)[1]


def test_quality_report_and_fixes(table):
    data = rows(13) + [rows(1)[0], (None, None, "v9", "c", None, -3.0)]
    df = table(data, FULL)
    report = {(r.metric, r.column): r for r in validate.quality_report(df).collect()}
    assert report["row_count", None].value == "15"
    assert report["missing_values", "price"].value == "1"
    assert report["negative_values", "lead_time"].issue == "Column 'lead_time' has 1 negative values"
    assert report["duplicates", None].value == "1"
    assert report["date_periods", "date"].value == "13"
    assert report["small_groups", "vendor"].issue == "4 values in 'vendor' have fewer than 12 data points"
    fixes = {(r.issue, r.column): r.suggestion for r in validate.suggest_fixes(df).collect()}
    assert fixes["missing_values", "price"] == validate.FEW_MISSING
    assert fixes["missing_values", "date"] == validate.MISSING_DATE
    assert fixes["missing_values", "part_number"] == validate.MISSING_OTHER
    assert fixes["negative_values", "lead_time"] == validate.NEGATIVE
    assert fixes["duplicates", None] == validate.DUPLICATE
    assert ("grouping", None) in fixes
    texts = table([("x", 1.0)], "date string, price double")
    assert ("date_format", "date") in {(r.issue, r.column) for r in validate.suggest_fixes(texts).collect()}


def test_null_rows_count_as_duplicates_of_each_other(table):
    df = table([(None, 1.0), (None, 1.0), ("a", None)], "part_number string, price double")
    report = {r.metric: r.value for r in validate.quality_report(df).collect()}
    assert report["duplicates"] == "1"


def test_filters(table):
    df = table([(i, "abc"[i % 3], date(2024, 1, 1 + i)) for i in range(9)], "i int, g string, date date")
    assert filters.filter_in(df, {"g": ["a", "b"], "i": [0, 1, 2]}).count() == 2
    many = filters.filter_in(df, {"i": range(4, 5000)})
    assert many.count() == 5 and many.columns == df.columns
    assert filters.filter_eq(df, {"g": "a", "i": "All"}).count() == 3
    assert filters.filter_dates(df, "2024-01-02", date(2024, 1, 4)).count() == 3
    assert [r.g for r in filters.top_values(df, "g", 2).collect()] == ["a", "b"]
    assert filters.select_columns(df, ["g", "none", "i", "g"]).columns == ["g", "i"]
    assert [r.i for r in filters.preview(df, 2, ["i"]).collect()] == [0, 1]
    assert filters.drop_incomplete(table([(None, 1.0), (date(2024, 1, 1), None)], "date date, price double")).count() == 0


def test_filters_run_on_a_stream(spark, table, tmp_path):
    table([(i, "ab"[i % 2]) for i in range(10)], "i int, g string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i int, g string").parquet(str(tmp_path / "in"))
    job = (
        filters.filter_eq(stream, {"g": "a"})
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    assert job.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


@pytest.mark.parametrize("level", ["basic", "forecasting"])
def test_one_row_verdict(table, level):
    assert validate.validate(table(rows(), FULL), level).count() == 1
