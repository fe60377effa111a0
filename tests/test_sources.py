from datetime import date

import pytest
from pyspark.sql import functions as F

from quotecast.schema import HISTORY_SCHEMA
from quotecast.sources import files, profile, synthetic

SAMPLE = (
    "date,part_number,vendor,country,price,lead_time,quantity \r\n"
    "2024-01-01,A12345,Vendor1,USA,125.50,14,100 \r\n"
    "2024-01-15,A12345,Vendor1,USA,126.75,15,150 \r\n"
)


def test_csv_with_trailing_blanks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(SAMPLE.encode())
    df = files.read_history(spark, str(tmp_path / "a.csv"))
    assert df.columns == HISTORY_SCHEMA.names
    assert dict(df.dtypes)["date"] == "date"
    assert [r.quantity for r in df.orderBy("date").collect()] == [100, 150]
    typed = files.read_history(spark, str(tmp_path / "a.csv"), schema=HISTORY_SCHEMA)
    assert typed.schema == HISTORY_SCHEMA
    assert typed.orderBy("date").first().price == 125.5


@pytest.mark.parametrize("sep", files.SEPARATORS)
@pytest.mark.parametrize("encoding", list(files.ENCODINGS))
def test_separators_and_encodings(spark, tmp_path, sep, encoding):
    text = "café" if encoding in ("iso-8859-1", "latin1") else "café €"
    path = tmp_path / "x.csv"
    path.write_bytes(sep.join(["Ship Date", "Vendor Name"]).encode() + b"\n")
    with path.open("ab") as f:
        f.write(sep.join(["2024-02-03", text]).encode(encoding) + b"\n")
    row = files.read_history(spark, str(path), sep=sep, encoding=encoding).first()
    assert row.ship_date == date(2024, 2, 3)
    assert row.vendor_name == text


def test_types_and_missing_texts(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("Date,a,b,c,d,e\n2024-01-01,1,1.5,true,x,\n,NA,n/a,False,null,NaN\n")
    df = files.read_history(spark, str(path))
    assert [t for _, t in df.dtypes] == ["date", "bigint", "double", "boolean", "string", "bigint"]
    assert tuple(df.where("date is null").first()) == (None, None, None, False, None, None)
    schema = "date date, a long, b double, c boolean, d string, e double"
    typed = files.read_history(spark, str(path), schema=spark.createDataFrame([], schema).schema)
    assert [t for _, t in typed.dtypes] == ["date", "bigint", "double", "boolean", "string", "double"]
    assert typed.where("a is null").count() == 1
    (tmp_path / "short.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_history(spark, str(tmp_path / "short.csv")).collect()


def test_bad_options_raise(spark):
    for options in ({"sep": "#"}, {"encoding": "ebcdic"}, {"format": "excel"}):
        with pytest.raises(ValueError):
            files.read_history(spark, "nowhere.csv", **options)


def test_dates_all_or_nothing(table):
    rows = [("01/31/2024", "2024-01-31", "soon"), ("02/01/2024", None, "2024-01-01")]
    df = files.parse_dates(table(rows, "date string, update_date string, date_note string"))
    assert [t for _, t in df.dtypes] == ["date", "date", "string"]
    assert df.first().date == date(2024, 1, 31)


def test_nan_becomes_null(table):
    df = files.nulls_for_nan(table([(float("nan"),), (1.0,)], "x double"))
    assert df.where("x is null").count() == 1


def test_map_roles(table):
    df = table([("2024-01-01", "1.5", "7", "a")], "order_date string, unit_price string, lead_days string, g string")
    mapped, groups = files.map_roles(df, groups=["g", "unit_price"])
    assert mapped.dtypes[:3] == [("date", "date"), ("price", "double"), ("lead_time", "double")]
    assert groups == ["g", "price"]
    kept, _ = files.map_roles(table([("2024-01-01", "n/a", "7")], "date string, price string, lead_time string"))
    assert kept.dtypes[1] == ("price", "string")
    plain = table([(date(2024, 1, 1), 1.0, 2.0)], "date date, price double, lead_time double")
    assert files.map_roles(plain)[0].columns == plain.columns
    assert files.role_columns(table([(1, 2.0)], "when long, amount double"))["price"] == "when"


def test_synthetic_history(spark):
    df = synthetic.synthetic_history(
        spark, "2020-01-15", "2022-12-31", num_parts=4, num_vendors=30, num_countries=17
    )
    assert df.schema.names == HISTORY_SCHEMA.names
    assert [f.dataType for f in df.schema] == [f.dataType for f in HISTORY_SCHEMA]
    stats = df.agg(
        F.count("*"), F.min("date"), F.min("price"), F.max("price"), F.min("lead_time"),
        F.max("lead_time"), F.min("quantity"), F.max("quantity"), F.count_distinct("vendor"),
        F.count_distinct("country"),
    ).first()
    assert stats[0] == 4 * 30 * 17 * 35
    assert stats[1] == date(2020, 2, 1)
    assert 10 <= stats[2] and stats[3] <= 100 and 7 <= stats[4] and stats[5] <= 60
    assert 50 <= stats[6] and stats[7] <= 499 and stats[8:] == (30, 17)
    assert df.where("country = 'Country2'").count() > 0
    again = synthetic.synthetic_history(
        spark, "2020-01-15", "2022-12-31", num_parts=4, num_vendors=30, num_countries=17
    ).repartition(5)
    assert df.exceptAll(again).count() == 0
    weekly = synthetic.synthetic_history(spark, "2024-01-01", "2024-01-31", "W", 1, 1, 1)
    assert [r.date.isoweekday() for r in weekly.collect()] == [7, 7, 7, 7]


def test_profile_and_candidates(table):
    df = table(
        [(date(2024, 1, 1 + i % 3), "ab"[i % 2], f"u{i}", float(i), i % 2) for i in range(60)],
        "date date, g string, u string, price double, n int",
    )
    row = profile.profile(df).first()
    assert (row.row_count, row.column_count, row.missing_values) == (60, 5, 0)
    found = {(r.rule, r.column) for r in profile.group_candidates(df).collect()}
    assert found == {("upload", "g"), ("upload", "u"), ("upload", "n"), ("forecast", "g")}
    colors = {r.column: r.distinct_values for r in profile.category_candidates(df).collect()}
    assert colors == {"g": 2, "n": 2}
    assert profile.group_count(df, ["g", "n"]).first().groups == 2
    assert {r.column for r in profile.column_types(df).collect()} == set(df.columns)


def test_forty_vendors_have_forty_names(spark):
    from quotecast.sources.synthetic import synthetic_history

    got = synthetic_history(spark, "2024-01-01", "2024-01-31", num_parts=1, num_vendors=40, num_countries=1)
    names = {r[0] for r in got.select("vendor").distinct().collect()}
    assert len(names) == 40 and {"VendorA", "VendorZ", "VendorAA", "VendorAN"} <= names


def test_standard_quoting_and_headers(spark, tmp_path):
    from quotecast.plans.export import write_csv
    from quotecast.sources.files import read_history

    rows = [('ACME "B", Inc', "13/02/2024", 1.5), ("two\nlines", "01/03/2024", 2.0)]
    write_csv(spark.createDataFrame(rows, "vendor string, date string, price double"), str(tmp_path / "out"))
    got = {r.vendor: (str(r.date), r.price) for r in read_history(spark, str(tmp_path / "out"), multi_line=True).collect()}
    assert got == {'ACME "B", Inc': ("2024-02-13", 1.5), "two\nlines": ("2024-03-01", 2.0)}
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "a.csv").write_text("vendor,price\nA,1\n")
    (tmp_path / "mixed" / "b.csv").write_text("price,vendor\n2,B\n")
    with pytest.raises(Exception):
        read_history(spark, str(tmp_path / "mixed")).collect()


def test_layouts_short_and_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Vendor,Price,Date\nA,1.5,2024-01-01\nB\nC,2.5\n\"D, E\",NA,2024-01-04,\n")
    (tmp_path / "b b.csv").write_text("date;x\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("date,vendor,note\n2024-02-01,F,n\n2024-02-02,G,n,surplus\n2024-02-03,H,n,,more\n")
    (tmp_path / "d.csv").write_text("")
    rows, bad = files.read_layouts(spark, str(tmp_path))
    got = sorted(tuple(r) for r in rows.select("vendor", "price", F.col("date").cast("string"), "note").where("vendor is not null").collect())
    assert got == [
        ("A", 1.5, "2024-01-01", None), ("B", None, None, None), ("C", 2.5, None, None),
        ("D, E", None, "2024-01-04", None), ("F", None, "2024-02-01", "n"),
    ]
    assert sorted(r.line for r in bad.collect()) == ["2024-02-02,G,n,surplus", "2024-02-03,H,n,,more"]
    assert all(r.file.endswith("c.csv") for r in bad.collect())
    schema = spark.createDataFrame([], "price double, vendor string, lost long").schema
    typed, _ = files.read_layouts(spark, str(tmp_path / "a.csv"), schema=schema)
    assert typed.schema.simpleString() == schema.simpleString() and typed.where("lost is null").count() == 4


def test_layouts_encodings_and_faults(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Größe;Ort\n1;café €\n".encode("cp1252"))
    rows, bad = files.read_layouts(spark, str(tmp_path), sep=";", encoding="cp1252")
    assert [tuple(r) for r in rows.collect()] == [(1, "café €")] and bad.count() == 0
    (tmp_path / "b.csv").write_text("A;a\n1;2\n")
    with pytest.raises(ValueError, match="twice"):
        files.read_layouts(spark, str(tmp_path / "b.csv"), sep=";")
    (tmp_path / "c.csv").write_text("")
    rows, bad = files.read_layouts(spark, str(tmp_path / "c.csv"))
    assert rows.count() == bad.count() == 0
