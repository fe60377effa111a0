"""Export assembly, sinks and report tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotecast.operators.compare import combine_measures
from quotecast.operators.explore import stats, stats_by_each
from quotecast.operators.filters import filter_dates, filter_in, select_columns


def assemble(
    price=None, lead_time=None, groups=None, start=None, end=None, columns=None, combine=True
):
    """The table to export: filtered, cut to a date range, merged and projected.

    With both measures and ``combine`` the join runs on the shared columns that
    are selected; the measures themselves are always kept.
    """
    if price is None and lead_time is None:
        raise ValueError("select price, lead time or both")

    def cut(df):
        chosen = {c: v for c, v in (groups or {}).items() if c in df.columns}
        return filter_dates(filter_in(df, chosen), start, end)

    parts = [(df, m) for df, m in ((price, "price"), (lead_time, "lead_time")) if df is not None]
    if len(parts) > 1 and not combine:
        raise ValueError("two measures make one table only with combine=True; export them one by one")
    if len(parts) == 1:
        df, _ = parts[0]
        return select_columns(cut(df), columns or df.columns)
    left, right = (
        select_columns(cut(df), [*(columns or df.columns), m]) for df, m in parts
    )
    shared = [c for c in left.columns if c in right.columns]
    if "date" not in shared:
        raise ValueError("select the date column to merge price and lead time")
    return combine_measures(left, right)


def iso_dates(df):
    """Dates and timestamps as yyyy-MM-dd text."""
    dated = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return df.withColumns({
        f.name: F.date_format(f.name, "yyyy-MM-dd") for f in df.schema if isinstance(f.dataType, dated)
    })


def csv_lines(df):
    """The rows as CSV text, one line each, without header."""
    return df.select(F.to_csv(F.struct(*df.columns)).alias("line"))


def json_lines(df):
    """The rows as JSON objects, one line each; NULL fields are kept."""
    record = F.struct(*iso_dates(df).columns)
    return iso_dates(df).select(F.to_json(record, {"ignoreNullFields": "false"}).alias("line"))


def write_csv(df, path, mode="error"):
    """Header and rows, one file per partition; quotes inside quoted text are doubled."""
    df.write.mode(mode).options(header=True, escape='"').csv(path)


def write_json(df, path, mode="error"):
    """JSON Lines, one file per partition; dates as text."""
    iso_dates(df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_tables(tables, path, format="parquet", mode="error"):
    """One folder per named table."""
    for name, df in tables.items():
        df.write.mode(mode).format(format).save(f"{path}/{name}")


def overview(price=None, lead_time=None):
    """metric, date_range, points, min, max, mean: one row per measure."""
    rows = [
        df.agg(
            F.concat_ws(
                " to ", F.date_format(F.min("date"), "yyyy-MM-dd"), F.date_format(F.max("date"), "yyyy-MM-dd")
            ).alias("date_range"),
            F.count(F.lit(1)).alias("points"),
            F.min(m).alias("min"),
            F.max(m).alias("max"),
            F.avg(m).alias("mean"),
        ).select(F.lit(title).alias("metric"), "*")
        for df, m, title in _given(price, lead_time)
    ]
    return _union(rows)


def statistics(price=None, lead_time=None):
    """metric, min ... count: one row per measure."""
    return _union([
        stats(df, m).select(F.lit(title.removesuffix(" Forecast")).alias("metric"), "*")
        for df, m, title in _given(price, lead_time)
    ])


def metadata(price=None, lead_time=None, keys=(), group_option="All Groups", created=None):
    """One row: creation time, row counts, columns, what is included, grouping."""
    columns = ["date"] + [m for _, m, _ in _given(price, lead_time)]
    created = F.current_timestamp() if created is None else F.lit(created).cast("timestamp")
    tagged = _union([df.select(F.lit(m).alias("_m")) for df, m, _ in _given(price, lead_time)])
    row = tagged.agg(
        F.count_if(F.col("_m") == "price").alias("points"),
        F.count_if(F.col("_m") == "lead_time").alias("lead_time_points"),
    )
    return row.select(
        F.date_format(created, "yyyy-MM-dd HH:mm:ss").alias("creation_date"),
        "points",
        "lead_time_points",
        F.lit(", ".join([*columns, *keys])).alias("selected_columns"),
        F.lit("Yes" if price is not None else "No").alias("includes_price"),
        F.lit("Yes" if lead_time is not None else "No").alias("includes_lead_time"),
        F.lit(", ".join(keys) or "None").alias("group_columns"),
        F.lit(group_option).alias("group_option"),
    )


def group_values(df, keys):
    """column, distinct_values: exact, counted column by column in one pass."""
    pairs = F.inline(F.array(*[
        F.struct(F.lit(k).alias("column"), F.col(k).cast("string").alias("_v")) for k in keys
    ]))
    values = df.select(pairs).where(F.col("_v").isNotNull()).distinct()
    return values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))


def report_tables(price=None, lead_time=None, keys=(), group_option="All Groups", created=None):
    """All tables of a report by name, ready for ``write_tables``."""
    tables = {
        "metadata": metadata(price, lead_time, keys, group_option, created),
        "overview": overview(price, lead_time),
        "statistics": statistics(price, lead_time),
    }
    for df, m, _ in _given(price, lead_time):
        tables[f"{m}_forecast"] = df
        if keys and group_option in ("All Groups", "One Consolidated Report"):
            tables[f"{m}_by_group"] = stats_by_each(df, m, keys)
    if keys:
        tables["group_values"] = group_values(price if price is not None else lead_time, keys)
    if price is not None and lead_time is not None:
        tables["combined"] = combine_measures(price, lead_time)
    return tables


def _given(price, lead_time):
    every = ((price, "price", "Price Forecast"), (lead_time, "lead_time", "Lead Time Forecast"))
    return [part for part in every if part[0] is not None]


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
