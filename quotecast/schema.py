"""Column roles, types and limits shared by every operator."""

from pyspark.sql import types as T

HISTORY_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("part_number", T.StringType()),
    T.StructField("vendor", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("lead_time", T.DoubleType()),
    T.StructField("quantity", T.LongType()),
])

# Columns a table must have at each validation level, columns
# that must not be negative, usual grouping columns, least history for a forecast.
REQUIRED_COLUMNS = {
    "basic": ("date",),
    "forecasting": ("date", "price", "lead_time"),
}
MEASURES = ("price", "lead_time")
GROUP_COLUMNS = ("part_number", "vendor", "country")
MIN_POINTS = 12


def numeric_columns(df):
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def is_numeric(df, column):
    return isinstance(df.schema[column].dataType, T.NumericType)


def is_temporal(df, column):
    return isinstance(
        df.schema[column].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)
    )


def string_columns(df):
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
