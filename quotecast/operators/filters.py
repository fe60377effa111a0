"""Row filters, column selection and previews."""

from pyspark.sql import functions as F


def filter_in(df, chosen):
    """Keep rows whose columns hold one of the chosen values (AND across columns).

    The values become one pushed-down predicate, which Spark looks up in a hash set;
    values that are themselves data belong in a table: ``filter_in_table``. An empty
    choice leaves its column unfiltered.
    """
    for column, values in chosen.items():
        values = list(dict.fromkeys(values))
        if values:
            df = df.where(F.col(column).isin(values))
    return df


def filter_in_table(df, wanted, on):
    """Keep rows whose ``on`` columns occur in another table."""
    return df.join(wanted.select(*on), list(on), "left_semi").select(*df.columns)


def filter_eq(df, chosen, everything="All"):
    """Keep rows equal to each chosen value; "All" leaves a column unfiltered."""
    for column, value in chosen.items():
        if value != everything:
            df = df.where(F.col(column) == F.lit(value))
    return df


def filter_dates(df, start=None, end=None, date="date"):
    """Inclusive date range; either end may be open."""
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df


def top_values(df, column, n=50):
    """Most frequent values, smallest first among equals."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .orderBy(F.desc("occurrences"), column)
        .limit(n)
    )


def distinct_values(df, column):
    """Sorted distinct values of one column (also used for dates)."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def select_columns(df, columns):
    """Chosen columns that exist, in the order asked for, each once."""
    return df.select(*[c for c in dict.fromkeys(columns) if c in df.columns])


def preview(df, n=10, order_by=()):
    """First n rows; give order_by for a repeatable answer."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def drop_incomplete(df, columns=("date", "price", "lead_time")):
    """Drop rows lacking a value in any of the key columns present."""
    present = [c for c in columns if c in df.columns]
    return df.dropna(subset=present) if present else df
