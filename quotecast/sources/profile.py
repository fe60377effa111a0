"""Table profile and candidates for grouping and coloring columns."""

from pyspark.sql import functions as F

from quotecast.schema import is_temporal, numeric_columns, string_columns

SKETCH_ERROR = 0.02


def profile(df, date="date"):
    """One row: size, names, missing cells and date range, from one aggregate."""
    missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    has_date = date in df.columns and is_temporal(df, date)
    day = F.col(date).cast("date") if has_date else F.lit(None).cast("date")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(", ".join(df.columns)).alias("column_names"),
        missing.cast("long").alias("missing_values"),
        F.min(day).alias("date_start"),
        F.max(day).alias("date_end"),
    )


def column_types(df):
    """One row per column: name and type."""
    return df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")


def distinct_counts(df, columns, at_most):
    """Exact distinct counts of the columns that have at most ``at_most`` values.

    A bounded sketch per column first rules out columns far above the limit, so
    the exact count only ever shuffles values of low-cardinality columns.
    Columns over the limit are left out of the result.
    """
    if not columns:
        return {}
    rough = df.agg(*[
        F.approx_count_distinct(c, SKETCH_ERROR).alias(c) for c in columns
    ]).first()
    near = [c for c in columns if rough[c] <= 2 * at_most + 1]
    if not near:
        return {}
    exact = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in near]).first()
    return {c: exact[c] for c in near if exact[c] <= at_most}


def group_candidates(df, max_distinct=50, max_ratio=0.2, roles=("date", "price", "lead_time")):
    """Columns usable as groups: (column, rule, groups).

    ``upload``: every text column, and numbers with distinct values under
    ``max_ratio`` of the rows. ``forecast``: text columns with at most
    ``max_distinct`` values; ``many_groups`` flags more than 20.
    """
    texts = [c for c in string_columns(df) if c not in roles]
    numbers = [c for c in numeric_columns(df) if c not in roles]
    rows = df.count()
    counted = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in texts]).first() if texts else {}
    few = {c: counted[c] for c in texts if counted[c] <= max_distinct}
    low = {
        c: n
        for c, n in distinct_counts(df, numbers, int(rows * max_ratio)).items()
        if n < rows * max_ratio
    }
    out = [("upload", c, counted[c], None) for c in texts]
    out += [("upload", c, n, None) for c, n in low.items()]
    out += [("forecast", c, n, n > 20) for c, n in few.items()]
    return df.sparkSession.createDataFrame(
        out, "rule string, column string, groups long, many_groups boolean"
    )


def group_count(df, keys):
    """Number of groups and whether there are more than the 20 shown comfortably."""
    groups = df.select(*keys).dropna().distinct()
    return groups.agg(
        F.count(F.lit(1)).alias("groups"), (F.count(F.lit(1)) > 20).alias("many_groups")
    )


def category_candidates(df, below=30, skip=("date",)):
    """Columns with fewer than ``below`` distinct values: (column, distinct_values)."""
    found = distinct_counts(df, [c for c in df.columns if c not in skip], below - 1)
    return df.sparkSession.createDataFrame(
        list(found.items()), "column string, distinct_values long"
    )
