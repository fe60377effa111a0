"""Validation, quality report and suggested fixes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quotecast.schema import (
    GROUP_COLUMNS,
    MEASURES,
    MIN_POINTS,
    REQUIRED_COLUMNS,
    is_numeric,
    is_temporal,
    string_columns,
)

# Messages of the checks, reported for the first one that fails.
EMPTY = "Data is empty or None"
MISSING = "Missing required columns: {}"
BAD_DATE = "Invalid date column format or values in 'date'"
BAD_NUMBER = "Invalid {0} column format or values in '{0}'"
TOO_FEW = "Insufficient data points for forecasting. Need at least {}, found %d"
PASSED = "Data validation successful"

# Suggestions by kind of finding.
FEW_MISSING = "Replace with mean or median"
MANY_MISSING = "Consider removing rows or using more advanced imputation"
MISSING_DATE = "Remove rows with missing dates"
MISSING_OTHER = "Fill with mode or remove rows"
NEGATIVE = "Replace with absolute values or remove rows"
DUPLICATE = "Remove duplicate rows"
DATE_FORMAT = "Convert date column to datetime format"
GROUPING = "Consider grouping by one or more of: {}"
FEW_MISSING_SHARE = 0.1


def validate(df, level="basic", min_points=MIN_POINTS):
    """One row (valid, message): the first failing check, from one aggregate."""
    required = REQUIRED_COLUMNS.get(level, REQUIRED_COLUMNS["basic"])
    absent = [c for c in required if c not in df.columns]
    rows = F.col("_rows")
    measured = [F.count(F.lit(1)).alias("_rows")]
    verdict = F.when(rows == 0, EMPTY)
    if absent:
        verdict = verdict.otherwise(MISSING.format(", ".join(absent)))
    else:
        measured.append(_bad_dates(df, "date").alias("_date"))
        verdict = verdict.when(F.col("_date") > 0, BAD_DATE)
        if level == "forecasting":
            for c in MEASURES:
                measured.append(_bad_numbers(df, c).alias(f"_{c}"))
                verdict = verdict.when(F.col(f"_{c}") > 0, BAD_NUMBER.format(c))
            short = F.format_string(TOO_FEW.format(min_points), rows)
            verdict = verdict.when(rows < min_points, short)
        verdict = verdict.otherwise(PASSED)
    return df.agg(*measured).select(
        (verdict == PASSED).alias("valid"), verdict.alias("message")
    )


def _bad_dates(df, column):
    if is_temporal(df, column):
        return F.lit(0).cast("long")
    text = F.col(column).cast("string")
    return F.count_if(text.isNotNull() & F.try_to_timestamp(text).isNull())


def _bad_numbers(df, column):
    number = F.col(column) if is_numeric(df, column) else F.col(column).try_cast("double")
    return F.count_if(number.isNull() | (number < 0))


def quality_report(df, min_points=MIN_POINTS, date="date"):
    """Long table (metric, column, value, issue); ``issue`` is NULL where all is well."""
    spark = df.sparkSession
    counts = _counts(df, date)
    parts = [counts, _duplicates(df)]
    groups = [c for c in GROUP_COLUMNS if c in df.columns]
    if groups and date in df.columns:
        parts.append(_small_groups(df, groups, min_points))
    if date in df.columns and not is_temporal(df, date):
        note = [("date_format", date, None, "Date column is not in datetime format")]
        parts.append(spark.createDataFrame(note, "metric string, column string, value string, issue string"))
    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    return report


def _row(metric, column, value, issue=None):
    return F.struct(
        F.lit(metric).alias("metric"),
        F.lit(column).cast("string").alias("column"),
        value.cast("string").alias("value"),
        (F.lit(None) if issue is None else issue).cast("string").alias("issue"),
    )


def _counts(df, date):
    """All single-scan figures in one aggregate, unfolded to rows."""
    dated = date in df.columns and is_temporal(df, date)
    negatives = [c for c in MEASURES if c in df.columns and is_numeric(df, c)]
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in df.columns]
    aggs += [F.count_if(F.col(c) < 0).alias(f"negative_{c}") for c in negatives]
    if dated:
        day = F.col(date).cast("date")
        aggs += [
            F.min(day).alias("start"),
            F.max(day).alias("end"),
            F.count_distinct(day).alias("periods"),
        ]
    rows = [
        _row("row_count", None, F.col("rows")),
        _row("column_count", None, F.lit(len(df.columns))),
    ]
    for c in df.columns:
        n = F.col(f"missing_{c}")
        rows.append(_found("missing_values", c, n, f"Column '{c}' has %d missing values"))
    for c in negatives:
        n = F.col(f"negative_{c}")
        rows.append(_found("negative_values", c, n, f"Column '{c}' has %d negative values"))
    if dated:
        rows += [_row(f"date_{k}", date, F.col(k)) for k in ("start", "end", "periods")]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def _found(metric, column, n, text):
    return _row(metric, column, n, F.when(n > 0, F.format_string(text, n)))


def _duplicates(df):
    """Rows beyond the first of each set of equal rows; NULLs equal NULLs.

    Rows are counted by a fingerprint of 128 bits, which is all that is shuffled of
    most; only rows whose fingerprint repeats are compared in full.
    """
    marks = {"_mark": F.xxhash64(*df.columns), "_second": F.xxhash64(F.lit("second"), *df.columns)}
    marked = df.withColumns(marks)
    repeated = marked.groupBy(*marks).count().where("count > 1").drop("count")
    suspects = marked.join(repeated, list(marks), "left_semi").drop(*marks)
    copies = suspects.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    extra = F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))
    return copies.agg(extra.alias("_extra")).select(
        F.inline(F.array(_found("duplicates", None, F.col("_extra"), "Data contains %d duplicate rows")))
    )


def _small_groups(df, groups, min_points):
    """Values with too few rows, counted for every grouping column in one pass."""
    pairs = F.inline(F.array(*[
        F.struct(F.lit(g).alias("_g"), F.col(g).cast("string").alias("_v")) for g in groups
    ]))
    sizes = df.select(pairs).where(F.col("_v").isNotNull()).groupBy("_g", "_v").count()
    small = sizes.groupBy("_g").agg(F.count_if(F.col("count") < min_points).alias("_n"))
    text = f"%d values in '%s' have fewer than {min_points} data points"
    return small.select(
        F.lit("small_groups").alias("metric"),
        F.col("_g").alias("column"),
        F.col("_n").cast("string").alias("value"),
        F.when(F.col("_n") > 0, F.format_string(text, "_n", "_g")).alias("issue"),
    )


def suggest_fixes(df, report=None):
    """Rows (issue, column, suggestion) from the quality report."""
    report = quality_report(df) if report is None else report
    number = F.col("value").try_cast("long")
    # The report has a few rows per column of the table, so one window over it is small.
    rows = F.max(F.when(F.col("metric") == "row_count", number)).over(
        Window.partitionBy(F.lit(0))
    )
    report = report.withColumn("_rows", rows)
    share = number / F.nullif(F.col("_rows"), F.lit(0))
    advice = (
        F.when(
            F.col("metric") == "missing_values",
            F.when(
                F.col("column").isin(*MEASURES),
                F.when(share < FEW_MISSING_SHARE, FEW_MISSING).otherwise(MANY_MISSING),
            )
            .when(F.col("column") == "date", MISSING_DATE)
            .otherwise(MISSING_OTHER),
        )
        .when(F.col("metric") == "negative_values", NEGATIVE)
        .when(F.col("metric") == "duplicates", DUPLICATE)
        .when(F.col("metric") == "date_format", DATE_FORMAT)
    )
    found = report.where(
        ((number > 0) & F.col("metric").isin("missing_values", "negative_values", "duplicates"))
        | (F.col("metric") == "date_format")
    ).select(F.col("metric").alias("issue"), "column", advice.alias("suggestion"))
    texts = string_columns(df)
    if len(texts) > 2:
        hint = [("grouping", None, GROUPING.format(", ".join(texts)))]
        found = found.unionByName(
            df.sparkSession.createDataFrame(hint, "issue string, column string, suggestion string")
        )
    return found
