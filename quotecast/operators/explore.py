"""Statistics tables over history and forecasts."""

from pyspark.sql import functions as F

from quotecast.functions.columns import join_on_keys, safe_corr
from quotecast.functions.quantiles import (
    counted_statistics,
    exact_quantiles,
    quantile_values,
    quantiles_of,
    value_counts,
)
from quotecast.operators.series import month_key
from quotecast.schema import numeric_columns

QUARTILES = (0.25, 0.5, 0.75)
WHISKER = 1.5
# Limits of absolute correlation for the strength labels.
WEAK, MODERATE = 0.3, 0.7


def _unfold(df, columns, aggs, names):
    """One aggregate over all columns, turned into one row per column."""
    flat = [a(F.col(c)).alias(f"{i}_{j}") for i, c in enumerate(columns) for j, a in enumerate(aggs)]
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"{i}_{j}").alias(n) for j, n in enumerate(names)],
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*flat).select(F.inline(F.array(*rows)))


def describe(df, columns=None):
    """column, count, mean, std, min, q25, q50, q75, max per numeric column."""
    columns = list(columns or numeric_columns(df))
    found = exact_quantiles(df, columns, QUARTILES, moments=True)
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(found, "column", "left").select(
        "column",
        F.coalesce("n", F.lit(0)).alias("count"),
        "mean",
        "std",
        "min",
        *[F.col("q")[i].alias(f"q{int(p * 100)}") for i, p in enumerate(QUARTILES)],
        "max",
    )


def missing_table(df):
    """column, missing, percent: columns with gaps, most gaps first."""
    counts = _unfold(
        df,
        df.columns,
        [lambda c: F.count_if(c.isNull()), lambda _: F.count(F.lit(1))],
        ["missing", "_rows"],
    )
    return (
        counts.where(F.col("missing") > 0)
        .select("column", "missing", (F.col("missing") / F.col("_rows") * 100).alias("percent"))
        .orderBy(F.desc("missing"), "column")
    )


def histogram(df, column, bins=20):
    """bin (from 0), lower, upper, count, density, mean and median; empty bins left out.

    The two edges come from one small aggregate; counting combines map-side to at
    most ``bins`` rows per task.
    """
    value = F.col(column).cast("double")
    low, high, mean, total = df.agg(
        F.min(value), F.max(value), F.avg(value), F.count(value)
    ).first()
    if not total:
        low = high = mean = 0.0
    width = (high - low) / bins if high > low else 1.0
    median = quantile_values(df, [column], [0.5])[column][0]
    index = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    return (
        df.where(value.isNotNull())
        .groupBy(index.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            "bin",
            (F.col("bin") * F.lit(width) + F.lit(low)).alias("lower"),
            ((F.col("bin") + 1) * F.lit(width) + F.lit(low)).alias("upper"),
            "count",
            (F.col("count") / F.lit(float(total or 1)) / F.lit(width)).alias("density"),
            F.lit(mean).alias("mean"),
            F.lit(median).cast("double").alias("median"),
        )
    )


def box_stats(df, column, by=()):
    """by..., q1, median, q3, lower and upper whisker, number of points beyond them."""
    rows = df.select(*by, F.col(column).cast("double").alias("_v")).where(
        F.col("_v").isNotNull()
    )
    rows = rows.dropna(subset=list(by)) if by else rows
    counts = value_counts(rows, ["_v"], by)
    q = quantiles_of(counts, QUARTILES, by)
    fences = q.select(*by, "column", *_fences(F.col("q")))
    joined = join_on_keys(counts, fences, [*by, "column"])
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    kept = F.when(inside, F.col("_v"))
    return joined.groupBy(*by, "q1", "median", "q3").agg(
        F.min(kept).alias("lower_whisker"),
        F.max(kept).alias("upper_whisker"),
        F.sum(F.when(inside, 0).otherwise(F.col("_c"))).alias("outliers"),
    )


def _fences(q):
    reach = (q[2] - q[0]) * WHISKER
    return [
        q[0].alias("q1"),
        q[1].alias("median"),
        q[2].alias("q3"),
        (q[0] - reach).alias("_low"),
        (q[2] + reach).alias("_high"),
    ]


def correlation_matrix(df, columns=None):
    """x, y, correlation for every ordered pair, from one aggregate."""
    columns = list(columns or numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[
        safe_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}")
        for i, (a, b) in enumerate(pairs)
    ])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in dict.fromkeys([(a, b), (b, a)]):
            cells.append(F.struct(
                F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"{i}").alias("correlation")
            ))
    return row.select(F.inline(F.array(*cells)))


def correlation(df, x, y, by=()):
    """by..., correlation of two columns and its strength in words."""
    r = safe_corr(F.col(x).cast("double"), F.col(y).cast("double"))
    size = F.abs("correlation")
    return df.groupBy(*by).agg(r.alias("correlation")).withColumn(
        "strength",
        F.when(size < WEAK, "weak").when(size < MODERATE, "moderate").when(
            size.isNotNull(), "strong"
        ),
    )


def ols_trend(df, x, y, by=()):
    """by..., points, slope, intercept, r2 of the straight line y over x; any number of rows."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    both = xs.isNotNull() & ys.isNotNull()
    varied = (F.min(F.when(both, xs)) < F.max(F.when(both, xs)))
    r2 = F.when(
        F.min(F.when(both, ys)) < F.max(F.when(both, ys)), F.regr_r2(ys, xs)
    )
    return df.groupBy(*by).agg(
        F.count_if(both).alias("points"),
        F.when(varied, F.regr_slope(ys, xs)).alias("slope"),
        F.when(varied, F.regr_intercept(ys, xs)).alias("intercept"),
        F.when(varied, r2).alias("r2"),
    )


def stats(df, value, by=(), weight=None):
    """by..., min, max, mean, median, std, range, count.

    ``weight`` names a column with the number of rows that a row stands for.
    """
    rows = df.dropna(subset=list(by)) if by else df
    return _stats_table(exact_quantiles(rows, [value], [0.5], by, moments=True, weight=weight), by)


def _stats_table(found, by):
    return found.select(
        *by,
        "min",
        "max",
        "mean",
        "std",
        (F.col("max") - F.col("min")).alias("range"),
        F.col("n").alias("count"),
        F.col("q")[0].alias("median"),
    )


def stats_by_each(df, value, groups):
    """Statistics by every grouping column and overall: group, key, min ... count.

    Rows are counted and sorted once, for all grouping columns and the value together, by
    value first. Each set rolls these counts up part by part; only the parts that hold
    a median are unfolded for it. ``group`` tells the sets apart, whatever the keys hold.
    """
    tags = [F.struct(F.lit("all").alias("group"), F.lit(None).cast("string").alias("key"))]
    tags += [
        F.struct(F.lit(g).alias("group"), F.col(f"_{g}").cast("string").alias("key")) for g in groups
    ]
    rows = df.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col(value).alias("_value"))
    fine = value_counts(rows, ["_value"], [f"_{g}" for g in groups], missing=True, by_value=True)
    counts = fine.select("column", "_v", "_c", "_part", F.inline(F.array(*tags))).where(
        (F.col("group") == "all") | F.col("key").isNotNull()
    )
    counts = counts.withColumn("key", F.coalesce("key", F.lit("")))
    by = ["group", "key"]
    return _stats_table(counted_statistics(counts, [0.5], by), by)


def monthly_mean(df, value, by=(), date="date"):
    """month (yyyy-MM), by..., mean."""
    return month_key(df, date).groupBy("month", *by).agg(F.avg(value).alias("mean"))


def bubble(df, value, by=None, size="count", date="date"):
    """Group (or month), y = mean, size = count, std (0 where undefined) or range."""
    sizes = {
        "count": F.count(value),
        "std": F.coalesce(F.stddev_samp(value), F.lit(0.0)),
        "range": F.max(value) - F.min(value),
    }
    if size not in sizes:
        raise ValueError(f"unknown size {size!r}: use one of {tuple(sizes)}")
    rows, by = (month_key(df, date), "month") if by is None else (df.dropna(subset=[by]), by)
    return rows.groupBy(by).agg(F.avg(value).alias("y"), sizes[size].alias("size"))
