"""Top groups, comparisons, pivots, joins and unions of measures."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quotecast.functions.columns import join_on_keys
from quotecast.operators.series import month_key

PIVOT_LIMIT = 10_000


def top_groups(df, value, by, n=10):
    """by, mean: the n largest group means, smallest key first among equals."""
    return (
        df.dropna(subset=[by])
        .groupBy(by)
        .agg(F.avg(value).alias("mean"))
        .where(F.col("mean").isNotNull())
        .orderBy(F.desc("mean"), by)
        .limit(n)
    )


def top_groups_merged(price, lead_time, by, n=10, price_col="price", lead_col="lead_time"):
    """by: groups among the top n of either measure, best rank first, n in all."""
    def ranked(df, value):
        place = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean"), by)
        return top_groups(df, value, by, n).select(by, F.row_number().over(place).alias("_rank"))

    both = ranked(price, price_col).unionByName(ranked(lead_time, lead_col))
    return both.groupBy(by).agg(F.min("_rank").alias("rank")).orderBy("rank", by).limit(n)


def only_groups(df, groups, by):
    """Rows of the given groups, at all dates."""
    return df.join(groups.select(by), by, "left_semi").select(*df.columns)


def compare_at(df, day, value, by, groups, date="date"):
    """Rows of the given groups at one date, largest value first."""
    return only_groups(df.where(F.col(date) == F.lit(day).cast("date")), groups, by).orderBy(
        F.desc(value), by
    )


def compare_over_time(df, groups, by, date="date"):
    """Rows of the given groups at all dates, by group and date."""
    return only_groups(df, groups, by).orderBy(by, date)


def pivot_mean(df, row, column, value, values=None, date="date", most=PIVOT_LIMIT):
    """Mean of value: one row per ``row``, one column per value of ``column``.

    ``column="month"`` pivots by yyyy-MM. Give ``values`` to save the job that
    looks them up. Each value becomes a column of the result, so a column with more
    than ``most`` of them is refused; ``groupBy`` gives the same cells as rows.
    """
    if column == "month" and "month" not in df.columns:
        df = month_key(df, date)
    # Means first: the pivot then handles one row per cell.
    cells = df.dropna(subset=[row, column]).groupBy(row, column).agg(F.avg(value).alias("_mean"))
    if values is None:
        found = cells.select(column).distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{column} has more than {most} values")
        values = sorted(r[0] for r in found)
    return cells.groupBy(row).pivot(column, list(values)).agg(F.first("_mean"))


def combine_measures(price, lead_time, on=None, price_col="price", lead_col="lead_time"):
    """Price and lead time side by side, joined on all columns both have.

    NULL keys match each other. ``on`` narrows the join columns; joining grouped
    tables on the date alone would pair every group with every other one, so a
    side that holds several rows for one join key is refused.
    """
    measures = (price_col, lead_col)
    shared = [c for c in price.columns if c in lead_time.columns and c not in measures]
    on = shared if on is None else list(on)
    if not on:
        raise ValueError("the tables share no column to join on")
    if set(on) != set(shared):
        repeated = lead_time.groupBy(*on).count().where(F.col("count") > 1).limit(1).count()
        if repeated:
            raise ValueError(f"lead time has several rows per {on}; join on {shared}")
    right = lead_time.select(*on, *[c for c in lead_time.columns if c not in price.columns])
    return join_on_keys(price, right, on)


def tidy_measures(price, lead_time, keys=(), price_col="price", lead_col="lead_time"):
    """keys..., date, measure, value: both measures on one time axis."""

    def part(df, value):
        return df.select(
            *keys, "date", F.lit(value).alias("measure"), F.col(value).cast("double").alias("value")
        )

    return part(price, price_col).unionByName(part(lead_time, lead_col))


def label_union(history, forecast, columns, source="data_source"):
    """History over forecast, labelled; a column the forecast lacks becomes NULL."""
    wanted = list(dict.fromkeys(columns))

    def part(df, label):
        return df.select(*[c for c in wanted if c in df.columns], F.lit(label).alias(source))

    return part(history, "Historical").unionByName(
        part(forecast, "Forecast"), allowMissingColumns=True
    )
