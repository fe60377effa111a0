"""From history rows to one value per key and date, and dates beyond the last.

Everything after ``to_series`` works on at most one row per key and calendar
date, so a window over one key is bounded however many raw rows the key has.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotecast.functions.folds import fold, let
from quotecast.functions.ordered import blend, neighbours

STEPS = {"day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months"}


def bucket(date, freq):
    """Label of the calendar bucket: a week by its Sunday, others by their first day."""
    day = F.col(date).cast("date")
    if freq == "day":
        return day
    if freq == "week":
        return F.next_day(F.date_sub(day, 1), "SUN")
    if freq in STEPS:
        return F.trunc(day, freq)
    raise ValueError(f"unknown frequency {freq!r}: use one of {tuple(STEPS)}")


def as_number(df, value):
    """The column; text as double."""
    is_text = isinstance(df.schema[value].dataType, T.StringType)
    return F.col(value).cast("double") if is_text else F.col(value)


def to_series(df, value, keys=(), freq="day", fill_spine=False, date="date"):
    """Mean per key and bucket: keys..., date, value. Rows lacking either are left out.

    The mean combines map-side, so a key holding most rows shuffles only one
    partial sum per task and date. ``fill_spine`` adds empty buckets as NULL.
    """
    rows = df.select(*keys, bucket(date, freq).alias("date"), as_number(df, value).alias("value"))
    series = rows.dropna(subset=["date", "value"]).groupBy(*keys, "date").agg(
        F.avg("value").alias("value")
    )
    return fill_gaps(series, keys, freq) if fill_spine else series


def fill_gaps(series, keys, freq):
    """Every bucket between a key's first and last, NULL where there was no row."""
    following = F.lead("date").over(_by_date(keys))
    stop = F.coalesce(F.date_sub("_next", 1), F.col("date"))
    days = F.sequence(F.col("date"), stop, F.expr(f"interval {STEPS[freq]}"))
    return (
        series.withColumn("_next", following)
        .withColumn("_day", F.explode(days))
        .withColumn("value", F.when(F.col("_day") == F.col("date"), F.col("value")))
        .withColumn("date", F.col("_day").cast("date"))
        .drop("_day", "_next")
    )


def _by_date(keys):
    return Window.partitionBy(*(list(keys) or [F.lit(0)])).orderBy("date")


def month_key(df, date="date"):
    """Add ``month`` as yyyy-MM."""
    return df.withColumn("month", F.date_format(date, "yyyy-MM"))


def interpolate(series, keys=(), leading=True):
    """Fill NULLs on a straight line by position; ends take the nearest known value.

    ``leading=False`` leaves NULLs before the first known value.
    """
    filled = blend()
    if not leading:
        filled = F.when(F.col("_back").isNotNull(), filled)
    scanned = neighbours(series, keys, ["date"], "value", bounded=True)
    return scanned.withColumn("value", filled).select(*series.columns)


def moving_averages(series, keys=(), windows=(3, 6, 12)):
    """Add ``ma_<w>``: trailing means over full windows, for series longer than w."""
    by_date = _by_date(keys)
    everything = Window.partitionBy(*(list(keys) or [F.lit(0)]))
    length = F.count(F.lit(1)).over(everything)
    added = {}
    for w in windows:
        trailing = by_date.rowsBetween(1 - w, 0)
        full = (F.count("value").over(trailing) == w) & (length > w)
        added[f"ma_{w}"] = F.when(full, F.avg("value").over(trailing))
    return series.withColumns(added)


def calendar(d):
    """Frequency of a folded date array: struct(unit, base, step, monthly, quarterly).

    Dates follow as: first = last date moved by ``base`` units (snapped to the
    unit's anchor), then every ``step`` units. A regular spacing of three or more
    dates decides; otherwise the gap between the last two dates does.
    """
    n = F.size(d)
    tail = F.slice(d, 2, F.greatest(n - 1, F.lit(0)))
    spacing = F.struct(
        F.transform(tail, lambda x, i: F.datediff(x, F.get(d, i))).alias("days"),
        F.transform(
            tail,
            lambda x, i: (F.year(x) - F.year(F.get(d, i))) * 12 + F.month(x) - F.month(F.get(d, i)),
        ).alias("months"),
    )
    return let(spacing, lambda s: _rule(d, n, tail, s["days"], s["months"]))


def _rule(d, n, tail, gaps, months):
    # Weekdays count from Monday = 0.
    business = F.forall(
        F.transform(
            tail,
            lambda x, i: F.datediff(x, F.get(d, i)) == F.when(F.weekday(x) == 0, 3).otherwise(1),
        ),
        lambda ok: ok,
    ) & F.forall(d, lambda x: F.weekday(x) < 5)
    enough = n >= 3
    starts = F.forall(d, lambda x: F.dayofmonth(x) == 1)
    ends = F.forall(d, lambda x: x == F.last_day(x))
    month_gap, day_gap, last_gap = F.array_max(months), F.array_max(gaps), F.get(gaps, n - 2)
    even_months = enough & (F.array_min(months) == month_gap) & (month_gap > 0)
    even_days = enough & (F.array_min(gaps) == day_gap)
    anchor = F.when(month_gap % 12 == 0, 12).when(month_gap % 3 == 0, 3).otherwise(1)
    week_gap = day_gap % 7 == 0
    same_weekday = F.forall(gaps, lambda g: g % 7 == 0)

    def rule(unit, base, step):
        regular = even_months if unit in ("month_start", "month_end") else F.lit(False)
        return F.struct(
            F.lit(unit).alias("unit"),
            (F.lit(base) if isinstance(base, int) else base).cast("int").alias("base"),
            (F.lit(step) if isinstance(step, int) else step).cast("int").alias("step"),
            (regular & (month_gap == 1)).alias("monthly"),
            (regular & (month_gap == 3)).alias("quarterly"),
        )

    return (
        F.when(n < 2, rule("month", 1, 1))
        .when(even_months & starts, rule("month_start", anchor, month_gap))
        .when(even_months & ends, rule("month_end", anchor, month_gap))
        .when(even_days, rule("day", F.when(week_gap, 7).otherwise(1), day_gap))
        .when(enough & business, rule("business", 1, 1))
        .when(last_gap.between(28, 31), rule("month", 1, 1))
        .when(last_gap.between(89, 92), rule("quarter", 3, 3))
        .when((last_gap == 7) & enough & same_weekday, rule("day", 7, 7))
        .when(last_gap == 7, rule("sunday", 7, 7))
        .otherwise(rule("day", 1, 1))
    )


def dates_after(last, rule, horizon):
    """Array of ``horizon`` dates following ``last`` by a calendar rule."""
    steps = F.sequence(F.lit(0), F.lit(horizon - 1))
    unit, base, step = rule["unit"], rule["base"], rule["step"]
    # Five weekdays a week: twice the horizon and a week always holds enough of them.
    workdays = F.slice(
        F.filter(
            F.sequence(F.date_add(last, 1), F.date_add(last, horizon * 2 + 7)),
            lambda x: F.weekday(x) < 5,
        ),
        1,
        horizon,
    )
    return (
        F.when(unit == "business", workdays)
        .when(unit == "month_end", F.transform(
            steps, lambda i: F.last_day(F.add_months(last, base + step * i))
        ))
        .when(unit == "month_start", F.transform(
            steps, lambda i: F.add_months(last, base + step * i)
        ))
        .when(unit == "month", F.transform(
            steps, lambda i: F.add_months(F.trunc(last, "month"), base + step * i)
        ))
        .when(unit == "quarter", F.transform(
            steps, lambda i: F.add_months(F.trunc(last, "quarter"), base + step * i)
        ))
        .when(unit == "sunday", F.transform(
            steps, lambda i: F.date_add(F.next_day(last, "SUN"), step * i)
        ))
        .otherwise(F.transform(steps, lambda i: F.date_add(last, base + step * i)))
    )


def next_index(d, is_date, horizon):
    """The ``horizon`` dates, or whole numbers, that follow a folded index."""
    final = F.get(d, F.size(d) - 1)
    if is_date:
        return let(calendar(d), lambda rule: dates_after(final, rule, horizon))
    return F.transform(
        F.sequence(F.lit(1), F.lit(horizon)), lambda i: final + i.cast("bigint")
    )


def has_dates(series):
    return not isinstance(series.schema["date"].dataType, T.IntegralType)


def future_dates(series, keys=(), horizon=12):
    """keys..., step (from 1), date: where a forecast of the series falls."""
    folded = fold(series.dropna(subset=["value"]), keys)
    index = next_index(F.col("d"), has_dates(series), horizon)
    return folded.select(*keys, F.posexplode(index).alias("step", "date")).withColumn(
        "step", F.col("step") + 1
    )
