"""Exact quantiles (linear interpolation), one way for every group size.

1. Rows become value counts per group, combined map-side, so a group of many
   equal values shuffles little.
2. The counts are range-partitioned on (group, value), sorted and written to the shared
   folder. All values of the counts are distinct within a group, so a hot group
   spreads evenly. A part is a stretch of at most PART_ROWS sorted counts, so it does not
   grow with the table.
3. One row per (group, part) carries how many values lie before it; there are at
   most as many of those rows as groups and parts together. The wanted ones are written,
   so Spark's size check sees how few they are: no join moves all counts to meet them.
4. Only parts that hold a wanted rank are ordered, each on its own.

The input is read once, also for mean and deviation, which come from the means and
variances of the parts; nothing depends on a row count, and infinite values are ordinary values.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from quotecast.functions.columns import join_on_keys, nan_to_null
from quotecast.functions.lineage import checkpoint

# Binary digits of the number of counts in a part; more where a part holds many groups.
PART_BITS, WIDE_PART_BITS = 16, 20


def value_counts(df, columns, keys=(), weight=None, missing=False, by_value=False):
    """keys..., column, _v, _c, _part: how often each value occurs, laid out by range.

    With ``missing`` there is a NULL value too, so that every group is present.
    ``weight`` names a column with the number of rows that a row stands for.
    ``by_value`` lays out by value before keys, for counts that are rolled up over keys:
    within any set of keys a later part has no smaller values.
    """
    group = [*keys, "column"]
    known = _long(df, columns, keys, weight)
    if not missing:
        known = known.where(F.col("_v").isNotNull())
    amount = F.sum("_w") if weight else F.count(F.lit(1))
    counts = known.groupBy(*group, "_v").agg(amount.alias("_c"))
    if by_value:
        return lay_out(counts, ["column", "_v", *keys], WIDE_PART_BITS)
    return lay_out(counts, [*group, "_v"])


def lay_out(counts, by, bits=PART_BITS):
    """The counts sorted over the whole table and written, with ``_part`` rising in that order."""
    ordered = counts.repartitionByRange(*by).sortWithinPartitions(*by)
    # Row numbers start anew, and higher, in every partition: no part reaches over two.
    return checkpoint(ordered.withColumn("_part", F.shiftright(F.monotonically_increasing_id(), bits)))


def part_sums(counts, keys=()):
    """keys..., column, _part, _c: the number, ends, mean and variance of the values that occur _c times.

    A row here stands for at least one of the counts, and mostly for a whole part of them.
    """
    v = F.col("_v")
    return checkpoint(counts.groupBy(*keys, "column", "_part", "_c").agg(
        F.count(v).alias("_values"),
        F.min(v).alias("_min"),
        F.max(v).alias("_max"),
        F.avg(v).alias("_mean"),
        F.var_pop(v).alias("_var"),
    ))


def moments_of(parts, keys=()):
    """Rows (keys..., column, n, min, max, mean, std) from ``part_sums``, for every group."""
    group = [*keys, "column"]
    rows = F.col("_values") * F.col("_c")
    mean = F.col("_sum") / F.nullif(F.col("n"), F.lit(0))
    first = parts.groupBy(*group).agg(
        F.sum(rows).alias("n"),
        F.min("_min").alias("min"),
        F.max("_max").alias("max"),
        F.sum(F.col("_mean") * rows).alias("_sum"),
    ).withColumn("mean", mean).drop("_sum")
    off = F.col("_mean") - F.col("mean")
    apart = (F.col("_var") + off * off) * rows
    spread = join_on_keys(parts, first.select(*group, "mean"), group).groupBy(*group).agg(F.sum(apart).alias("_m2"))
    std = F.when(F.col("n") > 1, F.sqrt(F.col("_m2") / (F.col("n") - 1)))
    return join_on_keys(first, spread, group).withColumn("std", std).drop("_m2")


def quantiles_of(counts, probs, keys=(), parts=None):
    """Rows (keys..., column, n, q) from value counts; ``parts`` are their ``part_sums``, where there are some already."""
    group = [*keys, "column"]
    counts = counts.where(F.col("_v").isNotNull())
    parts = part_sums(counts, keys) if parts is None else parts.where(F.col("_values") > 0)
    parts = parts.groupBy(*group, "_part").agg(F.sum(F.col("_values") * F.col("_c")).alias("_rows"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *group,
        "_part",
        "_rows",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("n"),
    )
    positions = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    ranks = [(F.floor(x), F.ceil(x)) for x in positions]
    first, end = F.col("_before"), F.col("_before") + F.col("_rows")
    holds = reduce(
        lambda a, b: a | b, [(r >= first) & (r < end) for pair in ranks for r in pair]
    )
    wanted = checkpoint(parts.where(holds).drop("_rows"))
    joined = join_on_keys(counts, wanted, [*group, "_part"])
    so_far = Window.partitionBy(*group, "_part").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    upto = F.col("_before") + F.sum("_c").over(so_far)
    ranked = joined.withColumn("_upto", upto)

    def at(rank):
        hit = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)
        return F.max(F.when(hit, F.col("_v")))

    found = ranked.groupBy(*group, "n").agg(*[
        at(rank).alias(f"_{side}_{j}")
        for j, pair in enumerate(ranks)
        for side, rank in zip(("lo", "hi"), pair)
    ])
    values = [
        _between(F.col(f"_lo_{j}"), F.col(f"_hi_{j}"), x - F.floor(x))
        for j, x in enumerate(positions)
    ]
    return found.select(*group, "n", F.array(*values).alias("q"))


def _between(low, high, fraction):
    """Value at a fraction of the way; an infinite end outweighs a finite one."""
    infinite = F.abs(low) == float("inf")
    return (
        F.when((low == high) | (fraction == 0), low)
        .when(infinite, F.when(F.abs(high) == float("inf"), F.lit(None)).otherwise(low))
        .otherwise(low + (high - low) * fraction)
    )


def exact_quantiles(df, columns, probs, keys=(), moments=False, weight=None):
    """Quantiles of every column: rows (keys..., column, n, q) where there are values.

    ``q`` is an array in the order of ``probs``; ``n`` counts non-null values.
    Between minus and plus infinity there is no value: NULL. With ``moments`` there
    are min, max, mean and std too, and groups without values are kept. ``weight``: see
    ``value_counts``.
    """
    counts = value_counts(df, columns, keys, weight, missing=moments)
    return counted_statistics(counts, probs, keys) if moments else quantiles_of(counts, probs, keys)


def counted_statistics(counts, probs, keys=()):
    """Moments and quantiles from value counts that hold the missing values too."""
    parts = part_sums(counts, keys)
    found = quantiles_of(counts, probs, keys, parts).drop("n")
    return join_on_keys(moments_of(parts, keys), found, [*keys, "column"], "left")


def quantile_values(df, columns, probs):
    """Whole-table quantiles on the driver: {column: [q...]}, a handful of numbers."""
    return counted_quantiles(value_counts(df, columns), columns, probs)


def counted_quantiles(counts, columns, probs):
    """``quantile_values`` from value counts of these and maybe other columns."""
    rows = quantiles_of(counts.where(F.col("column").isin(list(columns))), probs)
    found = {r["column"]: r["q"] for r in rows.collect()}
    return {c: found.get(c) or [None] * len(probs) for c in columns}


def _long(df, columns, keys, weight=None):
    """One row per value: keys..., column, _v (and _w); NaN counts as missing."""
    values = [nan_to_null(F.col(c).cast("double")) for c in columns]
    more = [F.col(weight).alias("_w")] if weight else []
    if len(columns) == 1:
        return df.select(*keys, F.lit(columns[0]).alias("column"), values[0].alias("_v"), *more)
    pairs = [F.struct(F.lit(c).alias("column"), v.alias("_v")) for c, v in zip(columns, values)]
    return df.select(*keys, *more, F.inline(F.array(*pairs)))
