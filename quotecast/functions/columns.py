"""Small Column builders used across operators."""

from functools import reduce

from pyspark.sql import functions as F


def nan_to_null(c):
    return F.when(~F.isnan(c), c)


def clamp(c, lo, hi):
    """Limit c to [lo, hi]; NULL stays NULL (greatest/least alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def safe_corr(x, y):
    """Pearson over pairwise complete rows; NULL when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def join_on_keys(left, right, keys, how="inner"):
    """Null-safe equi-join on keys that keeps one copy of the key columns."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys],
    )
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def attach(left, right, keys, how="inner"):
    """Columns of right by keys; without keys right is one row, read as a scalar subquery."""
    if keys:
        return join_on_keys(left, right, keys, how)
    row = right.select(F.struct("*")).scalar()
    return left.withColumns({c: row[c] for c in right.columns})
