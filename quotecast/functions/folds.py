"""Array expressions over one folded series.

A series is folded to arrays only after it holds at most one value per key and
date, so an array never outgrows the calendar. Where whole numbers stand in for
dates they are period numbers (days, months, ...) and bounded alike. All expressions here run in the
JVM on ``(v, i)`` with positions from 0.
"""

from pyspark.sql import functions as F


def fold(series, keys, date="date", value="value"):
    """One row per key: ``d`` dates and ``v`` values in date order, ``n`` their number."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), F.col(value).alias("v"))))
    return (
        series.groupBy(*keys)
        .agg(pairs.alias("_s"))
        .select(
            *keys,
            F.transform("_s", lambda s: s["d"]).alias("d"),
            F.transform("_s", lambda s: s["v"]).alias("v"),
            F.size("_s").alias("n"),
        )
    )


def let(value, body):
    """body(value) with ``value`` computed once.

    A lambda evaluates what it captures again for every element, so anything
    costly is bound to a lambda argument first.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(xs):
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs):
    return F.try_divide(total(xs), F.size(xs))


def window_sum(xs, start, length):
    """Sum of ``length`` elements from position ``start``."""
    return total(F.slice(xs, F.greatest(start, F.lit(0)) + 1, F.greatest(length, F.lit(0))))


def last(xs, count):
    """The last ``count`` elements, or all if there are fewer."""
    return F.slice(xs, F.greatest(F.size(xs) - count, F.lit(0)) + 1, count)


def half(p):
    return F.floor(p / 2).cast("int")


def centered_mean(xs, p):
    """Mean over a season centred on each position; half weight on the outer two
    points where p is even; NULL within p // 2 of either end."""
    h = half(p)

    def at(_, i):
        whole = window_sum(xs, i - h, h * 2 + 1)
        ends = (F.get(xs, i - h) + F.get(xs, i + h)) / 2
        inner = (i >= h) & (i < F.size(xs) - h)
        return F.when(inner, F.when(p % 2 == 0, whole - ends).otherwise(whole) / p)

    return F.transform(xs, at)


def rolling_mean(xs, p):
    """Mean over exactly p points, p // 2 of them before the position; NULL at the ends."""
    h = half(p)

    def at(_, i):
        inner = (i >= h) & (i - h + p <= F.size(xs))
        return F.when(inner, window_sum(xs, i - h, p) / p)

    return F.transform(xs, at)


def fill_ends(xs):
    """Extend the first and last known values outwards over NULLs."""
    known = F.filter(xs, lambda x: x.isNotNull())
    ends = F.struct(
        F.array_position(F.transform(xs, lambda x: x.isNotNull()), F.lit(True)).alias("at"),
        F.get(known, F.lit(0)).alias("first"),
        F.get(known, F.size(known) - 1).alias("last"),
    )

    def fill(e):
        outer = lambda i: F.when(i < e["at"], e["first"]).otherwise(e["last"])
        return F.transform(xs, lambda x, i: F.coalesce(x, outer(i)))

    return let(ends, fill)


def season_means(xs, p):
    """Mean of the known values at each position modulo p."""

    def at(r):
        return mean(F.filter(xs, lambda x, i: (i % p == r) & x.isNotNull()))

    return F.transform(F.sequence(F.lit(0), p - 1), at)


def line(xs, start, stop):
    """Least-squares line through positions start..stop-1: struct(slope, intercept).

    Through one point the smallest-norm solution is taken.
    """
    count = stop - start
    ys = F.slice(xs, start + 1, F.greatest(count, F.lit(0)))
    x_mid = (start + stop - 1) / 2
    sxx = count * (count * count - 1) / 12.0
    sxy = F.aggregate(
        F.transform(ys, lambda y, i: y * (start + i - x_mid)), F.lit(0.0), lambda a, x: a + x
    )
    y0 = F.get(ys, F.lit(0))
    slope = F.when(count == 1, y0 * start / (start * start + 1.0)).otherwise(
        F.try_divide(sxy, sxx)
    )
    base = F.when(count == 1, y0 / (start * start + 1.0)).otherwise(mean(ys) - slope * x_mid)
    return F.struct(slope.alias("slope"), base.alias("intercept"))


def pairs_at(xs, lag):
    """Array of struct(a, b): every known element with the known one ``lag`` places before."""
    later = F.slice(xs, lag + 1, F.greatest(F.size(xs) - lag, F.lit(0)))
    both = F.transform(later, lambda x, i: F.struct(x.alias("a"), F.get(xs, i).alias("b")))
    return F.filter(both, lambda p: p["a"].isNotNull() & p["b"].isNotNull())


def comoments(pairs):
    """struct(n, saa, sbb, sab, same_a, same_b): sums of products about the means, and
    whether a side has one value only (whose sums may be off zero by a last bit)."""
    sides = F.struct(
        pairs.alias("ps"), F.transform(pairs, lambda p: p["a"]).alias("a"), F.transform(pairs, lambda p: p["b"]).alias("b")
    )

    def sums(w):
        centre = F.struct(w["ps"].alias("ps"), mean(w["a"]).alias("a"), mean(w["b"]).alias("b"))

        def about(product):
            return let(centre, lambda c: total(F.transform(c["ps"], lambda p: product(p["a"] - c["a"], p["b"] - c["b"]))))

        return F.struct(
            F.size(w["ps"]).alias("n"),
            about(lambda a, b: a * a).alias("saa"),
            about(lambda a, b: b * b).alias("sbb"),
            about(lambda a, b: a * b).alias("sab"),
            (F.array_min(w["a"]) == F.array_max(w["a"])).alias("same_a"),
            (F.array_min(w["b"]) == F.array_max(w["b"])).alias("same_b"),
        )

    return let(sides, sums)


def correlation(pairs):
    """Pearson over struct(a, b) pairs; NULL without pairs or where a side is constant."""
    return let(
        comoments(pairs),
        lambda m: F.when((m["n"] > 0) & ~m["same_a"] & ~m["same_b"], F.try_divide(m["sab"], F.sqrt(m["saa"] * m["sbb"]))),
    )


def variance(xs):
    """Sample variance of the known values; NULL below two."""
    known = F.filter(xs, lambda x: x.isNotNull())
    about = lambda w: total(F.transform(w["xs"], lambda x: (x - w["m"]) * (x - w["m"])))
    both = F.struct(known.alias("xs"), mean(known).alias("m"))
    return let(both, lambda w: F.when(F.size(w["xs"]) > 1, about(w) / F.greatest(F.size(w["xs"]) - 1, F.lit(1))))


def interpolated(xs):
    """NULLs on a straight line by position; trailing ones take the last known value,
    those before the first known one stay."""
    placed = F.transform(xs, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    known = F.filter(placed, lambda k: k["x"].isNotNull())

    def fill(ks):
        def at(x, i):
            before = F.get(F.reverse(F.filter(ks, lambda k: k["i"] < i)), F.lit(0))
            after = F.get(F.filter(ks, lambda k: k["i"] > i), F.lit(0))
            ends = F.struct(before.alias("p"), after.alias("q"))
            line = lambda e: e["p"]["x"] + (e["q"]["x"] - e["p"]["x"]) / F.nullif(e["q"]["i"] - e["p"]["i"], F.lit(0)) * (i - e["p"]["i"])
            between = let(ends, lambda e: F.when(e["q"].isNull(), e["p"]["x"]).when(e["p"].isNotNull(), line(e)))
            return F.when(x.isNotNull(), x).otherwise(between)

        return F.transform(xs, at)

    return F.when(F.exists(xs, lambda x: x.isNull()), let(known, fill)).otherwise(xs)
