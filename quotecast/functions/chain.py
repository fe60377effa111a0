"""Closest sequence whose consecutive steps and values stay within limits.

``v`` is moved as little as possible so that ``low[i] <= x[i+1] - x[i] <= up[i]``
and ``lo <= x <= hi`` (a step's limits may be infinite, ``lo`` and ``hi`` are not).
Both objectives are solved exactly by one fold over the sequence, which carries the
slope of the least cost so far as a function of the current value, and a second
one back from the end. Everything is an array expression; sequences are one
forecast horizon long.
"""

from math import inf

from pyspark.sql import functions as F

from quotecast.functions.columns import clamp
from quotecast.functions.folds import let


def chain_fit(objective, v, low, up, lo, hi):
    """Fitted array of v; objective l1 (absolute moves) or l2 (squares)."""
    best = (least_absolute if objective == "l1" else least_squares)(v, low, up, lo, hi)
    return let(best, lambda m: _walk_back(m, low, up))


def violation(x, low, up, lo, hi):
    """By how much the worst step or value of x misses its limits; 0 where none does."""
    steps = F.arrays_zip(F.slice(x, 1, F.size(x) - 1).alias("a"), F.slice(x, 2, F.size(x)).alias("b"), low.alias("low"), up.alias("up"))
    worst = F.greatest(F.lit(0.0), lo - F.array_min(x), F.array_max(x) - hi)
    return F.aggregate(
        steps, worst, lambda w, t: F.greatest(w, t["low"] - (t["b"] - t["a"]), (t["b"] - t["a"]) - t["up"])
    )


def _steps(v, low, up):
    return F.arrays_zip(F.slice(v, 2, F.size(v)).alias("y"), low.alias("low"), up.alias("up"))


def _walk_back(best, low, up):
    """From the last value back: each takes its best place that the next one allows."""
    n = F.size(best)
    steps = F.arrays_zip(F.slice(best, 1, n - 1).alias("m"), low.alias("low"), up.alias("up"))

    def back(xs, t):
        after = F.get(xs, F.lit(0))
        return F.concat(F.array(clamp(t["m"], after - t["up"], after - t["low"])), xs)

    return F.aggregate(F.reverse(steps), F.array(F.get(best, n - 1)), back)


def least_absolute(v, low, up, lo, hi):
    """Best value of each prefix's last element, for the least sum of absolute moves.

    The slope is held as its kinks, sorted: ``left`` of the best value and ``right``
    of it. A step moves the left ones by its lower and the right ones by its upper
    limit. Bounds are walls of more kinks than there are elements.
    """

    def wall(x):
        return F.array_repeat(x, F.size(v) + 1)

    def add(sides, y, best):
        def cut(w):
            k = w["k"]
            return F.struct(
                F.slice(w["kinks"], 1, k).alias("left"),
                F.slice(w["kinks"], k + 1, F.size(w["kinks"])).alias("right"),
                F.concat(best, F.array(F.get(w["kinks"], k - 1))).alias("best"),
            )

        def kinks(s):
            held = F.array_sort(F.concat(s["left"], F.array(y, y), s["right"]))
            return let(F.struct(held.alias("kinks"), (F.size(s["left"]) + 1).alias("k")), cut)

        return let(sides, kinks)

    def step(s, t):
        left = F.when(t["low"] == -inf, wall(lo)).otherwise(
            F.transform(s["left"], lambda x: F.greatest(x + t["low"], lo)))
        right = F.when(t["up"] == inf, wall(hi)).otherwise(
            F.transform(s["right"], lambda x: F.least(x + t["up"], hi)))
        return add(F.struct(left.alias("left"), right.alias("right")), t["y"], s["best"])

    none = F.array().cast("array<double>")
    start = add(F.struct(wall(lo).alias("left"), wall(hi).alias("right")), F.get(v, F.lit(0)), none)
    return F.aggregate(_steps(v, low, up), start, step, lambda s: s["best"])


def _point(x, g):
    return F.struct(x.cast("double").alias("x"), g.cast("double").alias("g"))


def _between(p, q, x):
    """Slope at x on the line through two points."""
    return p["g"] + (q["g"] - p["g"]) * (x - p["x"]) / F.nullif(q["x"] - p["x"], F.lit(0.0))


def _zero(points):
    """Where the slope crosses zero; a jump over zero is at one value."""
    first = F.get(F.filter(points, lambda p: p["g"] >= 0), F.lit(0))
    last = F.get(F.reverse(F.filter(points, lambda p: p["g"] < 0)), F.lit(0))

    def cross(w):
        p, q = w["p"], w["q"]
        flat = (p["x"] == q["x"]) | (q["g"] == 0)
        return F.when(flat, q["x"]).otherwise(p["x"] - p["g"] * (q["x"] - p["x"]) / (q["g"] - p["g"]))

    return let(F.struct(last.alias("p"), first.alias("q")), cross)


def _walled(points, lo, hi):
    """The slope inside [lo, hi]: minus infinity below, infinity above."""

    def low(ps):
        out, rest = F.filter(ps, lambda p: p["x"] < lo), F.filter(ps, lambda p: p["x"] >= lo)

        def cut(w):
            edge = F.get(w["rest"], F.lit(0))
            here = F.when(edge["x"] == lo, edge["g"]).otherwise(_between(F.get(w["out"], F.size(w["out"]) - 1), edge, lo))
            put = F.concat(F.array(_point(lo, F.lit(-inf)), _point(lo, here)), w["rest"])
            return F.when(F.size(w["out"]) == 0, w["rest"]).otherwise(put)

        return let(F.struct(out.alias("out"), rest.alias("rest")), cut)

    def high(ps):
        out, rest = F.filter(ps, lambda p: p["x"] > hi), F.filter(ps, lambda p: p["x"] <= hi)

        def cut(w):
            edge = F.get(w["rest"], F.size(w["rest"]) - 1)
            here = F.when(edge["x"] == hi, edge["g"]).otherwise(_between(edge, F.get(w["out"], F.lit(0)), hi))
            put = F.concat(w["rest"], F.array(_point(hi, here), _point(hi, F.lit(inf))))
            return F.when(F.size(w["out"]) == 0, w["rest"]).otherwise(put)

        return let(F.struct(out.alias("out"), rest.alias("rest")), cut)

    return let(let(points, low), high)


def least_squares(v, low, up, lo, hi):
    """Best value of each prefix's last element, for the least sum of squared moves.

    The slope is piecewise linear and held as its breakpoints (x, g) in order. A
    step parts it at zero: the falling side moves by the step's lower limit, the
    rising side by its upper one, and between them the slope is zero.
    """

    def add(points, y):
        return F.transform(points, lambda p: _point(p["x"], p["g"] + 2 * (p["x"] - y)))

    def step(s, t):
        def moved(m):
            low_end, up_end = m + t["low"], m + t["up"]
            left = F.concat(
                F.transform(F.filter(s["points"], lambda p: p["g"] < 0), lambda p: _point(p["x"] + t["low"], p["g"])),
                F.array(_point(low_end, F.lit(0.0))),
            )
            right = F.concat(
                F.array(_point(up_end, F.lit(0.0))),
                F.transform(F.filter(s["points"], lambda p: p["g"] > 0), lambda p: _point(p["x"] + t["up"], p["g"])),
            )
            start, end = F.least(lo, up_end), F.greatest(hi, low_end)
            left = F.when(t["low"] == -inf, F.array(_point(start, F.lit(-inf)), _point(start, F.lit(0.0)))).otherwise(left)
            right = F.when(t["up"] == inf, F.array(_point(end, F.lit(0.0)), _point(end, F.lit(inf)))).otherwise(right)
            return F.struct(
                add(_walled(F.concat(left, right), lo, hi), t["y"]).alias("points"), F.concat(s["best"], F.array(m)).alias("best")
            )

        return let(_zero(s["points"]), moved)

    flat = F.array(_point(lo, F.lit(-inf)), _point(lo, F.lit(0.0)), _point(hi, F.lit(0.0)), _point(hi, F.lit(inf)))
    start = F.struct(add(flat, F.get(v, F.lit(0))).alias("points"), F.array().cast("array<double>").alias("best"))
    return F.aggregate(
        _steps(v, low, up), start, step, lambda s: F.concat(s["best"], F.array(_zero(s["points"])))
    )
