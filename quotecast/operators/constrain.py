"""Business rules: derived from history, and forecasts adjusted to them."""

from math import inf

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotecast.functions.chain import chain_fit, violation
from quotecast.functions.columns import attach, clamp, join_on_keys
from quotecast.functions.folds import fold
from quotecast.functions.lineage import checkpoint
from quotecast.functions.ordered import neighbours
from quotecast.functions.quantiles import exact_quantiles

KINDS = ("auto", "bounds", "smoothness", "trend")
OBJECTIVES = {"cp_sat": "l1", "lp": "l2", "l1": "l1", "l2": "l2"}
FIELDS = {
    "min_value": "double",
    "max_value": "double",
    "smoothness_factor": "double",
    "monotonic": "string",
    "preserve_seasonality": "boolean",
}
# Margin around the observed range, share of changes a step may
# reach, least rows and least relative slope for a trend, default bound factors.
MARGIN = 0.1
CHANGE_SHARE = 0.95
TREND_ROWS = 6
TREND_SLOPE = 0.01
LOW_FACTOR, HIGH_FACTOR = 0.5, 1.5
SEASON_POINTS = 12
# A rule counts as met up to this share of the upper bound, for the last bits of sums.
TOLERANCE = 1e-9


def derive_constraints(history, value, keys=(), kind="auto", order_by=("date",)):
    """One row of constraints per key, from raw history rows; NULL where none applies.

    Rows count in the given order; rows equal in it are ordered by value, which
    makes the result the same for any layout of the table. With changes wanted the
    history is read once and written in that order to the shared folder.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown constraint type {kind!r}: use one of {KINDS}")
    number = F.col(value).cast("double")
    rows = history.select(
        *keys, *[c for c in order_by if c not in keys], number.alias("_value")
    ).dropna(subset=list(keys) or None, how="any" if keys else "all")
    bounds = kind in ("auto", "bounds")
    smooth, trend = kind in ("auto", "smoothness"), kind in ("auto", "trend")
    v = F.col("_value")
    aggs = []
    if smooth or trend:
        rows = neighbours(checkpoint(rows), keys, [*order_by, "_value"], "_value")
        rows = rows.withColumn("_change", F.abs(v - F.col("_lag")))
    if bounds:
        span = (F.max(v) - F.min(v)) * MARGIN
        aggs += [
            F.greatest(F.lit(0.0), F.min(v) - span).alias("min_value"),
            (F.max(v) + span).alias("max_value"),
        ]
    if trend:
        slope = F.regr_slope(v, F.col("_pos"))
        clear = (F.count(F.lit(1)) >= TREND_ROWS) & (F.count(v) == F.count(F.lit(1)))
        clear &= F.abs(slope) > F.avg(v) * TREND_SLOPE
        aggs.append(
            F.when(clear, F.when(slope > 0, "increasing").otherwise("decreasing")).alias("monotonic")
        )
    out = rows.groupBy(*keys).agg(*aggs) if aggs else rows.select(*keys).distinct()
    if smooth:
        found = exact_quantiles(rows, ["_change"], [CHANGE_SHARE], keys)
        found = found.select(*keys, F.col("q")[0].alias("smoothness_factor"))
        out = attach(out, found, keys, "left")
    return out.select(*keys, *[
        (F.col(c) if c in out.columns else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()
    ])


def user_constraints(
    min_value=0, max_value=0, smoothness_factor=0, monotonic=None, preserve_seasonality=False
):
    """Rules for every key alike; 0, None and False mean no such rule."""
    return {
        "min_value": min_value or None,
        "max_value": max_value or None,
        "smoothness_factor": smoothness_factor or None,
        "monotonic": monotonic if monotonic in ("increasing", "decreasing") else None,
        "preserve_seasonality": bool(preserve_seasonality) or None,
    }


def _rules_for(rows, table, keys):
    """Rule columns by key; without keys the table is a single row of literals."""
    if keys:
        return join_on_keys(rows, table, keys, "left")
    row = table.first()
    return rows.withColumns({
        f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in table.schema
    })


# Step rules: name -> build(d, c) giving, for every step between consecutive
# dates of the array d, struct(low, up) limits on the change; NULL where the rule
# is not asked for. c holds the constraint fields and ``season``, the twelve
# monthly means of the history.
STEP_RULES = {}


def register_constraint(name, build):
    """Add a step rule applied by constrain_forecast to every series."""
    STEP_RULES[name] = build


def _limits(low, up):
    return F.struct(low.cast("double").alias("low"), up.cast("double").alias("up"))


def _steps(d):
    """Positions 1..n-1 of an array; none for a single element."""
    return F.slice(F.sequence(F.lit(0), F.size(d) - 1), 2, F.size(d))


def smoothness_steps(d, c):
    s = c["smoothness_factor"]
    return F.when(s.isNotNull(), F.transform(_steps(d), lambda i: _limits(-s, s)))


def monotonic_steps(d, c):
    up = F.transform(_steps(d), lambda i: _limits(F.lit(0.0), F.lit(inf)))
    down = F.transform(_steps(d), lambda i: _limits(F.lit(-inf), F.lit(0.0)))
    return F.when(c["monotonic"] == "increasing", up).when(c["monotonic"] == "decreasing", down)


def seasonal_steps(d, c):
    """The change into a new month keeps the sign it has in the monthly means."""
    season = c["season"]

    def step(i):
        before, now = F.month(F.get(d, i - 1)) - 1, F.month(F.get(d, i)) - 1
        usual = F.get(season, (before + 1) % 12) - F.get(season, before)
        moved = before != now
        return _limits(
            F.when(moved & (usual > 0), 0.0).otherwise(-inf),
            F.when(moved & (usual < 0), 0.0).otherwise(inf),
        )

    return F.when(c["preserve_seasonality"] & season.isNotNull(), F.transform(_steps(d), step))


register_constraint("smoothness", smoothness_steps)
register_constraint("monotonic", monotonic_steps)
register_constraint("seasonality", seasonal_steps)


def constrain_forecast(forecast, constraints, keys=(), objective="l1", history=None):
    """Closest forecast that obeys the constraints: keys..., date, value, status.

    ``constraints``: a table with one row per key, or a dict for all keys alike.
    ``objective``: l1 (or cp_sat) least absolute, l2 (or lp) least squares.
    ``history``: the series, for the seasonal direction (l1 only). Where rules
    contradict each other the forecast is returned as it was, with status
    ``infeasible``; likewise where it lacks a value.
    """
    out = fitted_series(forecast, constraints, keys, objective, history)
    # The outer form keeps the optimizer from inferring a filter on the fit, for which
    # it would be computed a second time.
    out = out.select(*keys, F.explode_outer(F.arrays_zip("d", "x")).alias("_r"), "status")
    return out.where(F.col("_r").isNotNull()).select(
        *keys, F.col("_r.d").alias("date"), F.col("_r.x").alias("value"), "status"
    )


def fit_summary(forecast, constraints, keys=(), objective="l1", history=None):
    """How far the closest forecast is from the given one: keys..., cost, violation, status.

    ``cost`` is the sum of absolute (l1) or squared (l2) moves, which is unique where
    the fit itself is not; ``violation`` is by how much the worst step or value misses
    its rules, 0 where none does.
    """
    rows = fitted_series(forecast, constraints, keys, objective, history)
    size = (lambda m: m * m) if OBJECTIVES[objective.lower()] == "l2" else F.abs
    moves = F.zip_with("v", "x", lambda v, x: size(x - v))
    cost = F.aggregate(moves, F.lit(0.0), lambda a, m: a + m)
    return rows.select(*keys, cost.alias("cost"), "violation", "status")


def fitted_series(forecast, constraints, keys=(), objective="l1", history=None):
    """One row per key: d (dates), v (forecast), x (fit), violation, status."""
    try:
        objective = OBJECTIVES[objective.lower()]
    except KeyError:
        raise ValueError(f"Unknown optimizer type: {objective}") from None
    rows = fold(forecast, keys)
    if isinstance(constraints, DataFrame):
        rows = _rules_for(rows, constraints.select(*keys, *FIELDS), keys)
    else:
        rows = rows.withColumns({c: F.lit(constraints.get(c)).cast(t) for c, t in FIELDS.items()})
    seasonal = isinstance(constraints, DataFrame) or constraints.get("preserve_seasonality")
    if history is not None and objective == "l1" and seasonal:
        rows = _rules_for(rows, monthly_means(history, keys), keys)
    else:
        rows = rows.withColumn("season", F.lit(None).cast("array<double>"))

    v = F.transform("v", lambda x: x.cast("double"))
    least, most = F.array_min("v"), F.array_max("v")
    low = F.greatest(F.lit(0.0), least * LOW_FACTOR) if objective == "l1" else F.lit(0.0)
    rows = rows.withColumns({
        "v": v,
        "lo": F.coalesce("min_value", low),
        "hi": F.coalesce("max_value", most * HIGH_FACTOR),
    })
    c = {f: F.col(f) for f in (*FIELDS, "season")}
    applied = {name: build(F.col("d"), c) for name, build in STEP_RULES.items()}
    rows = rows.withColumns({f"_rule_{name}": rule for name, rule in applied.items()})
    coupled = F.lit(False)
    for name in STEP_RULES:
        coupled |= F.col(f"_rule_{name}").isNotNull()
    rows = rows.withColumns({"_coupled": coupled, "_low": _side("low", -inf), "_up": _side("up", inf)})
    sides = F.col("_low"), F.col("_up"), F.col("lo"), F.col("hi")
    possible = (
        (F.col("lo") <= F.col("hi")) & ~F.exists("v", lambda x: x.isNull())
        & F.forall(F.arrays_zip("_low", "_up"), lambda s: s["_low"] <= s["_up"])
    )
    bounded = F.transform("v", lambda x: clamp(x, F.col("lo"), F.col("hi")))
    fitted = F.when(F.col("_coupled"), chain_fit(objective, F.col("v"), *sides)).otherwise(bounded)
    rows = rows.withColumn("_fit", F.when(possible, fitted))
    rows = rows.withColumn("_miss", violation(F.col("_fit"), *sides))
    meets = (F.col("_miss") <= TOLERANCE * (1 + F.col("hi"))) & F.forall("_fit", lambda x: x.isNotNull())
    meets = F.coalesce(meets, F.lit(False))
    return rows.select(
        *keys,
        "d",
        "v",
        F.when(meets, F.col("_fit")).otherwise(F.col("v")).alias("x"),
        F.when(meets, F.when(F.col("_miss") > TOLERANCE, F.col("_miss")).otherwise(0.0)).alias("violation"),
        F.when(meets, "optimal").otherwise("infeasible").alias("status"),
    )


def monthly_means(history, keys=()):
    """keys..., season: means by calendar month of a series, if all twelve occur."""
    one = F.month("date")
    means = [F.avg(F.when(one == m, F.col("value"))) for m in range(1, 13)]
    months = F.array(*means)
    known = history.dropna(subset=["value"]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), months.alias("season")
    )
    full = (F.col("_n") >= SEASON_POINTS) & F.forall("season", lambda x: x.isNotNull())
    return known.where(full).drop("_n")


def _side(field, free):
    """One limit per step: the tightest over all rules."""
    pick = F.greatest if field == "low" else F.least
    rules = [F.col(f"_rule_{name}") for name in STEP_RULES]

    def at(i):
        return pick(F.lit(free), F.lit(free), *[F.get(r, i - 1)[field] for r in rules])

    return F.transform(_steps(F.col("d")), at)
