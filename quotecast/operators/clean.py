"""Cleaning: missing values, outliers, and the before/after table.

Columns are cleaned in the configured order. A column's statistics depend only
on its own values and on which rows are left, so consecutive columns whose
strategies drop no rows share one round of statistics: one read of the input counts
the values of all of them, and gaps, means, medians, fences and tails come from those counts.
Only modes of columns that are no numbers, and values that a fill along the
rows has put in, are counted apart. The statistics are a few numbers per column and become
literals, so the cleaned table is a plain projection that no later action
recomputes statistics for.
"""

from pyspark.sql import functions as F

from quotecast.functions.columns import clamp, nan_to_null
from quotecast.functions.lineage import checkpoint
from quotecast.functions.ordered import blend, carry_back, carry_forward, near_rows
from quotecast.functions.quantiles import counted_quantiles, lay_out, quantile_values, value_counts
from quotecast.operators.filters import drop_incomplete
from quotecast.schema import MEASURES, is_numeric, is_temporal

ORDERED_FILLS = {"interpolate": blend, "ffill": carry_forward, "bfill": carry_back}
MISSING_STRATEGIES = ("drop", "mean", "median", "mode", "zero", *ORDERED_FILLS)
COUNTED_FILLS = ("mean", "median", "mode")
OUTLIER_STRATEGIES = ("clip", "remove", "iqr", "winsorize")
DROPPING_OUTLIERS = ("remove", "iqr")
FENCE = 1.5
TAILS = (0.05, 0.95)
BOUNDS = (TAILS[0], 0.25, 0.75, TAILS[1])


def default_config(df):
    """Strategies by role and type."""
    config = {}
    for c in df.columns:
        if is_numeric(df, c):
            measure = c in MEASURES
            config[c] = {
                "missing": "median" if measure else "mean",
                "outlier": "winsorize" if measure else "clip",
            }
        elif is_temporal(df, c):
            config[c] = {"missing": "drop"}
        else:
            config[c] = {"missing": "mode"}
    return config


def clean(df, config=None, keys=(), order_by=("date",)):
    """Apply the configured strategies, then drop rows without date, price or lead time.

    ``keys`` and ``order_by`` say what the order-dependent fills (interpolate,
    ffill, bfill) run along; rows equal in them are ordered by their other columns.
    """
    config = default_config(df) if config is None else config
    plan = [(c, s) for c, s in config.items() if c in df.columns]
    if not plan:
        return drop_incomplete(df)
    for c, s in plan:
        _check(c, s)
    run = _Cleaning(keys, order_by)
    if any(s.get("missing") in ORDERED_FILLS for _, s in plan):
        df = checkpoint(df)  # counted, sampled and sorted: the input is read once
    run.count(df, plan)
    stage = []
    for c, strategy in plan:
        if run.may_drop(df, c, strategy):
            df = run.stage(run.stage(df, stage), [(c, strategy)])
            stage = []
        else:
            stage.append((c, strategy))
    return drop_incomplete(run.stage(df, stage))


def _check(column, strategy):
    missing, outlier = strategy.get("missing"), strategy.get("outlier")
    if missing is not None and missing not in MISSING_STRATEGIES:
        raise ValueError(f"{column}: unknown missing strategy {missing!r}")
    if outlier is not None and outlier not in OUTLIER_STRATEGIES:
        raise ValueError(f"{column}: unknown outlier strategy {outlier!r}")


class _Cleaning:
    """What one call of clean knows: value counts, gaps and order.

    Rows only ever leave, so a column without gaps at the start never has any.
    """

    def __init__(self, keys, order_by):
        self.keys, self.order_by = keys, order_by
        self.counts = self.nulls = None

    def count(self, df, plan):
        """Count the values of all columns in one read; where their strategies need none, only the gaps."""
        columns = [c for c, _ in plan]
        told = [
            F.col(c) if is_numeric(df, c) and (s.get("outlier") or s.get("missing") in COUNTED_FILLS)
            else F.when(F.col(c).isNotNull(), 0.0).alias(c)
            for c, s in plan
        ]
        self.counts = value_counts(df.select(*told), columns, missing=True)
        if self.nulls is None:
            gaps = self.counts.groupBy("column").agg(
                F.sum("_c").alias("rows"), F.sum(F.when(F.col("_v").isNull(), F.col("_c")).otherwise(0)).alias("gaps"))
            found = {r["column"]: r for r in gaps.collect()}
            self.rows = max((r["rows"] for r in found.values()), default=0)
            self.nulls = {c: found[c]["gaps"] if c in found else 0 for c in columns}

    def may_drop(self, df, column, strategy):
        number = is_numeric(df, column)
        if number and strategy.get("outlier") in DROPPING_OUTLIERS:
            return True
        missing = strategy.get("missing")
        if missing is None or not self.nulls[column]:
            return False
        return missing == "drop" or not (number or missing == "mode")

    def stage(self, df, columns):
        """Columns cleaned together: none of them drops rows, or there is only one."""
        if not columns:
            return df
        if self.counts is None:
            self.count(df, columns)
        treated = {c: s["outlier"] for c, s in columns if s.get("outlier") and is_numeric(df, c)}
        before = df
        df, counts = self._fill(df, {c: s["missing"] for c, s in columns if s.get("missing")}, list(treated))
        df = self._treat_outliers(df, treated, counts) if treated else df
        if len(columns) == 1 and self.may_drop(before, *columns[0]):
            self.counts = None  # other rows from here on
        return df

    def _fill(self, df, wanted, counted):
        """The table without gaps, and the value counts of the ``counted`` columns in it."""
        gaps = {c: how for c, how in wanted.items() if self.nulls[c]}
        fills, drops, ordered = {}, [], {}
        means, medians = [], []
        for c, how in gaps.items():
            number = is_numeric(df, c)
            if how == "mode":
                fills[c] = self._most_frequent(c) if number else _most_frequent(df, c)
            elif how in ORDERED_FILLS and (number or how != "interpolate"):
                ordered[c] = how
                if not number:
                    drops.append(c)
                elif self.keys or self.nulls[c] == self.rows:
                    medians.append(c)
            elif how == "drop" or not number:
                drops.append(c)
            elif how == "zero":
                fills[c] = 0
            else:
                (means if how == "mean" else medians).append(c)
        if ordered:
            df = self._ordered_fill(df, ordered)
            tried = [c for c in medians if c in ordered]
            if tried:  # a key without any value is still open
                still = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in tried]).first()
                medians = [c for c in medians if c not in ordered or still[c]]
        anew = [c for c in ordered if c in medians or c in counted]
        counts = self.counts.where(F.col("_v").isNotNull())
        if anew:
            filled = value_counts(df.select(*anew), anew)
            last = counts.agg(F.max("_part")).first()[0] or 0  # parts of one column only ever follow each other
            counts = counts.where(~F.col("column").isin(anew)).unionByName(
                filled.withColumn("_part", F.col("_part") + F.lit(last + 1)))
        if means:
            rows = counts.where(F.col("column").isin(means)).groupBy("column").agg(
                (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"))
            fills |= dict.fromkeys(means) | {r["column"]: r["mean"] for r in rows.collect()}
        if medians:
            fills |= {c: q[0] for c, q in counted_quantiles(counts, medians, [0.5]).items()}
        values, numbers = {}, {}
        for c, fill in fills.items():
            kind = "double" if c in means or c in medians else df.schema[c].dataType
            fill = 0 if fill is None else fill
            own = nan_to_null(F.col(c)) if df.schema[c].dataType.typeName() in ("double", "float") else F.col(c)
            values[c] = F.coalesce(own.cast(kind), F.lit(fill).cast(kind))
            if is_numeric(df, c) and c in counted:
                numbers[c] = float(fill)
        df = df.withColumns(values) if values else df
        df = df.dropna(subset=drops) if drops else df
        return df, self._with_fills(counts, numbers, set(anew), df)

    def _with_fills(self, counts, fills, anew, df):
        """Value counts with the filled gaps among them."""
        if not fills:
            return counts
        changed = F.col("column").isin(list(fills))
        left = [c for c in fills if c not in anew]
        rows = counts.where(changed).select("column", "_v", "_c")
        if left:
            value = F.create_map(*(F.lit(x) for c in left for x in (c, fills[c])))
            gaps = self.counts.where(F.col("_v").isNull() & F.col("column").isin(left))
            put = gaps.select("column", value[F.col("column")].alias("_v"), "_c")
            rows = rows.unionByName(put)
        if set(fills) & anew:  # what the fill along the rows left open
            again = [c for c in fills if c in anew]
            rows = rows.where(~F.col("column").isin(again)).unionByName(
                value_counts(df.select(*again), again).select("column", "_v", "_c"))
        laid_out = lay_out(rows.groupBy("column", "_v").agg(F.sum("_c").alias("_c")), ["column", "_v"])
        last = counts.agg(F.max("_part")).first()[0] or 0
        laid_out = laid_out.withColumn("_part", F.col("_part") + F.lit(last + 1))
        return counts.where(~changed).unionByName(laid_out.select(counts.columns))

    def _most_frequent(self, column):
        """Most frequent number, smallest among equals."""
        top = self.counts.where((F.col("column") == column) & F.col("_v").isNotNull()).orderBy(F.desc("_c"), "_v").first()
        if top is None:
            raise ValueError(f"{column}: no value to take the mode of")
        return top["_v"]

    def _ordered_fill(self, df, ordered):
        """Fills that follow the order of the rows: one sort for all columns."""
        columns = df.columns
        scanned = near_rows(df, self.keys, self.order_by, list(ordered))
        near = F.col("_near")
        # Columns of their own are worked out once a row, and only in gaps: a known value is its own fill.
        ends = {(c, x): f"_{i}_{x}" for i, c in enumerate(ordered) for x in ("back", "ahead")}
        scanned = scanned.withColumns({name: F.when(F.col(c).isNull(), near[c][x]) for (c, x), name in ends.items()})
        filled = {}
        for c, how in ordered.items():
            kind = "double" if how == "interpolate" else df.schema[c].dataType
            fill = ORDERED_FILLS[how](F.col(ends[c, "back"]), F.col(ends[c, "ahead"]))
            filled[c] = F.coalesce(F.col(c).cast(kind), fill.cast(kind))
        # Written: filters on filled columns would else be pushed below the fill and repeat it.
        return checkpoint(scanned.withColumns(filled).select(*columns))

    def _treat_outliers(self, df, treated, counts):
        bounds = _bounds(counted_quantiles(counts, list(treated), BOUNDS))
        clamped, kept = {}, None
        for c, how in treated.items():
            if how in DROPPING_OUTLIERS:
                lo, hi = bounds[c]["fence"] if bounds[c] else (None, None)
                kept = F.col(c).between(F.lit(lo).cast("double"), F.lit(hi).cast("double"))
            elif bounds[c]:
                lo, hi = bounds[c]["tails" if how == "winsorize" else "fence"]
                clamped[c] = clamp(F.col(c).cast("double"), F.lit(lo), F.lit(hi))
        df = df.withColumns(clamped) if clamped else df
        return df.where(kept) if kept is not None else df


def _most_frequent(df, column):
    """Most frequent value, smallest among equals; counts are combined before the sort."""
    top = (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .count()
        .orderBy(F.desc("count"), column)
        .first()
    )
    if top is None:
        raise ValueError(f"{column}: no value to take the mode of")
    return top[column]


def outlier_bounds(df, columns):
    """{column: {fence, tails}} as (low, high) pairs, from one round of exact quantiles."""
    return _bounds(quantile_values(df, columns, BOUNDS))


def _bounds(found):
    bounds = {}
    for c, (low, q1, q3, high) in found.items():
        if q1 is None:
            bounds[c] = None
            continue
        reach = FENCE * (q3 - q1)
        floor = 0.0 if c in MEASURES else float("-inf")
        bounds[c] = {
            "fence": (max(floor, q1 - reach), q3 + reach),
            "tails": (max(floor, low), high),
        }
    return bounds


def cleaning_summary(raw, cleaned):
    """Per column: missing before and after; plus row counts of both tables."""

    def missing(df, name):
        counts = [F.count(F.lit(1)).alias("_rows")]
        counts += [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
        pairs = [
            F.struct(F.lit(c).alias("column"), F.col(c).alias(f"{name}_missing"))
            for c in df.columns
        ]
        return df.agg(*counts).select(
            F.col("_rows").alias(f"{name}_rows"), F.inline(F.array(*pairs))
        )

    return missing(raw, "raw").join(missing(cleaned, "clean"), "column", "full")
