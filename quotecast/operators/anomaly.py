"""Anomaly flags on one numeric column."""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from quotecast.functions.quantiles import quantile_values, value_counts
from quotecast.schema import is_numeric

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES = 100
TREE_ROWS = 256
SHARE = 0.05
EULER = 0.5772156649015329
RANGE = 1 << 16
DIGITS = 9  # mean depths are compared without the last bits of their sums


def flag_anomalies(
    df,
    column,
    method="zscore",
    threshold=3.0,
    name="anomaly",
    seed=42,
    trees=TREES,
    tree_rows=TREE_ROWS,
):
    """Add a boolean column; text columns are never anomalous, NULL values neither.

    ``trees`` and ``tree_rows`` size the isolation forest: it is grown from at most
    ``trees * tree_rows`` drawn values and scores every row.
    """
    if not is_numeric(df, column):
        return df.withColumn(name, F.lit(False))
    if method == "iqr":
        flag = _outside_fence(df, column, threshold)
    elif method == "isolation_forest":
        return _isolation_forest(df, column, name, seed, trees, tree_rows)
    else:
        flag = _far_from_mean(df, column, threshold)
    return df.withColumn(name, F.coalesce(flag, F.lit(False)))


def _far_from_mean(df, column, threshold):
    value = F.col(column).cast("double")
    mean, std = df.agg(F.avg(value), F.stddev_samp(value)).first()
    if not std:
        return F.lit(False)
    return F.abs((value - F.lit(mean)) / F.lit(std)) > threshold


def _outside_fence(df, column, threshold):
    q1, q3 = quantile_values(df, [column], [0.25, 0.75])[column]
    if q1 is None:
        return F.lit(False)
    reach = threshold * (q3 - q1)
    return ~F.col(column).between(q1 - reach, q3 + reach)


def _isolation_forest(df, column, name, seed, trees, tree_rows):
    """Isolation forest over one column.

    At most trees * tree_rows sampled values are grown into trees. In one dimension
    a tree is a step function of the value, so the forest is a table of at most
    that many steps: small enough to ship to every task whatever the table's size.
    Every row is then scored by lookup, and the cut is the 5th percentile of the
    mean depths, counted from the value counts: the table is read once for the forest
    and once for its rows.
    """
    value = F.col(column).cast("double")
    counts = value_counts(df, [column])
    rows = counts.agg(F.sum("_c")).first()[0] or 0
    if not rows:
        return df.withColumn(name, F.lit(False))
    planted = _planted(_places(counts), rows, seed, trees, tree_rows)
    levels = int(np.ceil(np.log2(max(min(rows, tree_rows), 2))))
    steps = _steps(_grown(planted, seed, levels), trees)
    edges = steps.orderBy("at").collect()  # at most trees * tree_rows
    at = np.array([e["at"] for e in edges])
    depth = np.round(np.cumsum([e["gain"] for e in edges]), DIGITS)
    table = df.sparkSession.sparkContext.broadcast((at, depth))

    @F.pandas_udf("double")
    def path(v: pd.Series) -> pd.Series:
        edge, mean = table.value
        x = v.to_numpy()
        out = pd.Series(mean[np.clip(np.searchsorted(edge, x, "left") - 1, 0, None)])
        return out.where(~np.isnan(x))

    per_step = counts.groupBy(path(F.col("_v")).alias("path")).agg(F.sum("_c").alias("n"))
    cut = per_step.agg(F.percentile("path", F.lit(SHARE), F.col("n"))).first()[0]
    return df.withColumn(name, F.coalesce(path(value) < F.lit(cut), F.lit(False)))


def _places(counts):
    """v, c, first: how often each value occurs and its first place among all rows in order, from 0."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    parts = counts.groupBy("_part").agg(F.sum("_c").alias("_rows"))
    parts = parts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.coalesce(F.sum("_c").over(within), F.lit(0)))
    return placed.join(parts, "_part").select(
        F.col("_v").alias("v"), F.col("_c").alias("c"), (F.col("_base") + F.col("_before")).alias("first")
    )


def _hash(*parts):
    """Hex digits that depend on the parts alone."""
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary"))


def _unit(digits):
    """A number in [0, 1) from hex digits."""
    return F.conv(F.substring(digits, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _planted(places, rows, seed, trees, tree_rows):
    """tree, v: the values each tree grows from.

    A row's draw is a hash of its place in sorted order, so it does not depend on
    how the rows are laid out. The smallest draws are dealt out to the trees; where there
    are too few rows for that, every tree draws its own from all of them. Rows
    of one value are expanded range by range, spread over the tasks; twice as many as
    needed pass before the smallest are picked, so the pick is over a bounded number.
    """
    wanted = trees * tree_rows
    ranges = F.sequence(F.col("first"), F.col("first") + F.col("c") - 1, F.lit(RANGE))
    ranged = places.select("v", (F.col("first") + F.col("c")).alias("end"), F.explode(ranges).alias("start"))
    ranged = ranged.repartition("start")
    ends = F.least(F.col("start") + RANGE, F.col("end")) - 1
    drawn = ranged.select("v", F.explode(F.sequence("start", ends)).alias("place")).withColumn("r", _hash(F.lit(seed), F.col("place")))
    if rows < wanted:
        turn = Window.partitionBy("tree").orderBy(_hash(F.lit(seed), F.col("tree"), F.col("place")))
        every = drawn.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        return every.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= tree_rows).select("tree", "v")
    few = drawn.where(_unit(F.col("r")) < min(1.0, 2.0 * wanted / rows)).orderBy("r").limit(wanted)
    dealt = Window.partitionBy(F.lit(0)).orderBy("r")  # at most trees * tree_rows
    return few.select(F.floor((F.row_number().over(dealt) - 1) / tree_rows).cast("int").alias("tree"), "v")


def _grown(planted, seed, levels):
    """The values with the node each ends in: tree, v, node, low (what values there exceed), depth.

    All trees grow by one level at a time: a node's values are parted at a place
    between its smallest and its largest, drawn by a hash of tree and node, unless it
    holds one value only. Nodes are numbered as in a heap. Rows stay with their tree.
    """
    grown = planted.repartition("tree").withColumns({
        "node": F.lit(1), "low": F.lit(float("-inf")), "depth": F.lit(0)
    })
    node = Window.partitionBy("tree", "node")
    for _ in range(levels):
        least, most = F.min("v").over(node), F.max("v").over(node)
        grown = grown.withColumns({"_least": least, "_most": most})
        draw = _unit(_hash(F.lit(seed), F.lit("split"), F.col("tree"), F.col("node")))
        grown = grown.withColumn("_split", F.col("_least") + draw * (F.col("_most") - F.col("_least")))
        open_, above = F.col("_least") < F.col("_most"), F.col("v") > F.col("_split")
        grown = grown.select(
            "tree", "v",
            F.when(open_, F.col("node") * 2 + above.cast("int")).otherwise(F.col("node")).alias("node"),
            F.when(open_ & above, F.col("_split")).otherwise(F.col("low")).alias("low"),
            (F.col("depth") + open_.cast("int")).alias("depth"),
        )
    return grown


def _steps(grown, trees):
    """at, gain: the mean depth of all trees rises by gain for values above at."""
    n = F.count(F.lit(1))
    # The mean depth of an unsuccessful search among the values left in a leaf.
    left = F.when(n == 1, 0.0).when(n == 2, 1.0).otherwise(2 * (F.log(n - 1.0) + EULER) - 2 * (n - 1.0) / n)
    leaves = grown.groupBy("tree", "node").agg(F.max("low").alias("at"), (F.max("depth") + left).alias("d"))
    in_order = Window.partitionBy("tree").orderBy("at")
    gains = leaves.select("at", (F.col("d") - F.coalesce(F.lag("d").over(in_order), F.lit(0.0))).alias("gain"))
    return gains.groupBy("at").agg((F.sum("gain") / trees).alias("gain"))
