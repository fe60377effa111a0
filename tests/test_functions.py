import numpy as np
import pytest
from pyspark.sql import functions as F

from quotecast.functions import lineage, ordered, quantiles
from quotecast.functions.chain import chain_fit, violation
from quotecast.operators import explore

PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


@pytest.fixture
def skewed(spark):
    """One key holds most rows, many values repeat, some are missing."""
    rng = np.random.default_rng(5)
    hot = np.concatenate([rng.lognormal(3, 2, 6000), np.repeat(7.5, 3000), -rng.random(500)])
    rows = [("hot", float(x), float(i % 7)) for i, x in enumerate(hot)]
    rows += [(f"k{i % 9}", float(x), None) for i, x in enumerate(rng.normal(size=300))]
    rows += [("hot", None, 1.0), ("one", 4.0, None), (None, 2.0, 3.0), (None, 6.0, 3.0)]
    return spark.createDataFrame(rows, "k string, a double, b double").repartition(8)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_equal_exact_percentile(spark, skewed, keys):
    group = [*keys, "column"]
    long = skewed.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in ("a", "b")
    ])))
    exact = long.where("v is not null").groupBy(*group).agg(
        F.count("v").alias("n"), F.percentile("v", PROBS).alias("q")
    )
    want = {tuple(r[k] for k in group): (r.n, r.q) for r in exact.collect()}
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "40", usual):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found = quantiles.exact_quantiles(skewed, ["a", "b"], PROBS, keys)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", usual)
        got = {tuple(r[k] for k in group): (r.n, r.q) for r in found.collect()}
        assert got.keys() == want.keys()
        for k, (n, q) in want.items():
            assert got[k][0] == n
            assert got[k][1] == pytest.approx(q, rel=1e-12)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_moments_equal_plain_aggregates(spark, skewed, keys):
    """Also for values far from zero, single values, and groups without any."""
    rows = skewed.unionByName(spark.range(3).select(F.lit("none").alias("k"), F.lit(None).cast("double").alias("a"), F.lit(float("nan")).alias("b")))
    rows = rows.withColumn("b", F.col("b") + 1e9)
    found = quantiles.exact_quantiles(rows, ["a", "b"], [0.5], keys, moments=True)
    got = {tuple(r[k] for k in [*keys, "column"]): r for r in found.collect()}
    for c in ("a", "b"):
        v = F.when(~F.isnan(c), F.col(c))
        plain = rows.groupBy(*keys).agg(F.count(v), F.min(v), F.max(v), F.avg(v), F.stddev_samp(v))
        for *key, n, least, most, mean, std in plain.collect():
            row = got.pop((*key, c))
            assert (row["n"], row["min"], row["max"]) == (n, least, most)
            assert row["mean"] == (None if mean is None else pytest.approx(mean, rel=1e-12))
            assert row["std"] == (None if std is None else pytest.approx(std, rel=1e-7, abs=1e-9))
    assert not got


def test_weighted_counts(spark):
    df = spark.createDataFrame([("x", 1.0, 2), ("x", 5.0, 1), ("y", None, 4), ("x", 1.0, 1)], "k string, v double, w int")
    got = {r.k: r for r in quantiles.exact_quantiles(df, ["v"], [0.5], ["k"], moments=True, weight="w").collect()}
    assert (got["x"]["n"], got["x"]["mean"], got["x"]["q"]) == (4, 2.0, [1.0])
    assert (got["y"]["n"], got["y"]["mean"], got["y"]["q"]) == (0, None, None)


def test_quantiles_match_numpy(skewed):
    values = [r["a"] for r in skewed.where("a is not null").select("a").collect()]
    found = quantiles.quantile_values(skewed, ["a"], PROBS)["a"]
    assert found == pytest.approx(list(np.quantile(values, PROBS)))


def test_quantiles_of_infinite_values(spark):
    def of(*values):
        df = spark.createDataFrame([(v,) for v in values], "a double")
        return quantiles.quantile_values(df, ["a"], [0.0, 0.25, 0.5, 0.75, 1.0])["a"]

    inf = float("inf")
    assert of(-inf, 1.0, 2.0) == [-inf, -inf, 1.0, 1.5, 2.0]
    assert of(1.0, 2.0, inf) == [1.0, 1.5, 2.0, inf, inf]
    assert of(-inf, inf) == [-inf, None, None, None, inf]
    assert of(inf, inf, None, float("nan")) == [inf] * 5
    assert of(None) == [None] * 5


def test_no_part_holds_a_hot_group(spark):
    """The rows of one group spread over the parts, however many there are."""
    table = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").cast("double").alias("a"))
    parts = {}
    for n in ("8", "64"):
        usual = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            counts = quantiles.value_counts(table, ["a"], ["k"])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", usual)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        parts[n] = counts.groupBy("_part").count().agg(F.max("count")).first()[0]
    assert parts["8"] < 5_000 and parts["64"] < 1_000


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_chunked_order_equals_one_window(skewed, keys):
    table = skewed.withColumn("o", F.xxhash64("k", "a", "b")).withColumn(
        "v", F.when(F.pmod("o", F.lit(3)) == 0, F.col("a"))
    )
    args = (keys, ["o", "a", "b"], "v")
    columns = ["k", "o", "a", "b", "_pos", "_lag", "_back", "_ahead"]

    def rows(bounded):
        found = ordered.neighbours(table, *args, bounded=bounded).select(*columns)
        return sorted(map(str, found.collect()))

    assert rows(False) == rows(True)


@pytest.mark.parametrize("parts, batch", [(1, 3), (2, 10_000), (13, 2), (40, 1), (13, 7)])
def test_scans_meet_over_batches_and_tasks(spark, parts, batch):
    """Long gaps, keys over many tasks, several columns and types, repeated rows: as one window per key."""
    rng = np.random.default_rng(parts * 31 + batch)
    rows = []
    for i in range(400):
        k = None if i % 50 == 0 else f"k{int(rng.integers(0, 4)) if i % 3 else 0}"
        rows.append((k, int(rng.integers(0, 90)), float(i) if rng.random() < 0.15 else None, f"s{i}" if rng.random() < 0.3 else None))
    rows += [("hot", 1, 2.0, None)] * 150 + [("none", i, None, None) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, o int, a double, b string").repartition(3)
    usual = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keys in ([], ["k"]):
            order = ["o"] if keys else ["k", "o"]
            got = ordered.near_rows(df, keys, order, ["a", "b"])
            for c in "ab":
                shown = ["k", "o", "a", "b", "_pos"]
                near = [F.col("_near")[c][x].alias(f"_{x}") for x in ("back", "ahead", "lag")]
                want = ordered.neighbours(df, keys, [*order, "a", "b"], c, bounded=True)
                want = want.select(*shown, "_back", "_ahead", "_lag")
                assert sorted(map(str, got.select(*shown, *near).collect())) == sorted(map(str, want.collect()))
    finally:
        for c, v in usual.items():
            spark.conf.set(c, v)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _best(v, low, up, lo, hi, cost):
    """Brute force over an integer grid."""
    grid = np.arange(lo, hi + 1)
    total = {x: cost(x - v[0]) for x in grid}
    for y, l, u in zip(v[1:], low, up):
        total = {
            x: cost(x - y) + min(
                (c for p, c in total.items() if l <= x - p <= u), default=np.inf
            )
            for x in grid
        }
    return min(total.values())


def _limits(rng, n):
    low = [float(rng.choice([-np.inf, 0, -1, -3])) for _ in range(n - 1)]
    up = [float(rng.choice([np.inf, 0, 1, 3])) for _ in range(n - 1)]
    return low, up


def _feasible(x, low, up, lo, hi):
    steps = np.diff(x)
    inside = all(lo - 1e-9 <= a <= hi + 1e-9 for a in x)
    return inside and all(l - 1e-9 <= s <= u + 1e-9 for s, l, u in zip(steps, low, up))


@pytest.fixture(scope="module")
def chains(spark):
    """Random small problems: rules around zero, rules off zero, walls; and both fits of each."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(500):
        n = int(rng.integers(1, 7))
        v = rng.integers(-4, 14, n).astype(float)
        low, up = _limits(rng, n)
        if i % 5 == 0:  # a step must rise or fall
            shift = rng.integers(-1, 2, n - 1)
            low, up = [a + int(s) for a, s in zip(low, shift)], [b + int(s) for b, s in zip(up, shift)]
        rows.append((i, v.tolist(), [float(a) for a in low], [float(b) for b in up]))
    df = spark.createDataFrame(rows, "i int, v array<double>, low array<double>, up array<double>")
    args = [F.col("v"), F.col("low"), F.col("up"), F.lit(0.0), F.lit(9.0)]
    fits = {o: chain_fit(o, *args) for o in ("l1", "l2")}
    missed = {f"{o}_missed": violation(F.col(o), F.col("low"), F.col("up"), F.lit(0.0), F.lit(9.0)) for o in fits}
    return df.withColumns(fits).withColumns(missed).collect()


@pytest.mark.parametrize("objective, cost", [("l1", np.abs), ("l2", np.square)])
def test_chain_fits_are_optimal(chains, objective, cost):
    rng = np.random.default_rng(2)
    solved = 0
    for r in chains:
        v, low, up, n = np.array(r.v), r.low, r.up, len(r.v)
        want = _best(v, low, up, 0, 9, cost)
        missed = r[f"{objective}_missed"]
        if want == np.inf:  # limits are whole numbers, so nothing else fits either
            assert missed is None or np.isnan(missed) or missed > 0.1
            continue
        solved += 1
        x = np.array(r[objective])
        assert _feasible(x, low, up, 0, 9), r
        assert missed < 1e-9
        found = cost(x - v).sum()
        if objective == "l1":
            assert found == pytest.approx(want)
            continue
        assert found <= want + 1e-9
        # No feasible small move improves it.
        for _ in range(40):
            other = x + rng.normal(scale=0.05, size=n)
            if _feasible(other, low, up, 0, 9):
                assert ((other - v) ** 2).sum() >= found - 1e-9
        if n < 4:
            assert found <= ((_projected(v, low, up) - v) ** 2).sum() + 1e-6
    assert solved > 400


def test_violation_is_seen(spark):
    one = F.array(F.lit(1.0))
    x = F.array(*(F.lit(a) for a in (0.0, 5.0, 4.0)))
    limits = F.array(F.lit(-9.0), F.lit(-9.0)), F.concat(one, one)
    got = spark.range(1).select(violation(x, *limits, F.lit(0.5), F.lit(9.0)), violation(x, *limits, F.lit(-1.0), F.lit(2.0))).first()
    assert tuple(got) == (4.0, 4.0)


def _projected(v, low, up):
    """Alternating projections (Dykstra) with corrections onto each step and the bounds."""
    n = len(v)
    x, notes = v.copy(), np.zeros((n, n))
    for _ in range(1000):
        for i in range(n):
            y = x + notes[i]
            z = y.copy()
            if i == n - 1:
                z = np.clip(y, 0, 9)
            else:
                gap = np.clip(y[i + 1] - y[i], low[i], up[i]) - (y[i + 1] - y[i])
                z[i], z[i + 1] = y[i] - gap / 2, y[i + 1] + gap / 2
            notes[i], x = y - z, z
    return x


def test_constant_input_is_kept(spark):
    v, low, up = (F.array_repeat(F.lit(x), n) for x, n in ((5.0, 6), (-1.0, 5), (0.0, 5)))
    fits = [chain_fit(o, v, low, up, F.lit(0.0), F.lit(9.0)) for o in ("l1", "l2")]
    assert all(list(x) == [5.0] * 6 for x in spark.range(1).select(*fits).first())


def test_part_stays_bounded_and_statistics_move_few_rows(spark):
    """Parts do not grow with the table, and moments and quantiles move parts, not all counts."""
    table = spark.range(20_000).select(F.col("id").cast("double").alias("a"))
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        counts = quantiles.lay_out(quantiles.value_counts(table, ["a"], missing=True).drop("_part"), ["column", "_v"], 6)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert counts.groupBy("_part").count().agg(F.max("count")).first()[0] <= 64
    found = quantiles.counted_statistics(counts, [0.5])
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    row = found.first()
    assert (row["n"], row["min"], row["max"], row["mean"], row["q"]) == (20_000, 0.0, 19_999.0, 9_999.5, [9_999.5])
    assert row["std"] == pytest.approx(np.std(np.arange(20_000.0), ddof=1))


def test_checkpoint_keeps_columns_apart(spark):
    """A reader of one column reads that column; what Parquet cannot hold is kept too."""
    df = spark.range(5).select("id", F.lit("x").alias("s"))
    kept = lineage.checkpoint(df)
    assert kept.schema.names == ["id", "s"] and kept.select("id").inputFiles()
    odd = df.select("id", F.lit(None).alias("none"), F.col("s").alias("ID2")).withColumn("c", F.expr("make_interval(0, 1)"))
    assert lineage.checkpoint(odd).count() == 5


def test_rolled_up_counts_equal_each_set(spark):
    """Values shared by keys, over many parts, in every set of groups."""
    rows = spark.range(6_000).select(
        F.concat(F.lit("g"), F.col("id") % 3).alias("g"),
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("h"), F.col("id") % 17)).alias("h"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 901 / 3).alias("v"))
    got = {(r["group"], r["key"]): r for r in explore.stats_by_each(rows, "v", ["g", "h"]).collect()}
    for name, by in (("all", F.lit("")), ("g", F.col("g")), ("h", F.col("h"))):
        want = rows.where(by.isNotNull()).groupBy(by.alias("k")).agg(
            F.count("v"), F.min("v"), F.max("v"), F.avg("v"), F.stddev_samp("v"), F.median("v"))
        for k, n, *numbers in want.collect():
            row = got.pop((name, k))
            assert row["count"] == n
            assert [row[x] for x in ("min", "max", "mean", "std", "median")] == pytest.approx(numbers, rel=1e-9)
    assert not got
