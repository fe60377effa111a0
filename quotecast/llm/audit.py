"""Interaction of filters: what each removes, in every order, from counts per set of failed filters."""

from itertools import permutations
from math import factorial

from pyspark.sql import functions as F

from quotecast.llm.tables import written

DOCS_PER_BLOCK = 4
SPOTS = 4  # counters of a block's 64 that a text adds one to
BROADCAST_KEYS = 500_000
SALTS = 16


def _cells(key):
    """Columns: the counters of its block that a key adds to."""
    h = F.xxhash64(F.lit("cells"), key)
    return [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int") for i in range(SPOTS)]


def possible_repeats(rows, key):
    """rows with a column ``possible``: whether the key may stand in another row.

    A blocked counting Bloom filter: every row adds one to a few of the 64 counters
    of its key's block. Each task sums its own counters first; sums merge by block and
    counter. A key with a counter of one is in one row for sure. The filter has a
    block for every ``DOCS_PER_BLOCK`` rows, so its errors (under one in a hundred) do
    not grow with the table, and it stays a table that is joined by block, in
    ``SALTS`` copies so that the rows of a frequent key meet it in as many places.
    ``rows`` are read twice and best written before.
    """
    n_blocks = max(1, -(-rows.count() // DOCS_PER_BLOCK))
    placed = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n_blocks)))
    cells = F.explode(F.array_distinct(F.array(*_cells(F.col(key))))).alias("cell")
    counters = placed.select("_block", cells).groupBy("_block", "cell").agg(F.count(F.lit(1)).alias("n"))
    shared = counters.where("n > 1").groupBy("_block").agg(F.bit_or(F.expr("shiftleft(1L, cell)")).alias("_shared"))
    shared = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = placed.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    tested = salted.withColumn("_cells", F.array(*_cells(F.col(key)))).join(shared, ["_block", "_salt"], "left")
    every = F.forall("_cells", lambda c: F.getbit(F.coalesce("_shared", F.lit(0).cast("long")), c) == 1)
    return tested.withColumn("possible", every).drop("_block", "_salt", "_shared", "_cells")


def least_ids(docs, keys, id_col, text_col):
    """key, least (smallest id, null ones apart) of every text whose key is among ``keys``.

    Only these texts move: grouped by the whole text, combined map-side. The keys are
    broadcast up to ``BROADCAST_KEYS`` rows; beyond, the tables are joined by key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.select(F.sha2(text.cast("binary"), 256).alias("key"), F.col(id_col).alias("id"), text.alias("text"))
    few = keys.count() <= BROADCAST_KEYS
    texts = held.join(F.broadcast(keys) if few else keys, "key", "left_semi")
    return texts.groupBy("key", "text").agg(F.min("id").alias("least")).select("key", "least")


def mask_counts(docs, filters, labels=None, id_col="doc_id", text_col="text", part_col="source"):
    """part, mask, good, toxic, n: rows per set of failed filters.

    Bit i of the mask stands for the i-th of ``filters`` (boolean columns over docs,
    true where a row fails; null counts as false), the bit after them for repeats: texts
    identical to that of a smaller id. Null texts count as empty; null parts as the empty
    string; null ids come after all others, so they are repeats where any id has their text. Rows
    with one id and text are no repeats of each other. ``labels`` (doc_id, quality, toxic) says
    which ids are good (a quality of 1 in any row) and toxic (likewise).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters)), F.lit(0))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        mask.alias("mask"), F.sha2(text.cast("binary"), 256).alias("key"))
    if labels is None:
        rows = rows.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    else:
        told = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
            F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
        none = F.lit(False)
        rows = rows.join(told, "id", "left").withColumns({"good": F.coalesce("good", none), "toxic": F.coalesce("toxic", none)})
    tested = written(possible_repeats(written(rows), "key"))
    group = ["part", "mask", "good", "toxic"]
    clear = tested.where("not possible").groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    maybe = tested.where("possible")
    least = least_ids(docs, written(maybe.select("key").distinct()), id_col, text_col)
    per_id = maybe.groupBy("key", *group, "id").agg(F.count(F.lit(1)).alias("n"))
    per_text = per_id.groupBy("key", *group).agg(
        F.sum("n").alias("n"), F.min("id").alias("own"), F.min_by("n", "id").alias("n_own"))
    stay = F.when(F.col("least").isNull(), F.col("n")).when(F.col("own") == F.col("least"), F.col("n_own")).otherwise(0)
    split = per_text.join(least, "key").withColumn("stay", stay).select("part", "good", "toxic", F.explode(F.array(
        F.struct("mask", F.col("stay").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << len(filters))).alias("mask"), (F.col("n") - F.col("stay")).alias("n")),
    )).alias("x")).select("part", "x.mask", "good", "toxic", "x.n")
    return clear.unionByName(split).groupBy(*group).agg(F.sum("n").alias("n")).where("n > 0")


def audit(docs, filters, labels=None, repeat="E", id_col="doc_id", text_col="text", part_col="source"):
    """What each filter removes in every order: a row for each part, filter_order and step.

    ``filters``: letter -> boolean column over docs, true where a row fails; ``repeat`` is the
    letter of one more filter, for texts identical to that of a smaller id (see
    ``mask_counts``, also for nulls and repeated rows). Counts are long and stand for the
    filter of the step: kept (rows left after it), removed (by it), redundant (failing
    it, removed before), unique_fails (failing it alone), good_lost and toxic_lost (removed, with that label),
    shapley (removed by it, summed over all orders). A part is a value of ``part_col``;
    no rows: no parts.

    Rows are counted once, per set of failed filters; orders and steps need
    only those counts, as sets of masks are disjoint and add up.
    """
    letters = [*filters, repeat]
    if len(letters) > 6 or any(len(x) != 1 for x in letters):
        raise ValueError("at most six filters, named by one letter each")
    size = 1 << len(letters)
    counts = mask_counts(docs, list(filters.values()), labels, id_col, text_col, part_col)

    def by_mask(keep):
        return F.array(*(F.coalesce(F.sum(F.when((F.col("mask") == m) & keep, F.col("n"))), F.lit(0)) for m in range(size)))

    parts = counts.groupBy("part").agg(
        by_mask(F.lit(True)).alias("n"), by_mask(F.col("good")).alias("g"), by_mask(F.col("toxic")).alias("t"))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    told, before = F.col("filter_order"), F.col("step") - 1
    bits = {x: F.lit(1 << i) for i, x in enumerate(letters)}
    steps = steps.select(
        "*",
        sum((F.when(F.instr(told, x) <= before, b).otherwise(0) for x, b in bits.items()), F.lit(0)).alias("prior"),
        sum((F.when(F.instr(told, x) == F.col("step"), b).otherwise(0) for x, b in bits.items()), F.lit(0)).alias("own"),
    )
    prior, own, zero = F.col("prior"), F.col("own"), F.lit(0).cast("long")

    def total(values, test):
        return F.aggregate(F.filter(values, lambda _, m: test(m)), zero, lambda a, x: a + x)

    def gone(m):
        return (m.bitwiseAND(prior) == 0) & (m.bitwiseAND(own) != 0)

    weight = F.array(*(F.lit(factorial(len(letters)) // max(1, m.bit_count())).cast("long") for m in range(size)))
    fair = F.zip_with("n", weight, lambda n, w: n * w)
    return steps.select(
        "part", "filter_order", "step",
        total(F.col("n"), lambda m: m.bitwiseAND(prior.bitwiseOR(own)) == 0).alias("kept"),
        total(F.col("n"), gone).alias("removed"),
        total(F.col("n"), lambda m: (m.bitwiseAND(prior) != 0) & (m.bitwiseAND(own) != 0)).alias("redundant"),
        F.get("n", own).alias("unique_fails"),
        total(F.col("g"), gone).alias("good_lost"),
        total(F.col("t"), gone).alias("toxic_lost"),
        total(fair, lambda m: m.bitwiseAND(own) != 0).alias("shapley"),
    )
