"""Mixing sources to target weights."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quotecast.llm.tables import n_words, running, words, written

WEIGHTS = (5, 2, 1)
EPOCHS = 3
BIG = "decimal(38,0)"


def source_targets(sizes, weights=WEIGHTS, epochs=EPOCHS):
    """Target words of each source: source, source_size, target.

    Sources by code point, null last, take the weights in turn and share the total
    of all sizes by weight; a target stops at ``epochs`` times its source's size and
    the excess goes to the others by weight, until none is above. In order of
    limit / weight the stopped sources come first, so one pass of prefix sums over
    the sources finds the level of the rest.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    table = table.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long"))
    table = table.withColumn("limit", F.col("source_size") * epochs)
    order = Window.orderBy(F.col("limit").cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    level = table.select(
        "*",
        (F.sum("source_size").over(every) - F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("limit")).alias("rest"),
        (F.sum("weight").over(every) - F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("weight")).alias("weights"),
        F.row_number().over(order).alias("nth"),
    ).withColumn("open", F.col("limit").cast(BIG) * F.col("weights") > F.col("rest").cast(BIG) * F.col("weight"))
    first = F.min(F.when(F.col("open"), F.struct("nth", "rest", "weights"))).over(every)
    shared = F.col("first.rest").cast(BIG) * F.col("weight")
    return level.withColumn("first", first).select(
        "source",
        "source_size",
        F.when(F.col("nth") >= F.col("first.nth"), shared.cast("double") / F.col("first.weights").cast("double"))
        .otherwise(F.col("limit").cast("double")).alias("target"),
    )


def mix(docs, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, epochs=EPOCHS, seed="mix"):
    """How many words each row of docs gives: doc_id, text_key, source, size, source_size, target, taken.

    A source gives exactly floor(target) words: as many whole epochs as fit, then
    its rows in order of a hash of (seed, doc_id) until the rest is used up; the row
    at the cut gives a part. The order is a range sort over all tasks and the sums
    are prefix sums, so a source with most rows is split. Null text has size 0 and
    gives nothing; null ids, repeated ids and repeated rows take part like others
    (ties by size and text). The result depends on the rows alone, not their layout.
    """
    sizes = written(docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
    ))
    targets = source_targets(sizes, weights, epochs).withColumn("budget", F.floor("target").cast("long"))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ordered = running(sizes.withColumn("draw", draw), "source", ["draw", "doc_id", "size", "text_key"], "size", "before")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("budget") - whole * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    right = targets.withColumnRenamed("source", "_source")
    return ordered.join(right, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "text_key", "source", "size", "source_size", "target", (whole * F.col("size") + part).alias("taken")
    )


def mixed(docs, id_col="doc_id", text_col="text", source_col="source", **options):
    """The rows of docs, all columns, as the mix takes them: whole texts once for each
    epoch, and at a source's cut the first words of one text. Rows that give nothing go."""
    plan = written(
        mix(docs, id_col, text_col, source_col, **options)
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("source").alias("_source"))
        .agg(F.max("size").alias("_size"), F.sum("taken").alias("_taken"), F.count(F.lit(1)).alias("_rows"))
        .where("_taken > 0")
    )
    text, held = F.col(f"_doc.{text_col}"), docs.select(
        F.struct("*").alias("_doc"), F.col(id_col).alias("_i"), F.xxhash64(F.col(text_col)).alias("_k"), F.col(source_col).alias("_s"))
    found = held.join(plan, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")) & F.col("_s").eqNullSafe(F.col("_source")))
    if plan.where("_rows > 1").limit(1).count():  # rows repeated as a whole
        found = found.dropDuplicates(["_i", "_k", "_s"])
    copies = F.ceil(F.col("_taken") / F.col("_size")).cast("int")
    left = F.col("_taken") - (F.col("_copy") - 1) * F.col("_size")
    cut = F.when(left >= F.col("_size"), text).otherwise(F.array_join(F.slice(words(text), 1, left.cast("int")), " "))
    columns = [cut.alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns]
    return found.select("*", F.explode(F.sequence(F.lit(1), copies)).alias("_copy")).select(*columns)
