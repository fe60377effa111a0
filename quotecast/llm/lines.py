"""Removal of runs of lines that occur earlier, by prefix doubling."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotecast.llm.tables import SPACES, n_words, numbered

RUN = 3
RUN_WORDS = 50


def _lines_needed(i, run, words):
    """Column: the lines from place i on that have ``words`` words together, at most ``run``."""
    least = F.lit(run)
    if words is not None:
        for n in range(run - 1, 0, -1):  # null, so not enough, beyond the text's end
            total = reduce(lambda a, b: a + b, (F.get("sizes", i + k) for k in range(n)))
            least = F.when(total >= words, n).otherwise(least)
    return least.cast("int")


def _later(ranks, size):
    """Places of the runs of ``size`` lines whose name has an earlier place."""
    start = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("i").alias("i"))
    intervals = ranks.groupBy("rank").agg(F.min(start).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    again = ranks.join(intervals, "rank").where(~start.eqNullSafe(F.col("first")))
    return again.select("doc_id", "key", "i", F.lit(size).alias("size"))


def line_dedup(docs, id_col="doc_id", text_col="text", run=RUN, words=None, whole=False):
    """A row for each row of docs: doc_id, n_lines, removed (places of removed lines, from 0),
    kept_lines.

    Lines are the parts of a text between newlines that hold a word; others are no
    part of any run and are left out. A line goes if it lies in a run of ``run``
    lines that also starts earlier: in a smaller doc_id (null last) or earlier in the same text.
    With ``words`` a shorter run that starts earlier counts too if it has so many words, and
    with ``whole`` one that is all lines of its text and of an earlier text.

    Suffixes of every text's line sequence are ranked by prefix doubling: lines are
    sorted and named by their place, then pairs of names 1, 2, 4, ... lines apart,
    until a name stands for ``run`` lines; each round is a range sort over all tasks
    (``numbered``). Suffixes with one name are an interval of the suffix array with a
    common prefix of ``run`` lines or more. Its first suffix stays, the runs of the others
    go; overlapping runs of a text make its maximal repeated runs. Shorter runs are judged
    the same way in the rounds before, which then go up by single lines. Null and blank
    texts have no lines. Rows repeated with id and text are one document reported as
    often; different texts under one id are ordered by a hash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    told = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    held = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), told.alias("lines"))
    place, more = ["doc_id", "key", "i"], []
    lines = held.select("doc_id", "key", F.posexplode("lines").alias("i", "line"))
    if words is not None or whole:
        # need: how many lines the run from here needs to count; n: lines of the text
        more = ["need", "n"]
        sized = held.withColumn("sizes", F.transform("lines", n_words) if words is not None else F.lit(None).cast("array<long>"))
        told = F.transform("lines", lambda x, i: F.struct(x.alias("line"), _lines_needed(i, run, words).alias("need")))
        lines = sized.select("doc_id", "key", F.size("lines").alias("n"), F.posexplode(told).alias("i", "at"))
        lines = lines.select(*place, "at.line", "at.need", "n")
    lines = lines.withColumn("sum", F.xxhash64("line"))
    ranks, depth = numbered(lines, ["line"], place, "rank", lead="sum"), 1
    in_text = Window.partitionBy("doc_id", "key").orderBy("i")
    later = []
    while depth < run:
        if words is not None:  # runs with one name have one number of words, so all of them are here
            later.append(_later(ranks.where(F.col("need") <= depth), depth))
        if whole:
            later.append(_later(ranks.where((F.col("i") == 0) & (F.col("n") == depth)), depth))
        step = 1 if more else min(depth, run - depth)
        # repeated rows hold the same places twice; ranks of one place are equal
        once = ranks.dropDuplicates(place)
        pairs = once.select(*place, *more, "rank", F.lead("rank", step).over(in_text).alias("next")).where("next is not null")
        ranks, depth = numbered(pairs, ["rank", "next"], place, "rank"), depth + step
    later.append(_later(ranks, run))
    gone = (
        reduce(DataFrame.unionByName, later).groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
        .agg(F.collect_set(F.struct("i", "size")).alias("runs"))
        .withColumn("removed", F.array_sort(F.array_distinct(F.flatten(F.transform(
            "runs", lambda r: F.sequence(r["i"], r["i"] + r["size"] - 1))))))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    none = F.array().cast("array<int>")
    left = held.join(gone, same, "left").select("doc_id", "lines", F.coalesce("removed", none).alias("removed"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    kept = F.when(F.size("removed") == 0, F.col("lines")).otherwise(F.transform(places, lambda i: F.get("lines", i)))
    return left.select("doc_id", F.size("lines").cast("long").alias("n_lines"), "removed", kept.alias("kept_lines"))
