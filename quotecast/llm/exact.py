"""Exact dedup by deterministic block naming."""

from pyspark.sql import functions as F

from quotecast.llm.tables import SPACES, numbered, written

BLOCK = 1024


def squeezed(text):
    """Column: the text without white space; empty for null."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def identities(docs, id_col="doc_id", text_col="text", block=BLOCK):
    """One row per row of docs with the name of its normalised text.

    The text without white space is cut into blocks of ``block`` characters. All
    blocks are sorted and named by their place; then the names of adjacent pairs
    are sorted and named, again and again, until one name is left per document.
    Names are places among sorted contents, never hashes, so two documents share
    (n_blocks, name) exactly if their normalised texts are equal.

    Columns: row (unique), doc_id, text_key (hash of the original text, to find the
    row again), chars (code points of the original text), sha256 (of the normalised
    text, binary), n_blocks, name. Null text counts as empty, which is one empty
    block. The text crosses the network once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_key"),
        F.char_length(text).alias("chars"),
        squeezed(F.col(text_col)).alias("body"),
    ).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.char_length("body") / block)).cast("int"))
    first = F.col("idx") == 0
    blocks = cut.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("idx")
    ).select(
        "row",
        "idx",
        "n_blocks",
        F.when(first, F.col("doc_id")).alias("doc_id"),
        F.when(first, F.col("text_key")).alias("text_key"),
        F.when(first, F.col("chars")).alias("chars"),
        F.when(first, F.unhex(F.sha2(F.col("body").cast("binary"), 256))).alias("sha256"),
        F.substring("body", F.col("idx") * block + 1, F.lit(block)).alias("block"),
    ).withColumn("sum", F.xxhash64("block"))
    names = written(numbered(blocks, ["block"], ["row", "idx"], "name", lead="sum"))
    most = names.agg(F.max("n_blocks")).first()[0] or 1
    level = names.where("n_blocks > 1").select("row", "idx", "n_blocks", "name")
    done = None
    while most > 1:
        half, odd = (F.col("idx") / 2).cast("int"), F.col("idx") % 2 == 1
        pairs = level.groupBy("row", half.alias("idx"), "n_blocks").agg(
            F.max(F.when(~odd, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(0)).alias("right"),
        )
        level = numbered(
            pairs.select("row", "idx", F.ceil(F.col("n_blocks") / 2).cast("int").alias("n_blocks"), "left", "right"),
            ["left", "right"], ["row", "idx"], "name",
        )
        ended = level.where("n_blocks = 1").select("row", F.col("name").alias("last_name"))
        done = ended if done is None else done.unionByName(ended)
        level = level.where("n_blocks > 1")
        most = -(-most // 2)
    heads = names.where("idx = 0").drop("idx")
    if done is None:
        return heads
    return (
        heads.join(done, "row", "left")
        .withColumn("name", F.coalesce("last_name", "name"))
        .drop("last_name")
    )


def exact_groups(docs, id_col="doc_id", text_col="text", block=BLOCK):
    """One row per row of docs: its group of equal texts and whether it stays.

    Of equal texts (see ``identities``) the one with the most code points in the
    original stays, then the smallest doc_id (null last), then the first row; so
    exactly one row of each group stays, also among repeated rows. Columns:
    doc_id, text_key, keep_id, group_size, kept, sha256.
    """
    named = written(identities(docs, id_col, text_col, block))
    rank = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("row"))
    groups = named.groupBy("n_blocks", "name").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("best"))
    return named.join(groups, ["n_blocks", "name"]).select(
        "doc_id",
        "text_key",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "sha256",
    )


def drop_exact_copies(docs, id_col="doc_id", text_col="text", block=BLOCK):
    """The rows of docs, all columns, without exact copies; empty texts are copies of each other."""
    groups = written(exact_groups(docs, id_col, text_col, block))
    kept = groups.where("kept").select("doc_id", "text_key")
    return matching(docs, kept, rows_repeat(groups), id_col, text_col)


def rows_repeat(table):
    """Whether some (doc_id, text_key) stands in a table more than once."""
    return table.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count() > 0


def matching(docs, keys, repeat, id_col="doc_id", text_col="text", loose=None):
    """The rows of docs whose (id, hash of text) is among keys, one for each where rows ``repeat``.

    Of rows equal in both the one whose other columns are least (as JSON) stays. Rows
    for which the column ``loose`` is true all stay. Input columns travel in one struct, so
    their names cannot clash.
    """
    own = F.lit(-1).cast("long") if loose is None else F.when(loose, F.monotonically_increasing_id()).otherwise(-1)
    held = docs.select(
        F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_key"), own.alias("_own")
    )
    found = held.join(
        keys.select(F.col("doc_id").alias("_k_id"), F.col("text_key").alias("_k_key")),
        F.col("_id").eqNullSafe(F.col("_k_id")) & (F.col("_key") == F.col("_k_key")),
        "left_semi",
    )
    if repeat:
        found = found.groupBy("_id", "_key", "_own").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc"))
    return found.select("_doc.*")
