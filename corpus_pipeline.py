"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the
columns of documents (the last: the packed pieces). ``run`` writes every stage's
result as Parquet into the shared folder and reads it back for the next one.
"""

import public_tokenizers
from pyspark.sql import functions as F

from quotecast.llm.exact import drop_exact_copies
from quotecast.llm.minhash import drop_near_copies
from quotecast.llm.mixing import mixed
from quotecast.llm.packing import pieces
from quotecast.llm.quality import keep_good
from quotecast.llm.tables import written


def quality(spark, docs, sf_dir):
    """Documents inside the quality fences of their language and source."""
    return keep_good(docs)


def exact(spark, docs, sf_dir):
    """One of each group of documents that are equal but for white space."""
    return drop_exact_copies(docs)


def near(spark, docs, sf_dir):
    """One of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return drop_near_copies(docs, size=5, share=80)


def mixing(spark, docs, sf_dir):
    """Sources at their target weights: documents as often as the mix takes them."""
    return mixed(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def packing(spark, docs, sf_dir):
    """Pieces of token sequences, each in its place in a training window."""
    packed = pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("mixing", mixing),
    ("packing", packing),
]

# Tokenizing and differencing are no SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
