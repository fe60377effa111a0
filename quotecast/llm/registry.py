"""Queries of this subpackage and their SQL."""

from pyspark.sql import functions as F

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a function (spark, folder) -> DataFrame under a name."""

    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def hex_lower(binary):
    return F.lower(F.hex(binary))
