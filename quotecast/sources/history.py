"""Purchase history view over the star-schema tables."""

from pyspark.sql import functions as F

LEAD_SPAN = 54
LEAD_MIN = 7


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def history(spark, folder):
    """One row per order line: date, part, vendor, country, price, lead time, quantity."""
    lines = _joined(spark, folder)
    return lines.select(
        "date",
        "part_number",
        "vendor",
        "country",
        "price",
        (F.pmod("gap", F.lit(LEAD_SPAN)) + LEAD_MIN).cast("double").alias("lead_time"),
        "quantity",
    )


def dirty_history(spark, folder):
    """The same rows with missing and inflated prices and negative lead times."""
    lines = _joined(spark, folder)
    number = F.col("l_orderkey"), F.col("l_linenumber")
    missing = F.pmod(number[0] * 31 + number[1], F.lit(17)) == 0
    inflated = F.pmod(number[0] * 7 + number[1], F.lit(97)) == 0
    return lines.select(
        "date",
        "part_number",
        "vendor",
        "country",
        F.when(missing, None)
        .when(inflated, F.col("price") * 20)
        .otherwise(F.col("price"))
        .alias("price"),
        F.col("gap").cast("double").alias("lead_time"),
        "quantity",
    )


def _joined(spark, folder):
    line = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    supplier = table(spark, folder, "supplier")
    nation = table(spark, folder, "nation")
    ordered = F.col("o_orderdate").cast("date")
    # Plain tables joined one by one: each join sees the file size of its table, so
    # small dimensions are broadcast by Spark's own size check and lines stay put.
    return (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
        .select(
            "l_orderkey",
            "l_linenumber",
            ordered.alias("date"),
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("part_number"),
            F.col("s_name").alias("vendor"),
            F.col("n_name").alias("country"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.datediff(F.col("l_shipdate").cast("date"), ordered).alias("gap"),
            F.col("l_quantity").alias("quantity"),
        )
    )


def daily_events(spark, folder):
    """Events as a history-like table: date, event_type, value."""
    return table(spark, folder, "events").select(
        F.col("ts").cast("date").alias("date"), "event_type", "value"
    )
