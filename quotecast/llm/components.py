"""Connected components by alternating large-star and small-star."""

from pyspark.sql import functions as F

from quotecast.llm.tables import written


def _large_star(edges):
    """Link every larger neighbour of a node to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges):
    """Link a node and its smaller neighbours to the smallest of them. Edges run from large to small."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    inner = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges):
    """(node, component) for every node of edges (u, v), which are longs; the component is its smallest node.

    Both stars only aggregate and join per node, so a hub's links are split like
    any skewed join. Each round is a table in the shared folder; rounds end when
    neither star changes a link, after about the logarithm of the longest path.
    """
    def state(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    low, high = F.least("u", "v"), F.greatest("u", "v")
    edges = written(edges.where("u <> v").select(high.alias("u"), low.alias("v")).distinct())
    now = state(edges)
    while now[0]:
        edges = written(_small_star(_large_star(edges).distinct()).distinct())
        before, now = now, state(edges)
        if now == before:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
