"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.tables import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (node, other), ids of any type with an order: root is the smallest node of its component.

    Alternates the public large-star and small-star steps until nothing changes. Each round is a written table, and the
    one before it is removed. Hot centres are combined before the shuffle (min) and split by Spark in the join. Loops
    (node = other) and null ends add nothing; repeated edges count once; no edges, no rows.
    """
    e = materialize(edges.filter(F.col("node") != F.col("other")).select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        last, e = e, materialize(small, "edges")
        discard(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
