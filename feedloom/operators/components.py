"""Connected components of a graph held as a DataFrame of edges, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.runtime import release, stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the smallest node it is connected to.

    Alternates the large-star and small-star steps until the edges form stars; the number of rounds grows with the
    logarithm of the graph's size, and they go on until nothing changes. Each round's edges are written to the shared
    folder and the round before is removed, so lineage stays short and a lost executor costs one round. A node of any degree is handled by aggregates that combine on the map side; no
    neighbourhood is collected. Null nodes and self-loops are left out; an empty table yields no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    e = stage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        old, e = e, stage(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        release(old)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))").alias("s")).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct()).distinct()
