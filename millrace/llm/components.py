"""Connected components of a link table by alternating star contraction, as DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.stages import cut


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has a link.

    Large-star then small-star (Kiveris et al., 2014), until the table no longer changes; each round cuts its lineage
    to a table. Both stars first reduce to one minimum per node, an aggregate that combines on the map side, and links
    are never collected: a node of any degree is spread by the joins. The rounds end by themselves, as roots only fall; there
    are about as many as the logarithm of the longest chain. Links with a null end or to the node itself say nothing and
    are left out; an empty table gives an empty result.
    """
    pairs = links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()
    pairs, before = cut(pairs, "links"), None
    while True:
        # large star: larger neighbours of a node move to its smallest neighbour (itself included)
        both = pairs.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(pairs.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("root"))
        large = both.where("m > n").join(least, "n").select(F.col("root").alias("lo"), F.col("m").alias("hi")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of these
        least = large.groupBy("hi").agg(F.min("lo").alias("root"))
        small = large.join(least, "hi").select(F.col("root").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).where("lo < hi").distinct()
        pairs = cut(small, "links")
        # decimal sums of hashes don't overflow; equal twice in a row: nothing moved
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = tuple(now)
