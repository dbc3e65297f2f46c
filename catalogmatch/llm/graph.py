"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmatch.llm.common import hub_join, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link to another node; the component is its smallest node.

    Alternating star contraction: every larger end of a link moves to the smallest neighbour of the smaller end, then all
    smaller neighbours of a node gather at the smallest of them, until nothing moves. Links of a node to itself and
    repeated links change nothing; without links the result is empty.
    """
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    now = written(links.where(F.col(a) != F.col(b)).select(hi, lo).distinct(), "links")
    state = None
    while True:
        stamp = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if stamp == state or not stamp[0]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        state = stamp
        least = now.select(F.col("hi").alias("lo"), F.col("lo").alias("m")).groupBy("lo").agg(F.min("m").alias("m"))
        moved = hub_join(now, least, "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct()
        now = written(moved, "links-large")
        least = now.groupBy("hi").agg(F.min("lo").alias("m"))
        both = hub_join(now, least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("x"))
        now = written(both.select("x.*").where("hi <> lo").distinct(), "links-small")
