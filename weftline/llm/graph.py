"""Connected components of a table of undirected links, by alternating large-star and small-star rounds.

Only aggregates with map-side combining and equi joins are used, so a hub with a third of all links is summed
before it is shuffled, and its join side can be split by adaptive execution. Each round is written to the shared
checkpoint folder, and the one before it dropped then. No link or component reaches the driver; it sees one count and one checksum a round, which
are observed while the round is written. A round reads its links by as few stages as it can: what many tasks
cost, in time and in the scheduler's records, doesn't follow from the rows in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop_folder, shared_folder, stored


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``links``; the root is the smallest node that can be reached.

    Links that hold a null, loops and repeats of a link are allowed and add nothing; no links give no rows.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
    spark = links.sparkSession
    at = shared_folder(spark)
    pairs = stored(pairs.where("x is not null and y is not null and u <> v").select("u", "v").distinct(), at)
    both_ways = lambda x, y: F.explode(F.array(F.struct(x.alias("u"), y.alias("v")), F.struct(y.alias("u"), x.alias("v")))).alias("e")
    seen = None
    for _ in range(rounds):
        # Large star: every node hands its larger neighbours to the least node around it.
        both = pairs.select(both_ways(F.col("u"), F.col("v"))).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: every node hands itself and its smaller neighbours to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("m", F.explode(F.array("u", "v")).alias("u")).where("u <> m").select("u", F.col("m").alias("v"))
        # Links that a round leaves as they are form stars, so two equal rounds end it.
        watch, before, at = Observation(), at, shared_folder(spark)
        pairs = stored(small.distinct().observe(watch, F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("sum")), at)
        drop_folder(spark, before)
        if watch.get == seen or not watch.get["n"]:
            break
        seen = watch.get
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
