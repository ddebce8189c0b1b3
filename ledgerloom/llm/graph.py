"""Connected components of accepted links, and the pairs within them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.tables import checkpoint


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (the smallest node of it) of every node of `links` (a, b).

    Each round hands every node the smallest label among its neighbours and then the label of that label,
    so that the length of chains halves. Nothing but a count of changes comes to the driver; each round is
    written to the checkpoint folder, so that a lost executor costs one round at most.
    """
    both = checkpoint(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        closer = labels.join(near, labels.node == near.a).select("node", "component", F.least("component", "near").alias("closer"))
        hops = closer.select(F.col("node").alias("closer"), F.col("closer").alias("hop"))
        moved = checkpoint(closer.join(hops, "closer", "left").select("node", F.least("closer", "hop").alias("new"), "component"))
        changed = moved.filter("new != component").limit(1).count()
        labels = moved.select("node", F.col("new").alias("component"))
        if not changed:
            return labels
    raise RuntimeError(f"no fixed point after {rounds} rounds")


#: Members of a block that are compared in one go; larger blocks are cut into tiles.
TILE = 500


def block_pairs(members: DataFrame, tile: int = TILE) -> DataFrame:
    """Each pair (a, b), a < b, of different ids that share a block of `members` (id, block).

    A block of more than `tile` members is cut into tiles by a hash of the id, and each pair of tiles is a join key
    of its own, so that no task gets more than `tile` times `tile` pairs of a block however large it is.
    """
    members = members.select("id", "block").distinct()
    sizes = members.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("tiles"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("block", "tiles")
    own = members.join(sizes, "block").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    low = own.select("block", F.col("tile").alias("low"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("high"), F.col("id").alias("x"))
    high = own.select("block", F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("low"), F.col("tile").alias("high"), F.col("id").alias("y"))
    pairs = low.join(high, ["block", "low", "high"]).filter((F.col("low") < F.col("high")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def pairs_within(members: DataFrame, group: str, text: str, left: str, right: str) -> DataFrame:
    """Each pair of different texts of a group, the smaller one (by UTF-8 bytes) first."""
    one = members.select(group, F.col(text).alias(left)).distinct()
    other = one.select(group, F.col(left).alias(right))
    return one.join(other, group).filter(F.col(left) < F.col(right)).select(left, right).distinct()
