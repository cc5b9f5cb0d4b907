"""Connected components of a link table, by alternating star contractions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.session import settle


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction of links (a, b) with a > b.

    The large star hooks every larger neighbour of a node to the smallest node near
    it, the small star every smaller one. A node's smallest neighbour is a minimum
    that is combined before the shuffle; a node with many links is then one key of an
    ordinary join, which splits a heavy key.
    """
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        hooked = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("low"))
        hooked = links.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select("a", F.col("low").alias("b")))
    return hooked.filter(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with a link; ``links`` has columns a and b.

    The component is its smallest node. Loops and repeated links are allowed. Each
    round's links are written to the shared folder, so a lost executor costs one round.
    """
    current = settle(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter(F.col("a") > F.col("b")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        # A sum of hashes tells whether the links are the same as before.
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        mark = now
        current = settle(_star(_star(current, True), False), "links")
    raise RuntimeError(f"links still change after {rounds} rounds")
