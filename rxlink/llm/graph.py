"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxlink.llm.common import written

PLAIN = 2


def components(links: DataFrame, name: str, u: str = "u", v: str = "v") -> DataFrame:
    """``(id, component)`` of every vertex of a link; component: its least vertex.

    Each round points every vertex at its least neighbour (or itself), follows
    the pointers twice, and contracts the links to the vertices pointed at,
    until none is left between two of them. Least by id in the first ``PLAIN``
    rounds, which settles stars and small groups; then by a hash that each round
    salts anew, so that the vertices of long chains, too, fall by a constant
    factor a round, whatever their ids. Every round is written, so a lost
    executor costs a task, and only rounds, not vertices, reach the driver.
    """
    left = links.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v")
    rounds: list[DataFrame] = []
    while True:
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        salt = len(rounds)
        rank = lambda c: F.col(c) if salt < PLAIN else F.xxhash64(F.lit(salt), F.col(c))  # noqa: E731, B023
        up = both.groupBy("u").agg(F.min_by("v", rank("v")).alias("v")).select("u", F.when(rank("v") < rank("u"), F.col("v")).otherwise(F.col("u")).alias("p"))
        up = written(up, f"{name}-near")
        for _ in range(2):
            far = up.select(F.col("u").alias("q"), F.col("p").alias("pp"))
            up = up.join(far, F.col("p") == F.col("q"), "left").select("u", F.coalesce("pp", "p").alias("p"))
        up = written(up, f"{name}-up")
        rounds.append(up)
        one, two = up.select(F.col("u").alias("a"), F.col("p").alias("pa")), up.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        left = left.join(one, F.col("u") == F.col("a")).join(two, F.col("v") == F.col("b"))
        left = written(left.filter("pa <> pb").select(F.col("pa").alias("u"), F.col("pb").alias("v")).distinct(), f"{name}-left")
        if left.isEmpty():
            break
    labels = rounds[0].select(F.col("u").alias("id"), F.col("p").alias("component"))
    for i, up in enumerate(rounds[1:], 2):
        far = up.select(F.col("u").alias("q"), F.col("p").alias("pp"))
        labels = labels.join(far, F.col("component") == F.col("q"), "left").select("id", F.coalesce("pp", "component").alias("component"))
        labels = written(labels, f"{name}-part") if i % 8 == 0 else labels  # keeps the plan short
    if len(rounds) > PLAIN:  # hashed rounds end at any vertex
        least = labels.groupBy("component").agg(F.min("id").alias("least"))
        labels = labels.join(least, "component").select("id", F.col("least").alias("component"))
    return written(labels, name)
