"""Connected components of links, by hooking and contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsmith.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the root is the smallest node of the component.

    In each round every node hooks to its smallest neighbour; chains of hooks are
    followed by doubling, and the links between roots go to the next round. Rounds
    and doublings grow with the logarithm of the component's size, and the links shrink.
    """
    found = None
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root"))
        hook = stored(hook, "hooks")
        while True:
            up = hook.select(F.col("node").alias("_at"), F.col("root").alias("_up"))
            hook = stored(hook.join(up, hook["root"] == up["_at"]).select("node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("moved")), "hooks")
            moved = hook.where("moved").limit(1).count()
            hook = hook.select("node", "root")
            if not moved:
                break
        if found is None:
            found = hook
        else:  # nodes of earlier rounds move with their roots
            up = hook.select(F.col("node").alias("_at"), F.col("root").alias("_up"))
            found = stored(found.join(up, found["root"] == up["_at"], "left").select("node", F.coalesce("_up", "root").alias("root")), "roots")
        of = lambda c: hook.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"root_{c}"))  # noqa: B023, E731
        links = links.join(of("a"), F.col("a") == F.col("_a")).join(of("b"), F.col("b") == F.col("_b"))
        links = stored(links.where("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "links")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
