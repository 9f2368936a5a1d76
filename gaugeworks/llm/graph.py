"""Connected components of links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeworks.session import forget, settle


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every end of ``links`` (columns ``a``, ``b``); root is the least node.

    Each round takes the least root among neighbours and then the root's own root, so paths
    halve; it ends when a round changes nothing. Rounds are written to the shared folder, so a
    lost executor costs one round at most; only the last is left, which the caller may ``forget``.
    No links give no rows.
    """
    ends = settle(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links"
    )
    roots = settle(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "roots")
    while True:
        near = (
            ends.join(roots, ends["b"] == roots["node"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        lowered = roots.join(near, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = settle(
            lowered.join(above, "root").select("node", "old", F.least("root", "above").alias("root")),
            "roots",
        )
        forget(roots)
        roots = jumped.select("node", "root")
        roots.settled_path = jumped.settled_path
        if jumped.filter(F.col("old") != F.col("root")).isEmpty():
            forget(ends)
            return roots
