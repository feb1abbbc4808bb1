"""Connected components of a link table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import Tables


def components(edges: DataFrame, tables: Tables, name: str, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``); the root is the least node.

    Each round takes the least label among the neighbours and then jumps to that label's own label,
    so chains halve.  Every round is written to the shared folder, which cuts lineage; what a round
    no longer needs is removed.  Nodes, labels and links stay distributed; only the count of changed
    labels reaches the driver.  Null ends are ignored; no link gives an empty table.
    """
    good = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = tables.put(f"{name}-links", good.unionByName(good.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = tables.put(f"{name}-0", both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    for i in range(1, most_rounds + 1):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("via"))
        above = labels.select(F.col("node").alias("via"), F.col("root").alias("jump"))
        new = stepped.join(above, "via").select("node", "old", F.least("via", "jump").alias("root"))
        written = tables.put(f"{name}-{i}", new)
        changed = written.where("old <> root").count()
        tables.drop(f"{name}-{i - 1}")
        labels = written.select("node", "root")
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    tables.drop(f"{name}-links")
    return labels
