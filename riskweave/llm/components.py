"""Connected components by min-label spreading with pointer jumping, over written tables; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a long, b long): node, label (the smallest node of its component) for every node of an edge.

    Each round every node takes the smallest label among its neighbours and then its label's label, so that rounds grow
    with the logarithm of a component's diameter.  Null ends and loops are dropped; no edges give no rows.
    """
    made = Tables(edges.sparkSession)
    edges = edges.where("a is not null and b is not null and a <> b")
    both = made.write(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "component-edges")
    labels = made.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "component-labels")
    for k in range(max_rounds):
        # hooking: the least label next to the node, offered to the node and to its present label
        offers = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(offers, labels.node == offers.a).select("node", "label", F.least("label", "near").alias("best"))
        up = hooked.where("best < label").groupBy(F.col("label").alias("root")).agg(F.min("best").alias("to"))
        mine = hooked.join(up, hooked.node == up.root, "left").select("node", "label", F.least("best", F.coalesce("to", "best")).alias("best"))
        mine = made.write(mine, f"component-hooked-{k}")
        parent = mine.select(F.col("node").alias("p"), F.col("best").alias("pp"))
        jumped = mine.join(parent, mine.best == parent.p, "left").select("node", F.least("best", F.coalesce("pp", "best")).alias("next"), "label")
        jumped = made.write(jumped, f"component-labels-{k}")
        made.drop(f"component-hooked-{k}", f"component-labels-{k - 1}" if k else "component-labels")
        changed = jumped.where("next < label").limit(1).count()
        labels = jumped.select("node", F.col("next").alias("label"))
        if not changed:
            made.drop("component-edges")
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
