"""Connected components of a table of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxtable.llm.stored import stored


def roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the same for connected nodes and one of them.

    Every round hooks each label on the least label it is linked with, follows the hooks to their ends and rewrites the
    links with the new labels, so the links shrink at least as fast as components merge. Only counts reach the driver.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "edges")
    labels = stored(edges.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while not edges.isEmpty():
        hooks = stored(edges.groupBy("hi").agg(F.min("lo").alias("to")), "hooks")
        while True:
            further = hooks.select(F.col("hi").alias("to"), F.col("to").alias("beyond"))
            jumped = stored(hooks.join(further, "to", "left").select("hi", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("hi", "to")
            if jumped.where("moved").isEmpty():
                break
        labels = stored(labels.join(hooks, labels["root"] == hooks["hi"], "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        a, b = hooks.select(F.col("hi"), F.col("to").alias("new_hi")), hooks.select(F.col("hi").alias("lo"), F.col("to").alias("new_lo"))
        renamed = edges.join(a, "hi", "left").join(b, "lo", "left").select(F.coalesce("new_hi", "hi").alias("x"), F.coalesce("new_lo", "lo").alias("y"))
        edges = stored(renamed.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "edges")
    return labels
