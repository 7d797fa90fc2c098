"""Connected components of a link table, by repeated joins; no link ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline.session import cut_lineage


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root): where the pointers (node, up), which never lead to a larger node, end."""
    while True:
        above = parents.select(F.col("node").alias("up"), F.col("up").alias("beyond"))
        longer = cut_lineage(parents.join(above, "up", "left").select(
            "node", F.coalesce("beyond", "up").alias("to"), (F.coalesce("beyond", "up") < F.col("up")).alias("moved")))
        parents = longer.select("node", F.col("to").alias("up"))
        if longer.where("moved").isEmpty():
            return parents.withColumnRenamed("up", "root")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b); comp is the smallest node of its component.

    Every node points to the smallest among itself and its neighbours, and the links are contracted
    to links between what their ends point to. Most links, as those of a star, contract to nothing
    at once; from the second round on pointers are doubled until they end, so long chains take few
    rounds as well. A link is joined about once, whatever the number of rounds. Self links, repeated
    links and both directions are allowed; null ends are ignored; no links give no rows. Each step
    is stored, which keeps plans short and survives lost executors.
    """
    whole = links.where("a is not null and b is not null")
    alone = whole.where("a = b").select(F.col("a").alias("node")).distinct()
    edges = cut_lineage(whole.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).limit(0)
    first = True
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        roots = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up")))
        roots = roots.withColumnRenamed("up", "root") if first else _roots(roots)
        of_a, of_b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"to_{x}")) for x in "ab")
        contracted = edges.join(of_a, "a").join(of_b, "b").where("to_a <> to_b")
        edges = cut_lineage(contracted.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        if first:
            labels, first = roots.withColumnRenamed("root", "comp"), False
        else:
            labels = cut_lineage(labels.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select(
                "node", F.coalesce("root", "comp").alias("comp")))
    return labels.unionByName(
        alone.join(labels, "node", "left_anti").withColumn("comp", F.col("node")))
