"""Hierarchies from (node, parent) links: closure, problems, and proofs that children add up to their parent.

The closure doubles its reach each round (what is above what is above), so its rounds grow with the logarithm of the
depth, not with the depth, and links of any number are joined, not collected. Each round's pairs are written to the
shared folder. Cycles end too: pairs are distinct, and a round without new ones is the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.operators import checks as K
from stockflow.sources.files import work_dir


def _kept(df: DataFrame, spark: SparkSession) -> DataFrame:
    out = work_dir(spark, "closure")
    df.write.parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def closure(links: DataFrame) -> DataFrame:
    """node, ancestor, distance (the shortest, from 1 on) of all nodes above each node of ``links`` (node, parent; a root's parent is NULL). On a cycle a node is above itself."""
    spark = links.sparkSession
    pairs = _kept(links.where("node IS NOT NULL AND parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance")).distinct(), spark)
    n = pairs.count()
    while True:
        far = pairs.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above"), F.col("distance").alias("more"))
        reached = pairs.join(far, "ancestor").select("node", F.col("above").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        pairs = _kept(pairs.unionByName(reached).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")), spark)
        before, n = n, pairs.count()
        if n == before:
            return pairs


def levels(links: DataFrame) -> DataFrame:
    """node, parent, level (0 for roots; NULL on and below a cycle, and below an orphan) of each node."""
    above = closure(links)
    nodes = links.select("node", "parent").where("node IS NOT NULL").distinct()
    roots = nodes.where("parent IS NULL").select("node")
    to_root = above.join(roots.withColumnRenamed("node", "ancestor"), "ancestor").groupBy("node").agg(F.max("distance").alias("level"))
    own = roots.select("node", F.lit(0).cast("long").alias("level"))
    round_ = above.where("node = ancestor").select(F.col("node").alias("_on")).distinct()
    below = above.join(round_, F.col("ancestor") == F.col("_on")).select("node").distinct().withColumn("_cyclic", F.lit(True))
    found = nodes.join(to_root.unionByName(own), "node", "left").join(below, "node", "left")
    return found.select("node", "parent", F.when(F.col("_cyclic").isNull(), F.col("level")).alias("level"))


def membership(codes: DataFrame, links: DataFrame) -> DataFrame:
    """code, node: each code in its own node (``codes`` has code, node) and in all nodes above, once however many ways lead there."""
    above = closure(links).select("node", "ancestor")
    up = codes.join(above, "node").select("code", F.col("ancestor").alias("node"))
    return codes.select("code", "node").unionByName(up).distinct()


def problems(links: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """node, problem: nodes on a cycle, orphans (a parent that is no node), nodes with two parents, links listed twice, and codes' nodes that are none (of ``codes``)."""
    nodes = links.where("node IS NOT NULL").select("node").distinct()
    said = lambda df, why: df.select("node", F.lit(why).alias("problem"))
    cycle = closure(links).where("node = ancestor")
    lost = links.where("parent IS NOT NULL").select("node", "parent").distinct().join(nodes.withColumnRenamed("node", "parent"), "parent", "left_anti")
    per = links.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"), F.size(F.collect_set(F.coalesce("parent", F.lit("")))).alias("parents"))
    out = said(cycle, "cycle").unionByName(said(lost, "orphan")).unionByName(said(per.where("parents > 1"), "two parents")).unionByName(said(per.where("n > parents"), "listed twice"))
    return out if codes is None else out.unionByName(said(codes.select("node").distinct().join(nodes, "node", "left_anti"), "no such node"))


def partition(counts: DataFrame, links: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """keys, node, level, measure, value, summed: parents whose children's rows of ``counts`` (keys, node, measures) do not add up to theirs, missing rows being 0. Each level is proved by the one below it."""
    tree = levels(links)
    parents = tree.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    whole = counts.join(parents, "node")
    parts = counts.join(tree.where("parent IS NOT NULL").select("node", "parent"), "node").drop("node").withColumnRenamed("parent", "node")
    wrong = K.sums(whole.select(*keys, "node", *measures), parts.select(*keys, "node", *measures), [*keys, "node"], measures)
    return wrong.join(tree.select("node", "level").distinct(), "node").select(*keys, "node", "level", "measure", "value", "summed")
