"""Connected components by contraction, all on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import inner_tables, stored

PER_FILE = 1_000_000


def rooted(hooks: DataFrame, files: int) -> DataFrame:
    """``node, hook`` with every hook followed to its root. A node never hooks to a larger one, so
    hooks make trees, and following them twice as far each time takes the logarithm of their depth.
    Only nodes that have not reached their root yet go on."""
    settled, pending = None, hooks
    while True:
        every = pending if settled is None else settled.unionByName(pending)
        second = every.select(F.col("node").alias("hook"), F.col("hook").alias("top"))
        moved = (F.col("hook") != F.col("top")).alias("moved")
        jumped = pending.join(second, "hook").select("node", F.col("top").alias("hook"), moved)
        jumped = stored(jumped.coalesce(files), ["moved"])
        done = jumped.where(~F.col("moved")).select("node", "hook")
        settled = done if settled is None else settled.unionByName(done)
        pending = jumped.where("moved").select("node", "hook")
        if not pending.limit(1).count():
            return settled


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``a, b``; a component's name is its
    smallest node.

    Each round every node hooks to its smallest neighbour, hooks are followed to their roots, links
    move to the roots, and links inside one tree go; a chain of rising nodes is one tree. Nothing is
    collected but how many links are left, and tables are written in as many files as that asks for
    (``PER_FILE`` links each); those of the rounds go at the end.
    """
    with inner_tables(links.sparkSession) as keep:
        a, b = F.col("a"), F.col("b")
        links = stored(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
        found, left = None, links.count()
        files = 1 + left // PER_FILE
        while found is None or left:
            both = links.unionByName(links.select(b.alias("a"), a.alias("b")))
            hooks = both.groupBy("a").agg(F.least(a, F.min("b")).alias("hook"))
            hooks = rooted(stored(hooks.withColumnRenamed("a", "node").coalesce(files)), files)
            moved = links
            for end in ("a", "b"):
                moved = moved.join(hooks.select(F.col("node").alias(end), F.col("hook").alias(f"to_{end}")), end)
            links = stored(
                moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
                .where("a < b")
                .distinct()
                .coalesce(files)
            )
            left = links.count()
            if found is None:
                found = hooks.select("node", F.col("hook").alias("component"))
            else:
                step = hooks.select(F.col("node").alias("component"), "hook")
                found = found.join(step, "component", "left")
                found = found.select("node", F.coalesce("hook", "component").alias("component"))
            found = keep(found.coalesce(files))
        return found
