"""Connected components of a link table by repeated contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import remove, written


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, root)`` for every node that has a link.

    In each round every node hooks onto the neighbour (or itself) that comes first in a hashed order that
    changes by round, and links are rewritten to the hooks; a round at least halves what is left in expectation,
    so the rounds grow with the logarithm of the nodes, whatever the diameter. Both sides of each join are read from
    written tables, so that adaptive execution may split the partition of a much-linked node; a table goes as soon
    as the ones made of it are written. Self links and repeated links do no harm; an empty table gives an empty result.
    """
    spark = links.sparkSession
    links, held = written(links.where("a <> b").select("a", "b").distinct(), "links")
    roots, kept = links.select(F.col("a").alias("node"), F.col("b").alias("root")), ""
    turn = 0
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        rank = lambda c, t=turn: F.struct(F.xxhash64(c, F.lit(t)).alias("h"), c.alias("n"))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"))).alias("m"))
        hooks, hooked = written(hooks.select("node", F.least(F.col("m"), rank(F.col("node")))["n"].alias("hook")), "hooks")
        if turn:
            moved = roots.join(hooks.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("hook", "root").alias("root"))
            roots, path = written(moved, "roots")
            remove(spark, kept)
            kept = path
        else:
            roots, kept = hooks.withColumnRenamed("hook", "root"), hooked
        left = hooks.select(F.col("node").alias("a"), F.col("hook").alias("ha"))
        right = hooks.select(F.col("node").alias("b"), F.col("hook").alias("hb"))
        joined = links.join(left, "a").join(right, "b").where("ha <> hb")
        links, path = written(joined.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).distinct(), "links")
        remove(spark, held)
        if turn:
            remove(spark, hooked)
        held = path
        turn += 1
    return roots
