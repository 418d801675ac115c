"""Connected components of large edge tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the session's shared folder, so that a lost executor costs nothing twice."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))  # one machine, as in tests
    return df.checkpoint()


def spread_join(rows: DataFrame, table: DataFrame, key: str, share: int = 20_000) -> DataFrame:
    """rows joined with table, which has one row for each key and the number `n` of its rows.

    A key of more than 1 / share of all rows is joined by broadcast, so that its rows stay where they are; there are at
    most `share` such keys. rows and table should be cut, for they are read twice.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * share > total + 1000 * share
    if table.where(hot).limit(1).count() == 0:
        return rows.join(table.drop("n"), key)
    crowds = table.where(hot).drop("n")
    return rows.join(F.broadcast(crowds), key).unionByName(rows.join(F.broadcast(crowds.select(key)), key, "left_anti").join(table.where(~hot).drop("n"), key))


def checked_join(rows: DataFrame, keys: DataFrame, on: list[str], how: str, most: int = 1_000_000) -> DataFrame:
    """rows joined with keys, by broadcast where keys has `most` rows at the most, else by a shuffle. keys should be cut."""
    return rows.join(F.broadcast(keys) if keys.count() <= most else keys, on, how)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b), root being the least node of its component.

    Alternates large-star and small-star steps: each keeps one edge for each
    neighbour at most, so a hub of any size is a group whose minimum is taken by
    partial aggregation and joined back by spread_join(), never gathered in a list or a task.
    The number of steps grows with the logarithm of the longest path. No edges give no rows, without a step.
    """
    edges = cut(edges.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct())
    for _ in range(most if edges.limit(1).count() else 0):
        both = edges.union(edges.selectExpr("b", "a"))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.when(F.col("b") > F.col("a"), 1)).alias("n")))
        large = cut(spread_join(both.where("b > a"), least, "a").selectExpr("m a", "b").where("a <> b").distinct())
        # small star: from each node its neighbours below it, and itself, go to the least of them
        low = cut(large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n")))
        small = spread_join(large, low, "b").selectExpr("m a", "a b").where("a <> b").union(low.selectExpr("m a", "b")).distinct()
        small = cut(small)
        # done once no node is both a root and a child, and each child has one root
        state = small.groupBy("b").agg(F.count("*").alias("n"))
        open_ = state.where("n > 1").select("b").union(small.select("a").distinct().join(state.select(F.col("b").alias("a")), "a", "left_semi")).limit(1).count()
        edges = small
        if not open_:
            break
    else:
        if edges.limit(1).count():
            raise RuntimeError("components need more steps than allowed")
    return edges.selectExpr("b node", "a root").union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
