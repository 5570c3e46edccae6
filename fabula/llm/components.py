"""Connected components of a table of links, by contraction with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm.common import materialize, release, shuffle_partitions

#: Links a task handles: a small table of links runs in a few tasks, whatever the session's number of partitions.
TASK_LINKS = 50_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every end of ``links`` (a, b); the root is the smallest node of the component.

    Each round points every node to the smallest of its neighbours and itself, follows the pointers to their ends (their
    length halves with each join) and contracts the links to those ends, which at least halves the nodes that have links.
    A round is a few joins on node; nothing is gathered on the driver but counts.
    """
    edges = links.select("a", "b").where(F.col("a") != F.col("b"))
    most = shuffle_partitions(links.sparkSession)
    roots, first_tasks = None, 1
    while True:
        tasks = min(most, 1 + edges.count() // TASK_LINKS)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        parent = materialize(near.select("node", F.least("node", "low").alias("root")).coalesce(tasks), "parents")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            parent = materialize(parent.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")).coalesce(tasks), "parents")
            moved = parent.where("moved").limit(1).count()
            parent = parent.select("node", "root")
            if not moved:
                break
        if roots is None:
            roots, first_tasks = parent, tasks
        else:
            onward = parent.select(F.col("node").alias("root"), F.col("root").alias("end"))
            roots = materialize(roots.join(onward, "root", "left").select("node", F.coalesce("end", "root").alias("root")).coalesce(first_tasks), "roots")
        ends = parent.select(F.col("node").alias("a"), F.col("root").alias("to_a"))
        other = parent.select(F.col("node").alias("b"), F.col("root").alias("to_b"))
        edges = edges.join(ends, "a").join(other, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where(F.col("a") != F.col("b")).distinct()
        edges = materialize(edges.coalesce(tasks), "links")
        release(links.sparkSession)
        if not edges.limit(1).count():
            return roots
