"""Connected components by repeated contraction.

Each round, every vertex points to its smallest neighbour (or itself), two
pointer jumps shorten the trees, and edges are rewritten to the vertices pointed
at. A round merges every vertex that is no local minimum, so few rounds are
needed even for chains. All rounds are joins and partial aggregates; nothing is
collected, and each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each end of ``edges`` (columns a, b); label: smallest reachable node.

    Self-loops, repeated edges, either direction and null ends are allowed; null ends are ignored.
    """
    live = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while not live.isEmpty():
        ends = live.select(F.explode(F.array(F.struct(F.col("b").alias("v"), F.col("a").alias("p")), F.struct(F.col("a").alias("v"), F.col("a").alias("p")))).alias("e")).select("e.*")
        point = stored(ends.groupBy("v").agg(F.min("p").alias("p")), "pointers")
        for _ in range(2):
            up = point.select(F.col("v").alias("p"), F.col("p").alias("q"))
            point = point.join(up, "p").select("v", F.col("q").alias("p"))
        point = stored(point, "pointers")
        move = point.where("v <> p")
        if labels is None:
            labels = point.select(F.col("v").alias("node"), F.col("p").alias("label"))
        else:
            labels = labels.join(move.withColumnRenamed("v", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
        labels = stored(labels, "labels")
        to = move.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        live = live.join(to, "a", "left").select(F.coalesce("pa", "a").alias("a"), "b")
        live = live.join(to.select(F.col("a").alias("b"), F.col("pa").alias("pb")), "b", "left").select("a", F.coalesce("pb", "b").alias("b"))
        live = stored(live.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0) if labels is None else labels
