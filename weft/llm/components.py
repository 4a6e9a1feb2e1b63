"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import released, ship, stored


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links: each node with the least node it reaches there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 1 << 16):
        part = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(map(root, part), pa.int64())], ["node", "root"])


#: Links that one task contracts.
LINKS_A_TASK = 200_000


def components(links: DataFrame, links_a_task: int = LINKS_A_TASK) -> DataFrame:
    """node, label for each node of the links (columns a and b): one label for each component.

    Each task contracts a bounded number of links to stars; a node with several roots links
    these, and the next round works on roots alone, of which there are fewer each
    time. The labels of the rounds are then put one after another. So few links that
    one task takes them need one round.
    """
    spark = links.sparkSession
    ship(spark)
    edges, rounds = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), []
    while True:
        parts = max(1, -(-edges.count() // links_a_task))
        stars = stored(edges.repartition(parts).mapInArrow(released(_forest), "node long, root long"), "stars")
        if parts == 1:
            rounds.append(stars.withColumnRenamed("root", "label"))
            break
        least = stars.groupBy("node").agg(F.min("root").alias("label"), F.max("root").alias("most"))
        rounds.append(stored(least.select("node", "label"), "labels"))
        unsettled = least.filter("label <> most").select("node", "label")
        edges = stored(stars.join(unsettled, "node").filter("root <> label").select(F.col("root").alias("a"), F.col("label").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            break
    labels = rounds[0]
    for more in rounds[1:]:
        after = more.select(F.col("node").alias("_from"), F.col("label").alias("_to"))
        labels = labels.join(after, F.col("label") == F.col("_from"), "left").select("node", F.coalesce("_to", "label").alias("label"))
    return stored(labels, "components") if len(rounds) > 1 else labels
