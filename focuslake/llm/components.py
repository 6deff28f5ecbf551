"""Connected components by contraction, and groups read in order by a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def stored(df: DataFrame, path: str) -> DataFrame:
    """Written to a folder that all executors see and read again, which cuts the lineage."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) for edges (a, b): ``root`` is one node of the component, null edges are ignored.

    Each round moves every node to the least of its neighbours and itself and replaces the edges by
    those between the new places. Nodes should be hashes: for labels in random order a round leaves a
    fixed share of the nodes, so the number of rounds is logarithmic. Nothing is kept on the driver.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null").distinct()
    edges, moves, k = stored(edges, f"{folder}/edges-0"), [], 0
    first = edges
    while not edges.where("a <> b").isEmpty():
        both = edges.union(edges.select("b", "a"))
        to = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        to = stored(to.select("node", F.least("node", "low").alias("to")), f"{folder}/moves-{k}")
        moves.append(to)
        k += 1
        moved = edges.join(to.toDF("a", "x"), "a").join(to.toDF("b", "y"), "b").where("x <> y")
        edges = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
                       f"{folder}/edges-{k}")
    if not moves:
        return first.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    place = moves[0].toDF("node", "root")
    for to in moves[1:]:
        place = place.join(to.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return place


def runs(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.Table]:
    """Tables of rows with one value of an int64 column, from batches sorted by it. One group is held."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.asarray(b.column(column))
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(column)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        begin = 0
        for c in cuts:
            yield pa.Table.from_batches([*held, b.slice(begin, c - begin)])
            held, begin = [], int(c)
        held.append(b.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each node's component, for edges inside one task."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            break
    return root
