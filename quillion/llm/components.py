"""Connected components of a graph of links, as a DataFrame that is never collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.llm.cluster import checkpointed

#: Links up to this number are joined by one executor task: for 128-bit names 32 MB of ends, and as much again for numbers and order. More
#: take rounds over the whole cluster, with the same result; rounds over few links would cost only their fixed price.
ONE_TASK = 1 << 20


def least_reached(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the smallest that it reaches by the links x - y."""
    low = np.arange(n)
    while True:
        a, b = low[x], low[y]
        if np.array_equal(a, b):
            return low
        # Each root joins the smallest root that a link of its tree leads to; paths are then cut short.
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := low[low], low):
            low = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links of the task; nodes are numbered in their order, so that the smallest is the root."""
    ends: list[list[pa.Array]] = [[], []]
    for b in batches:
        b = b.filter(pc.and_(b.column(0).is_valid(), b.column(1).is_valid()))
        for k in (0, 1):
            ends[k].append(b.column(k))
    links = sum(map(len, ends[0]))
    if not links:
        return
    coded = pa.concat_arrays(ends[0] + ends[1]).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    at = rank[coded.indices.to_numpy()]
    nodes = coded.dictionary.take(order)
    roots = nodes.take(pa.array(least_reached(len(nodes), at[:links], at[links:])))
    for start in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([nodes.slice(start, 1 << 16), roots.slice(start, 1 << 16)], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; ``root`` is the smallest node that it reaches.

    Alternating large-star and small-star steps: each node links its larger
    neighbours, then its smaller ones, to the smallest of them, until stars are
    left. A step is a groupBy whose minimum is combined before the shuffle, so
    a node of many links is not gathered. Null ends are ignored; loops and
    repeated links change nothing. Few links (ONE_TASK) need no rounds. ``edges``
    is read several times and should be checkpointed.
    """
    kind = edges.schema[a].dataType
    if edges.count() <= ONE_TASK:
        return edges.select(a, b).coalesce(1).mapInArrow(_forest, T.StructType([T.StructField("node", kind), T.StructField("root", kind)]))
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = pair.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = checkpointed(pair.where("u <> v").distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = checkpointed(small)
        if new.count() == links.count() and new.join(links, ["u", "v"], "left_anti").isEmpty():
            break
        links = new
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
