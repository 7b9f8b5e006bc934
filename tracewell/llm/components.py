"""Connected components of a distributed edge table, by alternating large-star and small-star steps.

Up to LOCAL_EDGES edges, 8 MB, one task of an executor takes them all: the result is the same, and a round's shuffles
cost more than that. Beyond it every step is distributed. Rounds leave repeated edges in; their number never grows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.arrow import stash
from tracewell.session import discard, ship_package

LOCAL_EDGES = 500_000
LABELS = "node long, component long"


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v), sorted, and the smallest one that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _in_one_task(batches):
    rows = [x for x in batches if x.num_rows]
    if rows:
        nodes, least = least_reached(*(np.concatenate([x.column(k).to_numpy() for x in rows]) for k in range(2)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])


def _print_of(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """edges: u, v (long); parts: see stash(). Returns node, component: the smallest id that each node reaches; nodes are those of the edges.

    Each round writes its edges to the shared folder, so that a lost executor costs no more than a round. Hubs are
    handled by joins that can be split; no node's neighbours are gathered in one place.
    """
    now = stash(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges", parts)
    seen = _print_of(now)
    if seen[0] <= LOCAL_EDGES:
        ship_package(edges.sparkSession)
        return now.coalesce(1).mapInArrow(_in_one_task, LABELS)
    while seen[0]:
        # large star: each node sends its larger neighbours to its smallest one
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        # small star: each node links its smaller neighbours, and itself, to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        following = stash(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))), "edges")
        last, seen = seen, _print_of(following)
        discard(now)
        now = following
        if last == seen:
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct().unionByName(roots)
