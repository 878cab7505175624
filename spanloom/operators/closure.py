"""Closures over edges of any origin, in two ways with equal results.

``grouped`` takes each image's edges and seeds to one task, which suits any number of images of moderate
size.  ``looped`` extends a frontier by joins, for images too large for one task; each round is cut by a
reliable checkpoint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.graph import csr
from spanloom.runtime import cut, ship


def _reach(edges: pa.Table, seeds: pa.Table, forward: bool) -> pa.Table:
    image = (edges if edges.num_rows else seeds).column("image_id")[0].as_py()
    a, b = (edges.column(c).to_numpy() for c in (("src", "dst") if forward else ("dst", "src")))
    s = seeds.column("addr").to_numpy()
    nodes, index = np.unique(np.concatenate([a, b, s]), return_inverse=True)
    first, near = csr(len(nodes), index[: len(a)], index[len(a) : 2 * len(a)])
    found = np.zeros(len(nodes), bool)
    now = np.unique(index[2 * len(a) :])
    found[now] = True
    while len(now):
        n = first[now + 1] - first[now]
        at = np.repeat(first[now] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        now = np.unique(near[at][~found[near[at]]])
        found[now] = True
    addr = nodes[found]
    return pa.table({"image_id": pa.array([image] * len(addr), pa.int64()), "addr": pa.array(addr, pa.int64())})


def grouped(edge: DataFrame, seeds: DataFrame, forward: bool) -> DataFrame:
    """(image_id, addr): seeds and all they reach (forward), or that reaches them."""
    ship(edge.sparkSession)
    left = edge.select("image_id", "src", "dst").groupBy("image_id")
    # Named anew, as seeds often come from the same tables as edges.
    right = seeds.select(F.col("image_id").alias("image_id"), F.col("addr").alias("addr")).groupBy("image_id")
    return left.cogroup(right).applyInArrow(lambda e, s: _reach(e, s, forward), "image_id long, addr long")


def looped(edge: DataFrame, seeds: DataFrame, forward: bool) -> DataFrame:
    a, b = ("src", "dst") if forward else ("dst", "src")
    step = cut(edge.select("image_id", F.col(a).alias("addr"), F.col(b).alias("to")).distinct())
    found = frontier = cut(seeds.select("image_id", "addr").distinct())
    while not frontier.isEmpty():
        reached = frontier.join(step, ["image_id", "addr"]).select("image_id", F.col("to").alias("addr")).distinct()
        frontier = cut(reached.join(found, ["image_id", "addr"], "left_anti"))
        found = cut(found.unionByName(frontier))
    return found


def trim(superset, how=grouped):
    """Removes whatever can run into a mark, by either way of closing."""
    from .superset import Superset

    seeds = superset.bad.join(superset.vertex, ["image_id", "addr"], "left_semi")
    after: Superset = superset.remove(how(superset.edge, seeds, False))
    return after.clear_all_bad()
