"""Connected components of an edge table, by contraction.

In each round every node points to its least neighbour, or itself if it is less; pointers are followed until they
settle, and edges are drawn anew between the nodes that are pointed to. Edges inside a component vanish and
parallel ones become one, so the work shrinks from round to round: where labels are in random order, as hashes
are, by a constant factor at least. Groupings combine before they shuffle, and a hub's edges meet one row for
the hub in joins that Spark may split, so no node's edges need fit into one task. Once at most ``FEW`` edges are
live, a bounded number whatever the input, one task settles them: more rounds would cost stages, not work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, table

FEW = 1 << 17


def _settled(up: DataFrame) -> DataFrame:
    """Follow the pointers (node, root) until every one leads to a node that points to itself."""
    while True:
        over = up.select(F.col("node").alias("at"), F.col("root").alias("there"))
        jumped = table(up.join(over, up["root"] == over["at"]).select("node", F.col("there").alias("root"), (F.col("there") != F.col("root")).alias("moved")), "cc-jump")
        moved = jumped.where("moved").limit(1).count()
        discard(up)
        up = jumped
        if not moved:
            return up


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), and the least node that each is connected to."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _at_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(batches)
    if parts:
        live = pd.concat(parts)
        node, root = least_reachable(live["u"].to_numpy(), live["v"].to_numpy())
        yield pd.DataFrame({"node": node, "root": root})


def components(edges: DataFrame, a: str = "x", b: str = "y", few: int = FEW) -> DataFrame:
    """(node, root) for every node of the edges that has another at its end; root is the least node reachable."""
    ends = lambda u, v: (F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))
    live = table(edges.where(F.col(a) != F.col(b)).select(*ends(a, b)).distinct(), "cc-edges")
    rounds = []
    while n := live.count():
        if n <= few:
            kind = live.schema["u"].dataType.simpleString()
            rounds.append(table(live.coalesce(1).mapInPandas(_at_once, f"node {kind}, root {kind}"), "cc-up"))
            break
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = _settled(table(both.groupBy("u").agg(F.least(F.min("v"), "u").alias("root")).withColumnRenamed("u", "node"), "cc-up"))
        rounds.append(up)
        to = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"{c}r"))  # noqa: B023, E731
        drawn = live.join(to("u"), "u").join(to("v"), "v").where("ur <> vr").select(*ends("ur", "vr")).distinct()
        last, live = live, table(drawn, "cc-edges")
        discard(last)
    discard(live)
    if not rounds:
        return edges.sparkSession.createDataFrame([], live.toDF("node", "root").schema)
    out = rounds.pop()
    while rounds:
        up = rounds.pop()
        later = out.select(F.col("node").alias("at"), F.col("root").alias("there"))
        whole = table(up.join(later, up["root"] == later["at"], "left").select("node", F.coalesce("there", "root").alias("root")), "cc-whole")
        discard(up, out)
        out = whole
    return out.select("node", "root")
