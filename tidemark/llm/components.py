"""Connected components of a table of links, by contraction in chunks and rounds of one exchange each.

A round first contracts the links of each chunk of a task to stars around the chunk's least members. It then groups
them by node: of the smaller nodes that a node is linked with, the least becomes its own and that of the others, and
where that one has a smaller node itself, the link goes there at once. All of this keeps what is connected and lowers
the links, until every node is linked with the least of its component and with nothing else.

What a node collects is one node per chunk at the most; that a node is the least of others is a flag, so a component's
centre is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, side

#: Rounds grow with the logarithm of a component's diameter; this bound is far beyond any that occurs.
MAX_ROUNDS = 60
#: Links that are contracted together.
CHUNK = 200_000


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some links, but for the least of its component there, with that least one."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least, new = np.minimum(label[a], label[b]), label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def _contracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0

    def flush() -> pd.DataFrame:
        u, v = contract(np.concatenate([f["u"] for f in held]), np.concatenate([f["v"] for f in held]))
        return pd.DataFrame({"u": u, "v": v})

    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= CHUNK:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id in ``links`` (a, b) that is not the smallest of its component."""
    edges, old = links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v"), None
    for _ in range(MAX_ROUNDS):
        ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("down"), F.lit(False).alias("above")), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("down"), F.lit(True).alias("above")))
        each = edges.mapInPandas(_contracted, "u long, v long").select(F.inline(ends))
        nodes = each.groupBy("node").agg(F.collect_set("down").alias("downs"), F.bool_or("above").alias("above")).where(F.size("downs") > 0)
        nodes = cut(nodes.select("node", F.array_min("downs").alias("least"), "downs", "above"))
        if old is not None:
            discard(old)
        old = nodes
        if nodes.where((F.size("downs") > 1) | F.col("above")).isEmpty():
            return nodes.select(F.col("node").alias("id"), F.col("least").alias("component"))
        links_of = F.array_union(F.array("node"), F.array_remove("downs", F.col("least")))
        further = side(nodes.where("above").select(F.col("node").alias("at"), F.col("least").alias("to")))
        edges = nodes.select(F.explode(links_of).alias("u"), "least").join(further, F.col("least") == F.col("at"), "left").select("u", F.coalesce("to", "least").alias("v"))
    raise RuntimeError("components have not settled")
