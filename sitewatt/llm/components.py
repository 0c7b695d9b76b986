"""Connected components of an edge table by hooking and contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatt.llm.common import materialize

JUMPS = 2
SMALL = 300_000  # edges that one task may finish: under 100 MB there


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _finish(batches):
    """Labels of a small edge table by union-find, for one task."""
    parent: dict[int, int] = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, z = find(parent.setdefault(u, u)), find(parent.setdefault(v, v))
            if a != z:
                parent[max(a, z)] = min(a, z)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())],
                                     names=["x", "to"])


def components(edges: DataFrame, tag: str) -> DataFrame:
    """``(node, label)`` for every node of ``edges`` (u, v: long); label: the component's smallest node.

    Each round hooks every node to its smallest smaller neighbour, follows the hooks a
    few times (chains shorten by 2**JUMPS) and contracts the edges to the nodes hooked
    to; edges inside a piece vanish, so the table shrinks quickly. The rounds' hooks,
    applied one after the other, give the label. Edges stay distributed; hubs meet
    one row per node, in joins that can be split. Once at most SMALL edges are left
    (counted), one task finishes them; the labels are the same either way.
    """
    e = start = materialize(_ordered(edges), f"{tag}-edges")
    label = None
    while True:
        small = e.count() <= SMALL
        if small:
            hook = materialize(e.coalesce(1).mapInArrow(_finish, "x long, to long"), f"{tag}-hooks")
        else:
            hook = e.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("to"))
            for _ in range(JUMPS):
                hook = materialize(hook, f"{tag}-hooks")
                far = hook.select(F.col("x").alias("to"), F.col("to").alias("far"))
                hook = hook.join(far, "to", "left").select("x", F.coalesce("far", "to").alias("to"))
            hook = materialize(hook, f"{tag}-hooks")
        if small and label is None:
            return hook.select(F.col("x").alias("node"), F.col("to").alias("label"))
        if label is None:
            label = start.select(F.col("u").alias("node")).union(start.select("v")).distinct().withColumn("label", F.col("node"))
        label = (label.join(hook.select(F.col("x").alias("label"), "to"), "label", "left")
                 .select("node", F.coalesce("to", "label").alias("label")))
        if small:
            return materialize(label, f"{tag}-labels")
        at = lambda c: hook.select(F.col("x").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        e = e.join(at("v"), "v").join(at("u"), "u", "left").select(F.coalesce("u_to", "u").alias("u"), F.col("v_to").alias("v"))
        e = materialize(_ordered(e), f"{tag}-edges")
