"""Connected components by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrajobs.storage import discard, stash


def _compress(pointer: DataFrame) -> DataFrame:
    """(u, p) with p <= u becomes (u, root): pointer doubling until nothing moves."""
    while True:
        up = pointer.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        step = stash(
            pointer.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")),
            "pointer",
        )
        still = step.filter("moved").isEmpty()
        discard(pointer)
        pointer = step.select("u", "p")
        pointer._stash_path = step._stash_path
        if still:
            return pointer


def edge_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every id in ``edges``; component is the smallest id reachable.

    Each round every node that has a smaller neighbour hooks to the smallest one, the
    pointers are compressed, and edges are rewritten between roots. Work is on aggregated
    rows, so a node with very many edges is pre-aggregated before it is shuffled. Null ends
    and self loops are ignored; an empty table gives an empty result.
    """
    e = stash(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null and u <> v").distinct(), "edges")
    labels = None
    while not e.isEmpty():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pointer = stash(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "hook")
        pointer = _compress(pointer)
        here = pointer.select(F.col("u").alias("label"), F.col("p").alias("root"))
        if labels is None:
            merged = pointer
        else:
            merged = stash(labels.join(here, "label", "left").select("id", F.coalesce("root", "label").alias("label")), "labels")
        nxt = stash(
            e.join(pointer.select("u", F.col("p").alias("pu")), "u")
            .join(pointer.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
            .filter("pu <> pv")
            .select(F.col("pu").alias("u"), F.col("pv").alias("v"))
            .distinct(),
            "edges",
        )
        discard(e)
        e = nxt
        if labels is None:
            labels = pointer.select(F.col("u").alias("id"), F.col("p").alias("label"))
            labels._stash_path = merged._stash_path
        else:
            discard(labels, pointer)
            labels = merged
    discard(e)
    if labels is None:
        return edges.select(F.col(src).alias("id"), F.col(src).alias("component")).filter("id is not null").limit(0)
    out = labels.select("id", F.col("label").alias("component"))
    out._stash_path = labels._stash_path
    return out


def component_labels(nodes: DataFrame, edges: DataFrame, node_id: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    """Every node with the smallest id reachable; nodes without an edge keep their own id."""
    found = edge_components(edges, src, dst)
    return (
        nodes.select(F.col(node_id).alias("id"))
        .distinct()
        .join(found, "id", "left")
        .select(F.col("id").alias(node_id), F.coalesce("component", "id").alias("component"))
    )
