"""Weakly connected components and the architecture summary built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..graph import Graph
from ..session import materialise
from .lookup import bounded, require_relations, selected
from .traverse import LOCAL_EDGES


def _hook(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each component by hooking to minima and pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def components(vertices: DataFrame, edges: DataFrame, size: int | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``node_id, component``: the smallest id of the component; ``vertices(node_id)``, ``edges(src, dst)`` among them.

    Up to ``local_edges`` (``size`` proves it) one task hooks and jumps over arrays. Beyond that, each
    round gives every vertex its smallest neighbour or itself and draws the edges between these (the smallest vertex of
    a component stays to the end), so that the tables shrink; labels are then followed back, last round first.
    """
    if size is not None and size <= local_edges:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for b in batches:
                u.append(b.column(0).to_numpy().astype(np.int64))
                v.append(b.column(1).to_numpy().astype(np.int64))
            u, v = np.concatenate(u), np.concatenate(v)
            ids = np.unique(np.concatenate((u, v)))
            label = _hook(np.searchsorted(ids, u), np.searchsorted(ids, v), len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(ids[label].astype(np.int32))], ["node_id", "component"])

        joined = edges.select("src", "dst").coalesce(1).mapInArrow(run, "node_id int, component int")
        return vertices.join(joined, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))

    def pairs(df: DataFrame, a: str, b: str) -> DataFrame:
        return materialise(df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "wcc-edges")

    e, rounds = pairs(edges, "src", "dst"), []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("low")), "wcc")
        rounds.append(low)
        e = pairs(e.join(low.toDF("u", "_u"), "u").join(low.toDF("v", "_v"), "v"), "_u", "_v")
    if not rounds:
        return vertices.select("node_id", F.col("node_id").alias("component"))
    label = rounds.pop()
    while rounds:
        further = label.toDF("low", "next")
        label = materialise(rounds.pop().join(further, "low", "left").select("u", F.coalesce("next", "low").alias("low")), "wcc")
    return vertices.join(label.toDF("node_id", "component"), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def summary(g: Graph, path_prefix: str | None = None, relations=None, min_size: int = 2, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One row of totals, and the communities by size, internal edges (both descending) and smallest id.

    A community is a component of the selected nodes under the internal edges. Edges with one end selected are
    boundary edges. Components below ``min_size`` are counted but not listed.
    """
    relations = require_relations(relations) or require_relations(schema.ARCHITECTURE_RELATIONS)
    n = selected(g, None, path_prefix)
    e = g.edges_of(relations).select("src", "dst", "relation")
    if path_prefix is None:
        inside, boundary = e, e.where("false").withColumn("outgoing", F.lit(True))
    else:
        marks = n.select(F.col("node_id").alias("src"), F.lit(True).alias("s"))
        marked = e.join(marks, "src", "left").join(marks.select(F.col("src").alias("dst"), F.col("s").alias("d")), "dst", "left")
        inside = marked.where("s and d").select("src", "dst", "relation")
        boundary = marked.where("(s is null) != (d is null)").select("src", "dst", "relation", F.col("s").isNotNull().alias("outgoing"))
    size = g.size_of(relations)
    comp = materialise(components(n.select("node_id"), inside, size), "communities")
    of = lambda df, col: df.join(comp.select(F.col("node_id").alias(col), "component"), col)
    ends = inside.select("src", "dst").unionByName(inside.where("src != dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = ends.groupBy(F.col("src").alias("node_id")).count().withColumnRenamed("count", "degree")
    sizes = comp.groupBy("component").agg(F.count("*").alias("nodes"))
    inner = of(inside, "src").groupBy("component").agg(F.count("*").alias("edges"))
    outer = of(boundary.where("outgoing"), "src").select("component", "outgoing").unionByName(of(boundary.where("not outgoing"), "dst").select("component", "outgoing"))
    outer = outer.groupBy("component").agg(F.count_if("outgoing").alias("outgoing_boundary"), F.count_if(~F.col("outgoing")).alias("incoming_boundary"))
    rank = Window.partitionBy("component").orderBy(F.desc("degree"), "node_id")
    few = comp.join(degree, "node_id", "left").fillna(0, ["degree"]).withColumn("r", F.row_number().over(rank)).where("r <= 5")
    reps = few.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("r", "node_id"))).alias("l")).select("component", F.transform("l", lambda x: x["node_id"]).alias("representatives"))
    out = sizes.join(inner, "component", "left").join(outer, "component", "left").join(reps, "component").fillna(0, ["edges", "outgoing_boundary", "incoming_boundary"])
    listed = out.where(F.col("nodes") >= min_size).orderBy(F.desc("nodes"), F.desc("edges"), "component").limit(bounded(limit))
    totals = sizes.agg(
        F.coalesce(F.sum("nodes"), F.lit(0)).alias("node_count"), F.count("*").alias("component_count"),
        F.count_if(F.col("nodes") >= min_size).alias("community_count"),
        F.coalesce(F.sum(F.when(F.col("nodes") < min_size, F.col("nodes"))), F.lit(0)).alias("excluded_nodes"),
    )
    flow = inside.agg(F.count("*").alias("internal_edges"), F.count_if(F.col("relation") == "observed-calls").alias("runtime_confirmed_relationships"))
    return totals.crossJoin(flow).crossJoin(boundary.agg(F.count("*").alias("boundary_edges"))), listed


def community_counts(g: Graph, communities: DataFrame, column: str) -> DataFrame:
    """``component, value, count`` of a node column (``kind``) or of ``parent_path``, count descending, then value."""
    from ..functions.text import parent_path

    value = parent_path(F.col("path")) if column == "parent_path" else F.col(column)
    return communities.join(g.nodes, "node_id").groupBy("component", value.alias("value")).count().orderBy("component", F.desc("count"), "value")
