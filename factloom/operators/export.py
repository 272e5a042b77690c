"""Pages of a graph with all edges among their nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .lookup import bounded, selected


def export_graph(g: Graph, path_prefix: str | None = None, offset: int = 0, limit: int | None = None, pinned=()) -> tuple[DataFrame, DataFrame]:
    """Nodes of a page and pinned nodes (which don't move the page), and the edges between any two of them.

    The page is at most 100,000 nodes, so its ids are broadcast to both ends of the edges.
    """
    page = selected(g, None, path_prefix).orderBy("node_id").offset(offset).limit(bounded(limit, 1000, 100_000))
    nodes = page.unionByName(g.nodes.where(F.col("node_id").isin(list(pinned)))).distinct() if pinned else page
    e = g.edges_among(nodes.select("node_id"))
    return nodes, e.select(F.concat_ws(":", "src", "relation", "dst").alias("edge_id"), "src", "dst", "relation").orderBy("src", "dst", "relation")
