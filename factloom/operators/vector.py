"""Exact vector search, semantic documents and an embedding index that reuses what it has."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import bounded_bytes, identifier_terms
from ..graph import Graph, GraphError, coded


def dot(vector: Column, query: list[float]) -> Column:
    """Inner product with a fixed vector, as built-in expressions."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def search(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding", places: int = 6) -> DataFrame:
    """The ``k`` rows with the largest inner product in double precision, ties by id; the score is shown rounded. Each
    partition keeps ``k`` rows."""
    if not query or k <= 0:
        raise GraphError("query_failed", "the query is empty or the limit is 0")
    if not all(map(math.isfinite, query)):
        raise GraphError("query_failed", "the query has a component that is not finite")
    if not vectors.where(F.size(vec_col) != len(query)).isEmpty():
        raise GraphError("query_failed", "the query has another dimension than the index")
    best = vectors.select(id_col, dot(F.col(vec_col), query).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
    return best.select(id_col, F.round("score", places).alias("score"))


def eligible(nodes: DataFrame) -> DataFrame:
    """Nodes that get a document: no structural kinds, no synthetic paths, no anonymous functions."""
    name = F.col("name")
    anonymous = name.startswith("closure@") | name.startswith("<lambda@") | name.startswith("lambda@")
    return nodes.where(~F.col("kind").isin(*schema.NOT_SEMANTIC) & ~F.col("path").startswith("@") & ~anonymous)


def documents(g: Graph, most_edges: int = 12, most_unresolved: int = 8) -> DataFrame:
    """``node_id, text, content_hash``: what a node is and what it is related to, at most 6,000 bytes.

    In each direction the first edges by priority, relation and neighbour are named and the rest counted. The rank is
    taken before texts are gathered, so a node with very many edges never makes a long list.
    """
    names = g.nodes.select(F.col("node_id").alias("other"), F.col("kind").alias("okind"), "path", "name", "key")
    parts = []
    for own, other, word in (("src", "dst", "out"), ("dst", "src", "in")):
        e = g.edges.select(F.col(own).alias("node_id"), F.col(other).alias("other"), "relation", coded(F.col("relation"), schema.RELATION_PRIORITY).alias("priority"))
        w = Window.partitionBy("node_id").orderBy("priority", "relation", "okind", "path", "name", "key")
        top = e.join(names, "other").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most_edges)
        said = top.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("n", F.concat_ws(" ", "relation", "name").alias("t")))).alias("l"))
        total = e.groupBy("node_id").agg(F.count("*").alias("all"))
        line = F.concat(F.lit(f"{word}: "), F.array_join(F.transform("l", lambda x: x["t"]), "; "), F.when(F.col("all") > most_edges, F.concat(F.lit("; omitted: "), (F.col("all") - most_edges).cast("string"))).otherwise(""))
        parts.append(said.join(total, "node_id").select("node_id", line.alias(word)))
    w = Window.partitionBy("node_id").orderBy("relation", "expression", "reason")
    u = g.unresolved.select(F.col("source_node_id").alias("node_id"), "relation", "expression", "reason").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= most_unresolved)
    u = u.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("n", F.concat_ws(" ", "relation", "expression").alias("t")))).alias("l")).select("node_id", F.concat(F.lit("unresolved: "), F.array_join(F.transform("l", lambda x: x["t"]), "; ")).alias("unresolved"))
    n = eligible(g.nodes)
    for p in (*parts, u):
        n = n.join(p, "node_id", "left")
    text = bounded_bytes(F.concat_ws("\n", F.concat_ws(" ", "kind", "qualified_name"), F.concat(F.lit("terms: "), identifier_terms(F.col("name"))), F.concat(F.lit("path: "), F.col("path")), "out", "in", "unresolved"))
    return n.select("node_id", text.alias("text")).withColumn("content_hash", F.sha2("text", 256))


class ContextTooLong(Exception):
    """An embedder may raise this for a batch that it cannot take; the batch is halved."""


Embedder = Callable[[list[str]], np.ndarray]


def embed_all(embed: Embedder, texts: list[str]) -> list[np.ndarray]:
    try:
        return list(embed(texts))
    except ContextTooLong:
        if len(texts) == 1:
            raise
        half = len(texts) // 2
        return embed_all(embed, texts[:half]) + embed_all(embed, texts[half:])


def build_index(docs: DataFrame, embed: Embedder, cache: DataFrame | None = None, batch: int = 64) -> DataFrame:
    """``node_id, content_hash, vector``: each distinct text is embedded once, and only if ``cache`` (content_hash,
    vector) lacks it."""
    unique = docs.groupBy("content_hash").agg(F.min("text").alias("text"))
    todo = unique.join(cache, "content_hash", "left_anti") if cache is not None else unique

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(0, len(texts), batch):
                got = embed_all(embed, texts[i : i + batch])
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + batch]), pa.array([np.asarray(v, np.float32) for v in got], pa.list_(pa.float32()))], ["content_hash", "vector"])

    new = todo.select("content_hash", "text").mapInArrow(run, "content_hash string, vector array<float>")
    known = new if cache is None else new.unionByName(cache.select("content_hash", "vector"))
    return docs.select("node_id", "content_hash").join(known, "content_hash").select("node_id", "content_hash", "vector")


def index_valid(manifest: dict, snapshot_id: str, graph_digest: str, model: str, policy: int, dimension: int) -> bool:
    """Whether an index belongs to this snapshot, graph, model, policy and dimension."""
    return manifest == {"snapshot_id": snapshot_id, "graph_digest": graph_digest, "model": model, "policy": policy, "dimension": dimension}
