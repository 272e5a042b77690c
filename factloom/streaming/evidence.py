"""Runtime evidence: observations aggregated as a batch or a stream, and held against static edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..graph import Graph, coded

KEY = ["run_id", "relation", "source", "target", "external_target", "thread"]


def aggregate(observations: DataFrame, keys: list[str] | None = None, attributes: Column | None = None) -> DataFrame:
    """Counts, first and last time by run, relation, ends and thread (and attributes, if there are any)."""
    keys = keys or [k for k in (*KEY, "attributes") if k in observations.columns]
    n = F.col("count") if "count" in observations.columns else F.lit(1)
    return observations.groupBy(*keys).agg(F.sum(n).alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def windowed(observations: DataFrame, width: str = "1 day", late: str = "2 hours", keys: list[str] | None = None) -> DataFrame:
    """The same in event-time windows. On a stream, rows later than ``late`` are dropped and their state is freed."""
    keys = keys or [k for k in KEY if k in observations.columns]
    src = observations.withWatermark("ts", late) if observations.isStreaming else observations
    n = F.col("count") if "count" in observations.columns else F.lit(1)
    return src.groupBy(F.window("ts", width).alias("w"), *keys).agg(F.sum(n).alias("count")).select(F.col("w.start").alias("window_start"), *keys, "count")


def reconcile(evidence: DataFrame, g: Graph, complete_sources: DataFrame | None = None) -> DataFrame:
    """``source, target, external_target, relation, category, count``; evidence never removes a static edge.

    ``confirmed`` has a static edge of the relation, ``possible`` a possible call, ``dynamic`` known ends but no edge,
    ``external`` a target outside, ``unmapped`` an end that no node has. Static calls of ``complete_sources`` without
    evidence are ``unobserved``.

    Evidence may carry ``src`` and ``dst``, the ids of its ends; keys aren't looked up then.
    """
    ids = g.nodes.select("key", "node_id")
    given = ["src", "dst"] if {"src", "dst"} <= set(evidence.columns) else []
    e = evidence.groupBy("source", "target", "external_target", "relation", *given).agg(F.sum("count").alias("count"))
    if not given:
        e = e.join(ids.toDF("source", "src"), "source", "left").join(ids.toDF("target", "dst"), "target", "left")
    static = g.edges_of(("calls", "possible-calls")).select("src", "dst", F.col("relation").alias("static")).groupBy("src", "dst").agg(F.max((F.col("static") == "calls").cast("int")).alias("sure"), F.max((F.col("static") == "possible-calls").cast("int")).alias("maybe"))
    m = e.join(static, ["src", "dst"], "left")
    category = (
        F.when(F.col("external_target").isNotNull(), "external").when(F.col("src").isNull() | F.col("dst").isNull(), "unmapped")
        .when(F.col("sure") == 1, "confirmed").when(F.col("maybe") == 1, "possible").otherwise("dynamic")
    )
    out = m.select("source", "target", "external_target", "relation", category.alias("category"), "count")
    if complete_sources is None:
        return out
    calls = g.edges_of(("calls",)).select("src", "dst").join(ids.toDF("source", "src"), "src").join(ids.toDF("target", "dst"), "dst").join(complete_sources.select("source"), "source", "left_semi")
    quiet = calls.join(evidence.select("source", "target").distinct(), ["source", "target"], "left_anti")
    return out.unionByName(quiet.select("source", "target", F.lit(None).cast("string").alias("external_target"), F.lit("calls").alias("relation"), F.lit("unobserved").alias("category"), F.lit(0).cast("long").alias("count")))


def observed_edges(evidence: DataFrame, g: Graph) -> DataFrame:
    """``observed-calls`` edges that evidence adds to a graph; only those not there yet."""
    ids = g.nodes.select("key", "node_id")
    e = evidence.where("target is not null").select("source", "target").distinct().join(ids.toDF("source", "src"), "source").join(ids.toDF("target", "dst"), "target").withColumn("relation", F.lit("observed-calls"))
    e = e.select("src", "dst", "relation", coded(F.col("relation"), schema.RELATION_CODE).cast("short").alias("code"))
    return e.join(g.edges, ["src", "dst", "relation"], "left_anti")
