"""Synthetic graphs, mutations and query workloads: deterministic in their seed, made by closed forms on executors.

Candidate pairs are numbered 0..size-1 and walked by an affine permutation ``(step * i + start) % size``, so that any
number of distinct edges is drawn without keeping a set of those drawn before.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import materialise

TOPOLOGIES = tuple("dense-subsystem entangled hub-heavy layered modular".split())
TIERS = {"small": (10_000, 100_000), "medium": (100_000, 1_000_000), "large": (1_000_000, 10_000_000), "stress": (5_000_000, 50_000_000)}


def permutation(size: int, seed: int) -> tuple[int, int]:
    """Step and start; the step is prime to the size."""
    rng = np.random.default_rng(seed)
    step = int(rng.integers(1, max(size, 2))) | 1
    while math.gcd(step, size) != 1:
        step += 2
    return step % size or 1, int(rng.integers(0, max(size, 1)))


def walked(i: np.ndarray, size: int, step: int, start: int) -> np.ndarray:
    """``(step * i + start) % size`` without overflow: the first of each run of ``m`` numbers exactly, the others from it."""
    m = max(1, (1 << 62) // size)
    run, at = np.unique(i // m, return_inverse=True)
    first = np.array([(step * m * int(q) + start) % size for q in run], dtype=np.int64)
    return (first[at] + step * (i % m)) % size


def _pairs(spark: SparkSession, count: int, size: int, seed: int, decode) -> DataFrame:
    """``i, src, dst``: the first ``count`` pairs of the walk, numbered from 0."""
    if count > size:
        raise ValueError(f"{count} edges don't fit in {size} pairs")
    step, start = permutation(size, seed)

    @F.pandas_udf("src int, dst int")
    def draw(i: pd.Series) -> pd.DataFrame:
        u, v = decode(walked(i.to_numpy(), size, step, start))
        return pd.DataFrame({"src": u.astype(np.int32), "dst": v.astype(np.int32)})

    return spark.range(count).select(F.col("id").alias("i"), draw("id").alias("e")).select("i", "e.*")


BIN = 65_536


def _first_new(draw, most: int, have: DataFrame, n: int) -> DataFrame:
    """``i, src, dst``: the first ``n`` (all, if fewer) of the pairs ``draw(most)`` that aren't in ``have``. Fewer are
    drawn first, which nearly always has enough new ones; the end is found by counts of bins, so that only one bin is sorted."""
    some = min(most, n + n // 8 + 10_000)
    while True:
        fresh = materialise(draw(some).join(have, ["src", "dst"], "left_anti"), "fresh")
        counts = sorted(fresh.groupBy(F.floor(F.col("i") / BIN).alias("b")).count().collect())
        if some == most or sum(c for _, c in counts) >= n:
            break
        some = most
    before = 0
    for b, c in counts:
        if before + c > n:
            last = fresh.where(F.col("i").between(b * BIN, (b + 1) * BIN - 1)).orderBy("i").limit(n - before)
            return fresh.where(F.col("i") < b * BIN).unionByName(last).select("i", "src", "dst")
        before += c
    return fresh.select("i", "src", "dst")


def _ordered(n: int):
    """All ordered pairs without loops of n nodes."""

    def decode(at):
        u, r = at // (n - 1), at % (n - 1)
        return u, r + (r >= u)

    return n * (n - 1), decode


def synthetic(spark: SparkSession, topology: str, nodes: int, edges: int, seed: int = 0) -> DataFrame:
    """``src, dst, code``: distinct edges without loops, exactly ``edges`` of them."""
    size, anywhere = _ordered(nodes)
    groups = max(2, round(nodes ** 0.5 / 2))
    width = nodes // groups

    def inside(part: int):
        n, decode = _ordered(width)

        def local(at):
            u, v = decode(at % n)
            return u + at // n * width, v + at // n * width

        return n * part, local

    if topology == "entangled":
        plan = [(edges, size, anywhere)]
    elif topology == "modular":
        n, decode = inside(groups)
        plan = [(min(edges * 4 // 5, n), n, decode)]
    elif topology == "hub-heavy":
        hubs = max(1, nodes // 32)
        n = hubs * (nodes - hubs)
        plan = [(min(edges // 2, n), n, lambda at: (hubs + at // hubs, at % hubs))]
    elif topology == "layered":
        n = (groups - 1) * width * width
        plan = [(min(edges * 9 // 10, n), n, lambda at: (at // (width * width) * width + at % (width * width) // width, (at // (width * width) + 1) * width + at % width))]
    elif topology == "dense-subsystem":
        part = max(2, nodes // 8)
        n, decode = _ordered(part)
        plan = [(min(edges // 2, n), n, decode)]
    else:
        raise ValueError(f"unknown topology {topology}")
    out = _pairs(spark, *plan[0][:2], seed, plan[0][2]).drop("i")
    left = edges - plan[0][0]
    if left:
        # so many draws that enough are new even if every edge so far is among them; their order decides which stay
        more = _first_new(lambda k: _pairs(spark, k, size, seed + 1, anywhere), min(size, left + plan[0][0]), out, left)
        out = out.unionByName(more.select("src", "dst"))
    return out.withColumn("code", (F.pmod(F.xxhash64("src", "dst"), F.lit(32)) + 1).cast("short"))


def mutate(edges: DataFrame, node_count: int, selection: str, amount: int | float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(added, removed)``: edges of the selected nodes go and as many new pairs of the same codes come.

    ``single-node`` takes the smallest node with edges, ``local-range`` ``amount`` nodes in a row, ``scattered``
    ``amount`` nodes by hash, ``hub`` the node of the largest degree, ``percentage`` a share of the edges.
    """
    spark = edges.sparkSession
    # written once: it is read for degrees, removals and additions
    edges = materialise(edges, "edges")
    if selection == "percentage":
        k = max(1, round(edges.count() * float(amount) / 100))
        removed = edges.orderBy(F.xxhash64("src", "dst", F.lit(seed)), "src", "dst").limit(k)
    else:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("n")).groupBy("n").count()
        if selection == "single-node":
            chosen = ends.orderBy("n").limit(1)
        elif selection == "hub":
            chosen = ends.orderBy(F.desc("count"), "n").limit(1)
        elif selection == "local-range":
            first = seed % max(node_count - int(amount), 1)
            chosen = ends.where(F.col("n").between(first, first + int(amount) - 1))
        elif selection == "scattered":
            chosen = ends.orderBy(F.xxhash64("n", F.lit(seed)), "n").limit(int(amount))
        else:
            raise ValueError(f"unknown selection {selection}")
        # ids of at most ``amount`` nodes
        chosen = F.broadcast(materialise(chosen.select("n"), "chosen"))
        removed = edges.join(chosen.toDF("src"), "src", "left_semi").unionByName(edges.join(chosen.toDF("dst"), "dst", "left_semi").select(*edges.columns)).distinct()
    k = removed.count()
    size, anywhere = _ordered(node_count)
    fresh = _first_new(lambda n: _pairs(spark, n, size, seed + 7, anywhere), min(size, 2 * k + edges.count()), edges.select("src", "dst"), k)
    number = F.row_number().over(Window.orderBy("i"))
    codes = removed.select("code").withColumn("r", F.row_number().over(Window.orderBy("code")))
    added = fresh.withColumn("r", number).join(codes, "r").select("src", "dst", "code")
    return added, removed


def workload(g_nodes: int, kind: str, n: int, seed: int = 0, hot: list[int] = ()) -> list[int]:
    """Node ids to ask about: ``random``, ``sequential``, or ``hot`` (from a given list, in turn)."""
    if kind == "sequential":
        return [i % g_nodes for i in range(n)]
    if kind == "hot":
        return [hot[i % len(hot)] for i in range(n)]
    return np.random.default_rng(seed).integers(0, g_nodes, n).tolist()


SELECTIONS = ("single-node", "local-range", "scattered", "hub", "percentage")


def answers(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """``workload, direction, rows, fingerprint``: what all one-hop questions of the workloads (``workload, node``)
    answer together; the fingerprint depends on every row, not on their order."""
    parts = []
    for direction, own, other in (("outgoing", "src", "dst"), ("incoming", "dst", "src")):
        hops = asked.join(edges.select(F.col(own).alias("node"), F.col(other).alias("other"), "code"), "node")
        parts.append(hops.select("workload", F.lit(direction).alias("direction"), F.xxhash64("node", "other", "code").alias("h"), F.xxhash64("code", "other", "node").alias("k")))
    each = parts[0].unionByName(parts[1]).groupBy("workload", "direction")
    return each.agg(F.count("*").alias("rows"), F.concat_ws(":", F.bit_xor("h"), F.sum(F.col("k").cast("decimal(38,0)"))).alias("fingerprint"))


def compare_overlay(nodes: DataFrame, base: DataFrame, mutations: dict[str, tuple[DataFrame, DataFrame]], asked: DataFrame, folder: str) -> DataFrame:
    """For each mutation ``(added, removed)`` of ``base(src, dst, relation, code)``: whether the overlay view and the
    graph rebuilt from it (written below ``folder`` and read again) answer every workload alike.

    ``mutation, workload, direction, rows, rebuilt_rows, same``.
    """
    from .graph import apply_overlay, compact

    out = None
    for name, (added, removed) in mutations.items():
        rebuilt = answers(compact(nodes, base, added, removed, f"{folder}/{name}"), asked)
        view = answers(apply_overlay(base, added, removed), asked)
        both = view.join(rebuilt.select("workload", "direction", F.col("rows").alias("rebuilt_rows"), F.col("fingerprint").alias("_f")), ["workload", "direction"], "full")
        both = both.select(F.lit(name).alias("mutation"), "workload", "direction", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("rebuilt_rows", F.lit(0)).alias("rebuilt_rows"), F.coalesce(F.col("fingerprint") == F.col("_f"), F.lit(False)).alias("same"))
        out = both if out is None else out.unionByName(both)
    return out
