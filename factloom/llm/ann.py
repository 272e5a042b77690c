"""Nearest neighbours by inner product over several shifted Hilbert orders, completed exactly where needed.

Distinct vectors form classes that hold the ``k + 1`` smallest ids with that vector, which is all that a result can
need, so a vector that many rows share is one point. Each of ``ORDERS`` random projections is shifted and laid on a
Hilbert curve; classes are dealt by ranges of (order, key) and each query is reranked against the ``WINDOW`` classes
before and after it in every order. The merged lists are the approximate result.

``complete=True`` makes the result exact. Classes are blocked along the first order; a block pair is searched unless
the norms, centres and radii of both prove that it cannot beat what the query block has already. On clustered
vectors few pairs remain; on vectors without structure no index helps and all remain.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; rows with a null id take no part; repeated rows of one id count once; fewer than ``k`` candidates give as many
ranks as there are; no queries or an empty table give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ORDERS, WINDOW, AXES, BITS = 8, 200, 4, 8
#: Rows whose coordinates fix the shifts, scales and block bounds.
FIT_ROWS = 4096
DATA_BLOCK, QUERY_BLOCK = 16_384, 2048


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates below ``2 ** bits``."""
    x = cells.astype(np.uint64).T.copy()
    n, q = len(x), np.uint64(1 << (bits - 1))
    while q > 1:
        p = q - np.uint64(1)
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            x[i] ^= t
        q >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), np.uint64(1 << (bits - 1))
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - np.uint64(1)), t)
        q >>= np.uint64(1)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << np.uint64(1) | (x[i] >> np.uint64(b)) & np.uint64(1)
    return key


class Curves:
    """Random projections with shifts and scales, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, orders: int = ORDERS, seed: int = 7):
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        self.axes = [np.linalg.qr(rng.normal(size=(dim, min(AXES, dim))))[0] for _ in range(orders)]
        shown = [sample @ a for a in self.axes]
        self.low = [s.min(0) - rng.random(s.shape[1]) * (np.ptp(s, 0) + 1e-9) / 2 for s in shown]
        self.step = [(s.max(0) - lo + 1e-9) * 1.05 / (1 << BITS) for s, lo in zip(shown, self.low, strict=True)]

    def key(self, x: np.ndarray, order: int) -> np.ndarray:
        cells = np.clip((x @ self.axes[order] - self.low[order]) / self.step[order], 0, (1 << BITS) - 1)
        return hilbert(cells.astype(np.uint64)).astype(np.int64)


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component to the last in double precision."""
    out = np.zeros(len(q))
    for i in range(q.shape[1]):
        out += q[:, i] * c[:, i]
    return out


def _top(q: np.ndarray, c: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of queries and candidates and exact scores of each query's ``most`` best candidates."""
    rough = q @ c.T
    n = min(most + 4, len(c))
    at = np.argpartition(-rough, n - 1, axis=1)[:, :n]
    i, j = np.repeat(np.arange(len(q)), n), at.ravel()
    return i, j, exact_scores(q[i], c[j])


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v``: the rows that take part, each vector as the bytes of its doubles."""
    lengths = vectors.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("n")).count()
    dim = (lengths.orderBy(F.desc("count"), "n").first() or [0])[0]
    src = vectors.where(F.col(id_col).isNotNull() & (F.size(vec_col) == dim)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(b.num_rows, -1) + 0.0
            keep = np.flatnonzero(np.isfinite(x).all(1) & (x != 0).any(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array([r.tobytes() for r in x[keep]], pa.binary())], ["vec_id", "v"])

    return src.mapInArrow(common.trimmed(run), "vec_id bigint, v binary") if dim > 0 else src.where("false").select("vec_id", F.lit(None).cast("binary").alias("v"))


PAIR = "q binary, c binary, score double"


def _pairs(q: list, c: list, score: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.binary()), pa.array(c, pa.binary()), pa.array(score, pa.float64())], ["q", "c", "score"])


def windows(classes: DataFrame, curves: Curves, most: int, orders: int = ORDERS, window: int = WINDOW) -> DataFrame:
    """``q, c, score``: for each query class and order, the best of the neighbouring key window."""
    held = classes.sparkSession.sparkContext.broadcast(curves)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            for m in range(orders):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, m, np.int8)), pa.array(held.value.key(x, m)), *b.columns], ["o", "key", "cid", "v", "asks"])

    rows = classes.select("cid", "v", "asks").mapInArrow(common.trimmed(keys), "o tinyint, key bigint, cid binary, v binary, asks boolean")
    rows = rows.repartitionByRange("o", "key", "cid").sortWithinPartitions("o", "key", "cid")

    def rerank(held_rows: list[tuple], start: int) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(r[2] for r in held_rows), np.float64).reshape(len(held_rows), -1)
        out: tuple[list, list, list] = ([], [], [])
        asks = [i for i in range(start, len(held_rows)) if held_rows[i][3]]
        for i in asks:
            lo, hi = max(0, i - window), i + window + 1
            _, j, s = _top(x[i : i + 1], x[lo:hi], most)
            out[0].extend([held_rows[i][1]] * len(j))
            out[1].extend(held_rows[lo + t][1] for t in j)
            out[2].extend(s.tolist())
        return _pairs(*out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, here, done = None, [], 0  # rows before ``done`` have been queries already
        for b in batches:
            for o, cid, v, asks in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if o != order:
                    if here:
                        yield rerank(here, done)
                    order, here, done = o, [], 0
                here.append((o, cid, v, asks))
                if len(here) >= done + 2048 + window:
                    end = len(here) - window
                    yield rerank(here[:end] + [(r[0], r[1], r[2], False) for r in here[end:]], done)
                    here, done = here[max(0, end - window) :], min(window, end)
        if here:
            yield rerank(here, done)

    return rows.mapInArrow(common.trimmed(run), PAIR)


def complete_blocks(classes: DataFrame, found: DataFrame, curves: Curves, bounds: np.ndarray, q_bounds: np.ndarray, most: int) -> DataFrame:
    """``q, c, score`` from all block pairs that may still hold a better candidate than ``found``."""
    spark = classes.sparkSession
    held = spark.sparkContext.broadcast((curves, bounds, q_bounds))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curve, edges, q_edges = held.value
        for b in batches:
            key = curve.key(_matrix(b.column(1)), 0)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.searchsorted(e, key, "right").astype(np.int32)) for e in (edges, q_edges))], ["cid", "v", "asks", "g", "h"])

    rows = common.materialise(classes.select("cid", "v", "asks").mapInArrow(common.trimmed(blocks), "cid binary, v binary, asks boolean, g int, h int"), "ann-blocks")

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums for centres, by block; partial for each batch."""
        for b in batches:
            x, g = _matrix(b.column(1)), b.column(0).to_numpy()
            for k in np.unique(g):
                own = x[g == k]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.sum(0).tobytes()], pa.binary()), pa.array([len(own)], pa.int64())], ["b", "s", "n"])

    def centres(src: DataFrame, col: str) -> dict[int, np.ndarray]:
        sums: dict[int, list] = {}
        for r in src.select(col, "v").mapInArrow(extent, "b int, s binary, n bigint").collect():
            one = sums.setdefault(r["b"], [0.0, 0])
            one[0], one[1] = one[0] + np.frombuffer(r["s"], np.float64), one[1] + r["n"]
        return {k: s / n for k, (s, n) in sums.items()}

    def radii(src: DataFrame, col: str, centre: dict[int, np.ndarray]) -> dict[int, float]:
        mid = spark.sparkContext.broadcast(centre)

        def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, g = _matrix(b.column(1)), b.column(0).to_numpy()
                d = np.linalg.norm(x - np.stack([mid.value[k] for k in g]), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d)], ["b", "d"])

        return {r["b"]: r["d"] for r in src.select(col, "v").mapInArrow(far, "b int, d double").groupBy("b").agg(F.max("d").alias("d")).collect()}

    asking = rows.where("asks")
    gc, hc = centres(rows, "g"), centres(asking, "h")
    gr, hr = radii(rows, "g", gc), radii(asking, "h", hc)
    worst = found.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("s")).select("q", F.when(F.col("n") >= most, F.col("s")).otherwise(F.lit(float("-inf"))).alias("s"))
    floor = {r["h"]: r["s"] for r in asking.join(worst, asking["cid"] == worst["q"], "left").groupBy("h").agg(F.min(F.coalesce("s", F.lit(float("-inf")))).alias("s")).collect()}
    cells = []
    for h, q in hc.items():
        for g, c in gc.items():
            best = q @ c + np.linalg.norm(q) * gr[g] + np.linalg.norm(c) * hr[h] + gr[g] * hr[h]
            if best * (1 + 1e-9) + 1e-9 >= floor[h]:
                cells.append((int(h), int(g)))
    if not cells:
        return spark.createDataFrame([], PAIR)
    table = spark.createDataFrame(cells, "h int, g int")
    asked = asking.select("cid", "v", "h").join(table, "h")
    data = rows.select(F.col("cid").alias("c"), F.col("v").alias("cv"), F.col("g").alias("cg"))
    data = data.join(table.select(F.col("h").alias("ch"), F.col("g").alias("cg")), "cg")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_pairs([], [], [])])
        q_ids, c_ids = left["cid"].to_pylist(), right["c"].to_pylist()
        q, c = _matrix(left["v"]), _matrix(right["cv"])
        out = []
        for lo in range(0, len(q), 256):
            i, j, s = _top(q[lo : lo + 256], c, most)
            out.append(_pairs([q_ids[lo + t] for t in i], [c_ids[t] for t in j], s.tolist()))
        return pa.Table.from_batches(out)

    return asked.groupBy("h", "g").cogroup(data.groupBy("ch", "cg")).applyInArrow(search, PAIR)


def _best(pairs: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """The ``most`` best candidate classes of each query class, ties to the smaller first id."""
    once = pairs.groupBy("q", "c").agg(F.max("score").alias("score"))
    first = classes.select(F.col("cid").alias("c"), F.col("ids")[0].alias("first"))
    ranked = once.join(first, "c").selectExpr("q", "c", "score", "row_number() over (partition by q order by score desc, first) as n")
    return ranked.where(F.col("n") <= most).select("q", "c", "score")


def search(vectors: DataFrame, asks: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", orders: int = ORDERS, window: int = WINDOW, complete: bool = True) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of each row for which ``asks`` (over ``vec_id``) holds."""
    spark = vectors.sparkSession
    common.arrow_limits(spark)
    rows = usable(vectors, id_col, vec_col).distinct().select("vec_id", F.md5("v").alias("hex"), "v").select("vec_id", F.unhex("hex").alias("cid"), "v")
    rows = common.materialise(rows.withColumn("asks", F.coalesce(asks, F.lit(False))), "ann-rows")
    few = rows.selectExpr("cid", "vec_id", "row_number() over (partition by cid order by vec_id) as n").where(F.col("n") <= k + 1)
    lists = few.groupBy("cid").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = rows.groupBy("cid").agg(F.first("v").alias("v"), F.bool_or("asks").alias("asks"))
    classes = common.materialise(points.join(lists, "cid"), "ann-classes")
    n, n_asks = classes.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    if not n_asks:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    share = min(1.0, FIT_ROWS / n)
    picked = classes.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("v").limit(2 * FIT_ROWS).collect()
    if not picked:
        picked = classes.select("v").limit(1).collect()
    sample = np.stack([np.frombuffer(r["v"], np.float64) for r in picked])
    curves = Curves(sample, orders)
    most = k + 1
    found = common.materialise(_best(windows(classes, curves, most, orders, window), classes, most), "ann-windows")
    if complete:
        keys = np.sort(curves.key(sample, 0))

        def edges(parts: int) -> np.ndarray:
            return np.unique(keys[np.linspace(0, len(keys) - 1, parts + 1).astype(int)[1:-1]]) if parts > 1 else np.zeros(0, np.int64)

        rest = complete_blocks(classes, found, curves, edges(-(-n // DATA_BLOCK)), edges(-(-n_asks // QUERY_BLOCK)), most)
        found = common.materialise(_best(found.unionByName(rest), classes, most), "ann-found")
    entries = found.join(classes.select(F.col("cid").alias("c"), "ids"), "c").groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("e"))
    flat = F.flatten(F.transform("e", lambda e: F.transform(e["ids"], lambda i: F.struct((-e["score"]).alias("s"), i.alias("vec_id")))))
    per_class = entries.select(F.col("q").alias("cid"), F.slice(F.array_sort(flat), 1, most).alias("near"))
    queries = rows.where("asks").select(F.col("vec_id").alias("query_id"), "cid")
    joined = common.join_unique(queries, common.materialise(per_class, "ann-lists"), "cid", "inner")
    near = joined.select("query_id", F.posexplode(F.slice(F.filter("near", lambda e: e["vec_id"] != F.col("query_id")), 1, k)).alias("p", "e"))
    return near.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.s")).alias("score"))
