"""Near-duplicates by a MinHash LSH forest, confirmed on full shingle sets.

1. Each text gives its set of word shingles (64-bit hashes) and ``TREES`` x ``DEPTH`` MinHash values. Documents with
   equal sets form one class; all that follows works on classes, so copies are never paired.
2. The forest: for each of ``TREES`` orders, classes are sorted by that order's ``DEPTH`` values and dealt by range. A
   region is a run of classes with the same first ``LEAST_DEPTH`` values. A region whose sketches allow few links
   gives all of them as candidates. A crowded one gives a spanning forest of the best (by longest common prefixes:
   each class with the ``BLOCK`` nearest in order and with the few that resemble all others most) and stays open, as
   does one that is cut by the border of two ranges.
3. Candidates are confirmed on full sets. Pairs inside a component that confirmed links already connect need no test;
   each round tests the best pairs between components, until every candidate is confirmed, refuted or inside one.
4. The completion: in each open region that still holds several components, all pairs across components are compared
   by sketch, block against block over several tasks, and those that the sketch allows go through 3. So no pair of a
   common region is dropped unless its sketch refutes it by ``SLACK`` standard deviations.
5. Components are found by alternating large-star and small-star steps over tables in the shared folder.

A pair with similarity s misses all trees with probability about ``(1 - s ** LEAST_DEPTH) ** TREES``, 1e-5 at 0.8;
crowded regions miss no more. A crowd of texts that all resemble each other just below the threshold costs time that
grows with its square, shared out over tasks.

Edge cases: null or wordless texts have an empty set, link to nothing and are their own component; a text of fewer
words than a shingle is one shingle; texts of any length are read whole; rows with a null id join their class, whose
component is named by the smallest id that isn't null (null if none); repeated rows get equal results, and rows that
share an id but not a text are each judged by their own text; an empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TREES, DEPTH, LEAST_DEPTH, BLOCK, HUBS = 16, 8, 3, 128, 16
#: A region with at most so many possible links, or twice its rows, gives them all.
FEW = 128
#: Rows up to which a slim table (ids, names, pairs; some 40 bytes a row) is broadcast; a longer one is shuffled.
BROADCAST_ROWS = 1_000_000
#: Edges up to which one task finds the components (some 60 MB).
LOCAL_EDGES = 200_000
#: Classes in a block of the completion, sets in a block of ``confirm``, and partners from which a class is in blocks.
CROWD, SETS, HUB = 4096, 128, 64
_HASHES = TREES * DEPTH
_RNG = np.random.Generator(np.random.PCG64(20240229))
_MUL = (_RNG.integers(1, 1 << 31, _HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, _HASHES, dtype=np.uint32)
#: Standard deviations below the wanted similarity at which a sketch still lets a pair through.
SLACK = 5.0
#: Multipliers of the bytes of a word by place; longer words are hashed by themselves.
_PLACE = _RNG.integers(0, 1 << 64, 64, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOW = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint64) + np.uint64(1)
_LOW[_SPACE] = 0
#: Bytes of text hashed at once.
_STRETCH = 1 << 19


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts (white space apart, A-Z lower-cased), and where each text's begin.

    ``data`` holds the bytes of the texts end to end, ``bounds`` where each begins, and the end.
    """
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    first[edges] = ~space[edges]
    starts = np.flatnonzero(first)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _STRETCH)))
        lo, hi = int(starts[i]), int(starts[j]) if j < len(starts) else len(data)
        at = starts[i:j] - lo
        place = np.arange(hi - lo) - np.repeat(at, np.diff(at, append=hi - lo))
        size = np.add.reduceat((~space[lo:hi]).astype(np.int64), at)
        h = np.add.reduceat(_LOW[data[lo:hi]] * _PLACE[np.minimum(place, 63)], at)
        for w in np.flatnonzero(size > 64).tolist():
            word = data[lo + at[w] : lo + at[w] + size[w]].tobytes().lower()
            h[w] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        out[i:j] = _mix(h ^ size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        i = j
    return out, np.searchsorted(starts, bounds)


def _chain(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of ``n`` words."""
    s = np.full(max(len(h) - n + 1, 0), n, np.uint64)
    for i in range(n):
        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return s


def _distinct(s: np.ndarray) -> np.ndarray:
    s = np.sort(s)
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``k`` words."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    buffers = texts.buffers()
    bounds = np.frombuffer(buffers[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(buffers[2], np.uint8)[bounds[0] : bounds[-1]] if buffers[2] and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    h, at = word_hashes(data, bounds - bounds[0])
    whole = _chain(h, k)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield _distinct(whole[lo : hi - k + 1]) if hi - lo >= k else _chain(h[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64)


def shingles(text: str | None, k: int) -> np.ndarray:
    """``shingle_sets`` of one text."""
    return next(shingle_sets(pa.array([(text or "").encode("utf-8", "surrogatepass")], pa.large_binary()), k))


def signature(s: np.ndarray) -> np.ndarray:
    """The MinHash values of a set, 32 bits each."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(_HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):
        np.minimum(out, (low[i : i + 512, None] * _MUL + _ADD).min(axis=0), out=out)
    return out * np.uint32(0x9E3779B1)


def pack(sig: np.ndarray) -> tuple[bytes, bytes]:
    """Sort keys (16 bits a value, big-endian, tree after tree) and sketch (4 bits a value) of signatures."""
    nibble = (sig * np.uint32(0x85EBCA6B)) >> np.uint32(28)
    return (sig >> np.uint32(16)).astype(">u2").tobytes(), (nibble[0::2] | nibble[1::2] << np.uint32(4)).astype(np.uint8).tobytes()


def set_name(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def sign(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n_shingles, sid`` (name of the set), ``keys`` and ``sketch`` of each row."""
    common.arrow_limits(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(len(s), set_name(s), *(pack(signature(s)) if len(s) else (None, None))) for s in shingle_sets(b.column(1), k)]
            n, sid, keys, sketch = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (sid, keys, sketch))], ["id", "n_shingles", "sid", "keys", "sketch"])

    return src.mapInArrow(common.trimmed(run), "id bigint, n_shingles bigint, sid binary, keys binary, sketch binary")


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal nibbles of sketches (8 unsigned 64-bit words each), freed from chance."""
    d = x ^ y
    d = (d | d >> np.uint64(1) | d >> np.uint64(2) | d >> np.uint64(3)) & np.uint64(0x1111111111111111)
    return (1 - np.bitwise_count(d).sum(-1, dtype=np.int64) / _HASHES - 1 / 16) / (15 / 16)


def _compare(x: np.ndarray) -> np.ndarray:
    """``_alike`` for each pair of rows."""
    return _alike(x[:, None, :], x[None, :, :])


def _hub_pairs(x: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """For each row of a crowded region its best of the ``HUBS`` rows that are nearest to the region's consensus.

    Copies of one original resemble it more than each other, and the original is what their values agree on.
    """
    raw = x.view(np.uint8).reshape(len(x), -1)
    nibbles = np.concatenate((raw & 15, raw >> 4), axis=1)
    mode = np.argmax(np.stack([(nibbles == v).sum(0) for v in range(16)]), axis=0)
    hubs = np.argsort(-(nibbles == mode).sum(1), kind="stable")[:HUBS]
    est = np.stack([_alike(x, x[h]) for h in hubs], axis=1)
    est[hubs, np.arange(len(hubs))] = 0
    best = np.argmax(est, axis=1)
    return [(i, int(hubs[j]), float(est[i, j])) for i, j in enumerate(best) if est[i, j] >= least]


def _block_pairs(est: np.ndarray, least: float) -> tuple[list[tuple[int, int]], bool]:
    """The pairs that reach ``least``, if they are few, else a spanning forest of them by falling estimate; and whether
    these are all."""
    n = len(est)
    i, j = np.nonzero(np.triu(est >= least, 1))
    if len(i) <= max(2 * n, FEW):
        return list(zip(i.tolist(), j.tolist(), strict=True)), True
    order = np.argsort(-est[i, j], kind="stable")
    root, keep = list(range(n)), []

    def top(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        ra, rb = top(a), top(b)
        if ra != rb:
            root[ra] = rb
            keep.append((a, b))
            if len(keep) == n - 1:
                break
    return keep, False


def _bound(similarity: float) -> float:
    return similarity - SLACK * (similarity * (1 - similarity) / _HASHES) ** 0.5 / (15 / 16)


def _regions() -> Column:
    """Of ``keys``: the name of the region in each tree."""
    return F.expr(f"transform(sequence(0, {TREES - 1}), t -> xxhash64(cast(t as tinyint), substring(keys, t * {2 * DEPTH} + 1, {2 * LEAST_DEPTH})))")


def forest(classes: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs ``a, b, est`` (a < b) of ``sid, keys, sketch`` rows; a pair may come from several trees.

    Rows with only ``region`` name the regions whose pairs are not all given.
    """
    spark = classes.sparkSession
    common.arrow_limits(spark)
    least = _bound(similarity)
    width = 2 * DEPTH
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = classes.select("sid", "sketch", "keys", trees).select(F.col("tree").cast("byte").alias("tree"), F.expr(f"substring(keys, tree * {width} + 1, {width})").alias("key"), "sid", "sketch")
    rows = rows.withColumn("region", F.xxhash64("tree", F.substring("key", 1, 2 * LEAST_DEPTH)))
    # the last sort column deals equal keys at random, in another way for each tree
    rows = rows.repartitionByRange("tree", "key", F.xxhash64("tree", "sid")).sortWithinPartitions("tree", "key", F.xxhash64("tree", "sid"))

    types = (pa.binary(), pa.binary(), pa.float32(), pa.int64())

    def batch_of(a: list, b: list, est: np.ndarray | list, region: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((a, b, est, region), types, strict=True)], ["a", "b", "est", "region"])

    def pairs_of(sids: np.ndarray, x: np.ndarray, out: list) -> bool:
        n = len(sids)
        for i, j, e in _hub_pairs(x, least) if n > BLOCK else ():
            out.append((*sorted((sids[i], sids[j])), e, None))
        for lo in range(0, n, BLOCK):
            est = _compare(x[lo : lo + BLOCK])
            some, whole = _block_pairs(est, least)
            out.extend((*sorted((sids[lo + i], sids[lo + j])), float(est[i, j]), None) for i, j in some)
        return whole and n <= BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, is_open, out = None, [], True, []

        def piece(more: bool) -> None:
            """Pairs of what is held of a region; ``more`` if that isn't all of it."""
            nonlocal is_open, held
            sids, x = (np.concatenate(c) for c in zip(*held, strict=True))
            is_open |= more or not pairs_of(sids, x, out)
            held = []

        for b in batches:
            if not b.num_rows:
                continue
            region, sids, x = b.column(4).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), common.fixed_width(b.column(3), np.uint64)
            starts = np.concatenate(([0], np.flatnonzero(region[1:] != region[:-1]) + 1))
            size = np.diff(starts, append=len(region))
            # regions of few rows within a batch: all pairs at once, by distance
            easy = size <= 16
            easy[[0, -1]] = False
            run_of, small = np.repeat(np.arange(len(starts)), size), np.repeat(easy, size)
            found: list[tuple] = []
            for d in range(1, int(size[easy].max(initial=1))):
                i = np.flatnonzero((run_of[d:] == run_of[:-d]) & small[:-d])
                est = _alike(x[i], x[i + d])
                i, est = i[est >= least], est[est >= least]
                found.append((np.minimum(sids[i], sids[i + d]), np.maximum(sids[i], sids[i + d]), est))
            if found:
                a, c, est = (np.concatenate(f) for f in zip(*found, strict=True))
                yield batch_of(a.tolist(), c.tolist(), est, [None] * len(a))
            for k in np.flatnonzero(~easy).tolist():
                at, lo = int(region[starts[k]]), int(starts[k])
                if at != here:
                    if held:
                        piece(False)
                    if here is not None and is_open:
                        out.append((None, None, None, here))
                    # the first region of a range may have begun in another one
                    here, is_open = at, here is None
                for i in range(lo, lo + int(size[k]), 32 * BLOCK):  # a crowded region is never held whole
                    held.append((sids[i : min(i + 32 * BLOCK, lo + int(size[k]))], x[i : min(i + 32 * BLOCK, lo + int(size[k]))]))
                    if sum(len(h[0]) for h in held) >= 32 * BLOCK:
                        piece(True)
                if len(out) >= 20_000:
                    yield batch_of(*map(list, zip(*out, strict=True)))
                    out.clear()
        if held:
            piece(True)
        if here is not None:
            out.append((None, None, None, here))  # it may go on in the next range
            yield batch_of(*map(list, zip(*out, strict=True)))

    return rows.mapInArrow(common.trimmed(run), "a binary, b binary, est float, region bigint")


def _small(df: DataFrame) -> DataFrame:
    """A slim written table, marked for broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _cross_pairs(x: np.ndarray, n: np.ndarray, c: np.ndarray, side: np.ndarray, least: float, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers and estimates of the pairs in different components ``c`` that reach ``least`` and whose set sizes
    ``n`` allow the similarity; where both values of ``side`` occur, of pairs across sides only."""
    names, counts = np.unique(c, return_counts=True)
    big = c == names[np.argmax(counts)]  # its rows needn't be compared with each other
    if side.any() and not side.all():
        work = [(np.flatnonzero(~side & ~big), np.flatnonzero(side)), (np.flatnonzero(~side & big), np.flatnonzero(side & ~big))]
    else:
        few = np.flatnonzero(~big)
        work = [(few, np.concatenate((np.flatnonzero(big), few)))]
    for left, right in work:
        for i in (left[a : a + 64] for a in range(0, len(left), 64)):
            for j in (right[a : a + 1024] for a in range(0, len(right), 1024)):
                ni, nj = n[i][:, None], n[j][None, :]
                ok = (c[i][:, None] != c[j][None, :]) & (100 * np.minimum(ni, nj) >= percent * np.maximum(ni, nj))
                if len(work) == 1:
                    ok &= big[j][None, :] | (i[:, None] < j[None, :])
                u, v = np.nonzero(ok)
                u, v = i[u], j[v]
                est = _alike(x[u], x[v])
                if (hit := est >= least).any():
                    yield u[hit], v[hit], est[hit]


def crossing(classes: DataFrame, opened: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """All pairs ``a, b, est`` (a < b, each once) whose first common region is among ``opened``, whose sketches and
    sizes allow the similarity and whose components in ``comp`` differ. ``classes`` has ``sid, keys, sketch, n``."""
    spark = classes.sparkSession
    common.arrow_limits(spark)
    least = _bound(percent / 100)
    each = classes.select("sid", F.explode(_regions()).alias("region")).join(_small(opened), "region", "left_semi")
    named = each.join(comp.select(F.col("v").alias("sid"), "c"), "sid", "left").select("sid", "region", F.xxhash64(F.coalesce("c", "sid")).alias("c"))
    named = common.materialise(named, "minhash-regions")
    mixed = named.groupBy("region").agg(F.count("*").alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi")
    mixed = common.materialise(mixed.select("region", F.ceil(F.col("size") / CROWD).cast("int").alias("blocks")), "minhash-mixed")
    member = named.join(_small(mixed), "region")
    member = member.withColumn("i", F.pmod(F.xxhash64("sid"), "blocks").cast("int")).withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = member.join(classes.select("sid", "sketch", "n", _regions().alias("regions")), "sid").select("region", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "sid", "sketch", "n", "c", "regions")
    rows = rows.repartition("region", "p", "q").sortWithinPartitions("region", "p", "q")

    def pairs_of(at: tuple, group: list[tuple]) -> Iterator[pa.RecordBatch]:
        side, sids, sketches, n, c, regions = zip(*group, strict=True)
        x = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sids), -1)
        rs = np.array(regions, np.int64)
        for u, v, e in _cross_pairs(x, np.array(n, np.int64), np.array(c, np.int64), np.array(side) != at[1], least, percent):
            same = rs[u] == rs[v]
            first = rs[u, np.argmax(same, axis=1)] == at[0]  # a pair of several regions comes from the first alone
            ab = [(sids[i], sids[j]) if sids[i] < sids[j] else (sids[j], sids[i]) for i, j in zip(u[first].tolist(), v[first].tolist(), strict=True)]
            if ab:
                a, b = zip(*ab, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(e[first], pa.float32())], ["a", "b", "est"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, group = None, []
        for batch in batches:
            for region, p, q, *row in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if (region, p, q) != here:
                    if len(group) > 1:
                        yield from pairs_of(here, group)
                    here, group = (region, p, q), []
                group.append(tuple(row))
        if len(group) > 1:
            yield from pairs_of(here, group)

    return rows.mapInArrow(common.trimmed(run), "a binary, b binary, est float")


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict = {}

    def top(v):
        while (r := root[v]) != v:
            root[v] = v = root[r]
        return v

    kind = pa.binary()
    for b in batches:
        kind = b.column(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            root.setdefault(u, u)
            root.setdefault(v, v)
            x, y = top(u), top(v)
            if x != y:
                root[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), kind), pa.array([top(v) for v in list(root)], kind)], ["v", "c"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``v, c`` for each vertex of the edges ``a, b``: the smallest vertex of its component.

    Alternates large-star and small-star until no edge changes; every step is an aggregation of slim rows. Up to
    ``LOCAL_EDGES`` edges one task does the same with a union-find.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = common.materialise(e, name)
    if e.count() <= LOCAL_EDGES:
        return common.materialise(e.coalesce(1).mapInArrow(common.trimmed(_union_find), e.selectExpr("u as v", "v as c").schema), name)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u != v").distinct()
        large = common.materialise(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = common.materialise(small, name)
        mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1))))
        done = e.agg(mark.alias("m")).first() == small.agg(mark.alias("m")).first()
        common.discard(e, large)
        e = small
        if done:
            break
    return common.materialise(e.select(F.col("u").alias("v"), F.col("v").alias("c")).unionByName(e.select("v", F.col("v").alias("c")).distinct()), name)


def _similar(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sets of each pair have 100 * intersection >= percent * union."""
    n = np.array([len(s) for s in sets], np.int64)
    both = np.empty(len(a), np.int64)
    if len(a) <= 4 * len(sets):
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = (sets[i], sets[j]) if n[i] <= n[j] else (sets[j], sets[i])
            both[k] = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()
    else:  # many pairs of few sets: bits of the shingles that several sets have
        owner = np.repeat(np.arange(len(sets)), n)
        _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        shared = count[at] > 1
        dims = int(number[-1]) + 1
        words = -(-dims // 64)
        both[:] = 0
        for lo in range(0, words, 512):  # a bounded stretch of the bits at a time
            bits = np.zeros((len(sets), 64 * min(512, words - lo)), bool)
            d = number[at] - 64 * lo
            ok = shared & (d >= 0) & (d < bits.shape[1])
            bits[owner[ok], d[ok]] = True
            packed = np.packbits(bits, axis=1).view(np.uint64)
            for k in range(0, len(a), 1024):
                both[k : k + 1024] += np.bitwise_count(packed[a[k : k + 1024]] & packed[b[k : k + 1024]]).sum(-1, dtype=np.int64)
    return 100 * both >= percent * (n[a] + n[b] - both)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` (written, each once) whose full ``sets`` (sid, s) have the similarity.

    Pairs are dealt into cells, and each cell gets every set that it needs once. A class with at most ``HUB`` partners
    has a cell of its own for its pairs; those between two of more partners lie in blocks of about ``SETS`` sets.
    """
    common.arrow_limits(pairs.sparkSession)
    ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid")))
    hubs = common.materialise(ends.groupBy("sid").count().where(F.col("count") > HUB).select("sid"), "minhash-hubs")
    n_hubs = hubs.count()
    cell = F.xxhash64("a")
    dealt = pairs.select("a", "b")
    if n_hubs:
        table = F.broadcast(hubs) if n_hubs <= BROADCAST_ROWS else hubs
        for x in "ab":
            dealt = dealt.join(table.select(F.col("sid").alias(x), F.lit(True).alias(f"h{x}")), x, "left")
        blocks = F.lit(max(1, n_hubs // SETS))
        block = F.xxhash64(F.pmod(F.xxhash64("a"), blocks), F.pmod(F.xxhash64("b"), blocks))
        cell = F.when(F.col("ha").isNull(), F.xxhash64("a")).when(F.col("hb").isNull(), F.xxhash64("b")).otherwise(block)
    dealt = common.materialise(dealt.select("a", "b", cell.alias("cell")), "minhash-cells")
    need = dealt.select(F.col("a").alias("sid"), "cell").unionByName(dealt.select(F.col("b").alias("sid"), "cell")).distinct()
    # sets are big and names short: up to the bound only the sets that cells need are shuffled
    need = F.broadcast(need) if dealt.count() <= BROADCAST_ROWS // 4 else need
    none = F.lit(None).cast("binary")
    rows = sets.join(need, "sid").select("cell", F.col("sid").alias("a"), none.alias("b"), "s").unionByName(dealt.select("cell", "a", "b", none.alias("s")))
    rows = rows.repartition("cell").sortWithinPartitions("cell", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, number, held, a, b = None, {}, [], [], []

        def flush() -> pa.RecordBatch:
            i, j = (np.array([number[x] for x in side], np.int64) for side in (a, b))
            ok = pa.array(_similar(held, i, j, percent)) if a else pa.array([], pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()).filter(ok) for x in (a, b)], ["a", "b"])

        for batch in batches:
            for c, x, y, s in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if c != here:
                    if a:
                        yield flush()
                    here, number, held, a, b = c, {}, [], [], []
                if y is None:
                    if x not in number:
                        number[x] = len(held)
                        held.append(np.frombuffer(s, np.uint64))
                else:
                    a.append(x)
                    b.append(y)
        if a:
            yield flush()

    return rows.mapInArrow(common.trimmed(run), "a binary, b binary")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept`` of each row of ``docs``; ``kept`` marks the smallest id of its component."""
    signed, label = _label(docs, k, percent, id_col, text_col)
    out = common.join_unique(signed.select("id", "n_shingles", "sid"), label.select("sid", "component_id"), "sid")
    own = F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))


def _label(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``sign`` of all rows; and ``sid, rep, component_id, first`` of each class: its smallest id, its component's, and
    whether it is the one of its component that ``drop_near_duplicates`` keeps."""
    signed = common.materialise(sign(docs, k, id_col, text_col), "minhash-signed")
    some = signed.where("sid is not null")
    classes = common.materialise(some.groupBy("sid").agg(F.min("id").alias("rep"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n")), "minhash-classes")
    grown = common.materialise(forest(classes, percent / 100), "minhash-forest")
    pairs = common.materialise(grown.where("region is null").groupBy("a", "b").agg(F.max("est").alias("est")), "minhash-pairs")
    opened = common.materialise(grown.where("region is not null").select("region").distinct(), "minhash-opened")
    common.discard(grown)
    sets = _sets_of(pairs, classes, None, docs, k, id_col, text_col)
    comp, found, tested = _link(pairs, sets, percent)
    more = crossing(classes, opened, comp, percent)
    for t in tested:
        more = more.join(t, ["a", "b"], "left_anti")
    more = common.materialise(more, "minhash-more")
    if not more.isEmpty():
        sets = sets.unionByName(_sets_of(more, classes, sets, docs, k, id_col, text_col))
        comp, _, _ = _link(more, sets, percent, found, 16)
    best = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "sid")).alias("best")
    named = classes.select("sid", "rep").join(comp.select(F.col("v").alias("sid"), "c"), "sid", "left").select("sid", "rep", F.coalesce("c", "sid").alias("c"))
    named = common.materialise(named, "minhash-named")
    label = named.join(named.groupBy("c").agg(best), "c").select("sid", "rep", F.col("best.rep").alias("component_id"), (F.col("sid") == F.col("best.sid")).alias("first"))
    return signed, common.materialise(label, "minhash-label")


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """``sid, s`` (the set's bytes) of rows ``sid, text``; rows whose text doesn't have the named set go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(name, s.tobytes()) for want, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), k), strict=True) if (name := set_name(s)) is not None and want in (None, name)]
            sid, s = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.binary()), pa.array(s, pa.binary())], ["sid", "s"])

    return rows.select("sid", "text").mapInArrow(common.trimmed(run), "sid binary, s binary")


def _sets_of(pairs: DataFrame, classes: DataFrame, have: DataFrame | None, docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """``sid, s`` of the classes of ``pairs`` that ``have`` lacks: the text is found by the smallest id and checked by its set."""
    ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    ends = ends if have is None else ends.join(have.select("sid"), "sid", "left_anti")
    named = common.materialise(ends.join(classes.select("sid", "rep"), "sid"), "minhash-named")
    src = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    by_id = _sets(src.where("rep is not null").join(_small(named.where("rep is not null")), "rep"), k)
    nameless = _sets(src.where("rep is null").select(F.lit(None).cast("binary").alias("sid"), "text"), k).join(named.where("rep is null").select("sid"), "sid", "left_semi")
    return common.materialise(by_id.unionByName(nameless).groupBy("sid").agg(F.first("s").alias("s")), "minhash-sets")


def _link(pairs: DataFrame, sets: DataFrame, percent: int, found: DataFrame | None = None, most: int = 1) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """``v, c``: components of the confirmed candidates and of those ``found`` before; those of one class alone are left
    out. Also all confirmed pairs, and the tables of the tested ones."""
    left, old, tested = pairs, [], []
    comp = pairs.select(F.col("a").alias("v"), F.col("b").alias("c")).where("false")
    while True:
        if found is None:
            open_pairs = left.select("a", "b", "est", F.col("a").alias("ca"), F.col("b").alias("cb"))
        else:
            comp = components(found, "minhash-link")
            table = _small(comp)
            open_pairs = (
                left.join(table.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a", "left")
                .join(table.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b", "left")
                .select("a", "b", "est", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
                .where("ca != cb")
            )
        open_pairs = common.materialise(open_pairs, "minhash-open")
        common.discard(*old)
        if open_pairs.isEmpty():
            return comp, found, tested
        # the best pairs of each component, one from each of ``most`` random shares of its pairs
        share = F.pmod(F.xxhash64("a", "b"), F.lit(most)).alias("share")
        ends = open_pairs.select(F.col("ca").alias("c"), share, "est", "a", "b").unionByName(open_pairs.select(F.col("cb").alias("c"), share, "est", "a", "b"))
        best = ends.groupBy("c", "share").agg(F.max(F.struct("est", "a", "b")).alias("best"))
        chosen = common.materialise(best.select("best.a", "best.b").distinct(), "minhash-chosen")
        new = common.materialise(confirm(chosen, sets, percent), "minhash-new")
        found = new if found is None else found.unionByName(new)
        left = open_pairs.select("a", "b", "est").join(_small(chosen), ["a", "b"], "left_anti")
        tested.append(chosen)
        old = [open_pairs]
        most *= 16


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of ``docs`` the row with the smallest id, all columns kept.

    Rows with one id and one shingle set are one document, of which one row stays; rows with one id and different
    sets are different documents. Where a component has several of its smallest id, the one with the smallest set
    name stays. Rows with a null id come after all others. Wordless documents stay, one row for each id.
    """
    signed, label = _label(docs, k, percent, id_col, text_col)
    # an id of one row is judged by the id alone, so that only ids travel; rows of other ids by id and set
    often = common.materialise(signed.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias("_nd_often")), "minhash-often")
    named = common.join_unique(signed.select("id", "sid").where("id is not null and sid is not null"), label.select("sid", "rep", "first"), "sid", "inner")
    gone = _small(common.materialise(named.where("not first or id != rep").select(F.col("id").alias("_nd_gone")).distinct(), "minhash-gone"))
    of_id = docs[id_col].cast("long")
    rest, n_often, others = docs.where(of_id.isNotNull()), often.count(), docs.where(of_id.isNull())
    if n_often:
        often = F.broadcast(often) if n_often <= BROADCAST_ROWS else often
        others = others.unionByName(rest.join(often, of_id == often["_nd_often"], "left_semi"))
        rest = rest.join(often, of_id == often["_nd_often"], "left_anti")
    rest = rest.join(gone, of_id == gone["_nd_gone"], "left_anti")
    if n_often or not signed.where("id is null").isEmpty():

        @F.pandas_udf("binary")
        def sid_of(texts: pd.Series) -> pd.Series:
            return pd.Series([set_name(shingles(t if isinstance(t, str) else None, k)) or b"" for t in texts], dtype=object)

        others = others.withColumns({"_nd_sid": sid_of(F.col(text_col)), "_nd_id": F.col(id_col).cast("long")})
        win = _small(common.materialise(label.where("first").select(F.col("sid").alias("_nd_s"), F.col("rep").alias("_nd_r")), "minhash-first"))
        stay = others.join(win, (F.col("_nd_sid") == F.col("_nd_s")) & F.col("_nd_id").eqNullSafe(F.col("_nd_r")), "left_semi")
        stay = stay.unionByName(others.where(F.octet_length("_nd_sid") == 0)).dropDuplicates(["_nd_id", "_nd_sid"])
        rest = rest.unionByName(stay.drop("_nd_id", "_nd_sid"))
    return rest.select(*docs.columns)
