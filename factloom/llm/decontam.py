"""Benchmark decontamination: an Aho-Corasick automaton over the normalised items, scanning each text once.

Text is lower-cased (A-Z only) and cut into words of digits, letters a-z and all characters beyond ASCII. Every window
of ``window`` consecutive item words counts, or a shorter item as one window. The automaton doesn't hold each window
but every third run of ``window - 2`` words: each window has one of them, and where one occurs in a text the run of
words that text and item share is followed both ways; it is hit if it is at least a window long. Patterns have a space
around and between the words, so matches begin and end at words. Hit words map back to spans of the original.

A benchmark of more than ``PART_BYTES`` is scanned in parts, one after the other, each with an automaton that a worker
builds once; what a part has found in a row is carried on to the next. The driver holds the items of one part.

Edge cases: null and empty texts have no words and no hits; texts of any length are scanned whole; items without words
have no windows; repeated items count once for each distinct id as text, repeated rows are each scanned; null ids of
items are written ``None``; an empty benchmark hits nothing; an empty table gives no rows; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
#: Bytes of item text in one automaton.
PART_BYTES = 4 << 20
_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_SPAN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split() if text else []


def _line(w: list[bytes]) -> str:
    """Words with a space around and between them, one character a byte."""
    return " " + b" ".join(w).decode("latin-1") + " "


class Automaton:
    """Finds all windows of some items in texts."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        import ahocorasick

        self.window, self.ids, self.items = window, [str(i) for i, _ in items], [words(t) for _, t in items]
        size, step = max(1, window - 2), min(3, window)
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, w in enumerate(self.items):
            if len(w) < window:
                if w:
                    owners.setdefault(_line(w), []).append((k, -1))
            else:
                for i in range(0, len(w) - size + 1, step):
                    owners.setdefault(_line(w[i : i + size]), []).append((k, i))
        self.automaton = ahocorasick.Automaton()
        for p, who in owners.items():
            self.automaton.add_word(p, (p.count(" ") - 1, who))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, text: str | None) -> tuple[int, np.ndarray | None, set[str]]:
        """The text's number of words, which of them are hit (None if none is), and the ids of the items found."""
        w, hit, found = words(text), None, set()
        if not w or self.empty:
            return len(w), hit, found
        line = _line(w)
        gaps = None  # word number by place of the space before it
        seen: dict[tuple[int, int], int] = {}  # end of the shared run followed last, by item and distance
        for end, (n, who) in self.automaton.iter(line):
            if gaps is None:
                gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
            at = int(np.searchsorted(gaps, end)) - n
            for k, i in who:
                if i < 0:
                    lo, hi = at, at + n
                else:
                    item, far = self.items[k], at - i
                    if seen.get((k, far), 0) >= at + n:
                        continue
                    lo, hi = at, at + n
                    while lo > 0 and lo > far and w[lo - 1] == item[lo - 1 - far]:
                        lo -= 1
                    while hi < len(w) and hi - far < len(item) and w[hi] == item[hi - far]:
                        hi += 1
                    seen[k, far] = hi
                    if hi - lo < self.window:
                        continue
                if hit is None:
                    hit = np.zeros(len(w), bool)
                hit[lo:hi] = True
                found.add(self.ids[k])
        return len(w), hit, found


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as (start, end) characters of the original text."""
    if not hit.any():
        return []
    raw = text.encode("utf-8", "surrogatepass")
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    at = [m.span() for m in _SPAN.finditer(raw)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [(int(chars[at[i][0]]), int(chars[at[j - 1][1]])) for i, j in edges.reshape(-1, 2).tolist()]


class Part:
    """Items of bounded size; travels to the workers, each of which builds its automaton once."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.items, self.window, self.name = items, window, uuid.uuid4().hex

    def automaton(self) -> Automaton:
        return common.resident(("automaton", self.name), lambda: Automaton(self.items, self.window))


def parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> Iterator[Part]:
    """The items of a benchmark in parts of about ``part_bytes``, dealt by hash; a text of more is a part's only one."""
    src = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") > 0)
    size = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // part_bytes))
    if n > 1:
        src = common.materialise(src.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")), "benchmark")
    for p in range(n):
        yield Part([(r["id"], r["text"]) for r in (src.where(F.col("part") == p) if n > 1 else src).collect()], window)


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_items: int = 2, with_spans: bool = False, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """``id, n_words, n_hit, n_items, items_sha256, contaminated`` and, if asked for, the hit ``spans`` of each row."""
    spark = docs.sparkSession
    common.arrow_limits(spark)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    todo = parts(benchmark, item_col, item_text_col, window, part_bytes)
    part, before = next(todo), []
    for following in todo:  # rows go on with what has been found so far: bits of words and names of items
        rows = src.mapInArrow(common.trimmed(_carry(spark.sparkContext.broadcast(part))), f"id {kind}, text string, hit binary, found array<string>")
        src, part, before = common.materialise(rows, "decontam"), following, ["hit", "found"]
    held = spark.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = held.value.automaton()
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = [_join(a.scan(t), *old) for t, *old in zip(texts, *(b.column(k).to_pylist() for k in range(2, b.num_columns)), strict=True)]
            names = [sorted(who) for _, _, who in rows]
            cols = [
                b.column(0),
                pa.array([n for n, _, _ in rows], pa.int64()),
                pa.array([0 if h is None else int(h.sum()) for _, h, _ in rows], pa.int64()),
                pa.array([len(x) for x in names], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
                pa.array([len(x) >= min_items for x in names], pa.bool_()),
            ]
            if with_spans:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                cols.append(pa.array([[] if h is None else [{"start": i, "end": j} for i, j in spans(t, h)] for t, (_, h, _) in zip(texts, rows, strict=True)], kind))
            yield pa.RecordBatch.from_arrays(cols, [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"][: len(cols)])

    more = ", spans array<struct<start:bigint,end:bigint>>" if with_spans else ""
    return src.select("id", "text", *before).mapInArrow(common.trimmed(run), f"`{id_col}` {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean{more}")


def _join(new: tuple[int, np.ndarray | None, set[str]], hit: bytes | None = None, found: list[str] | None = None) -> tuple[int, np.ndarray | None, set[str]]:
    """A scan's findings with those of earlier parts."""
    n, own, who = new
    if hit is not None:
        old = np.unpackbits(np.frombuffer(hit, np.uint8), count=n).astype(bool)
        own = old if own is None else own | old
    return n, own, who | set(found or ())


def _carry(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = held.value.automaton()
        for b in batches:
            rows = [_join(a.scan(t), *old) for t, *old in zip(*(b.column(k).to_pylist() for k in range(1, b.num_columns)), strict=True)]
            hits = pa.array([None if h is None else np.packbits(h).tobytes() for _, h, _ in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), hits, pa.array([sorted(who) for _, _, who in rows], pa.list_(pa.string()))], ["id", "text", "hit", "found"])

    return run


def hit_items(docs: DataFrame, part: Part, text_col: str = "text") -> Column:
    """A column with the number of items of a part that have a window in the text."""
    common.arrow_limits(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(part)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        a = held.value.automaton()
        return pd.Series([len(a.scan(t if isinstance(t, str) else None)[2]) for t in texts], dtype="int32")

    return count(F.col(text_col))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` without any window of any item, all columns kept. Null and wordless texts stay."""
    rest, todo = docs, parts(benchmark, item_col, item_text_col, window, part_bytes)
    part = next(todo)
    for following in todo:
        rest, part = common.materialise(rest.where(hit_items(rest, part, text_col) == 0), "decontam"), following
    return rest.where(hit_items(rest, part, text_col) == 0)
