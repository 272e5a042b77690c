"""Token-id output: Parquet list columns with dictionary or delta encoding, chosen row groups and page indexes.

Rows are dealt to parts by document id, so that part k holds smaller ids than part k+1 and each part is one file.
Each row keeps its token offset within the part; with the parts' totals that gives its offset in the whole corpus,
without reading a single id. Row groups, pages and their indexes are small enough to fetch a few documents.

Edge cases: a null text has no ids of its own (just the end id); null ids come first; rows with the same id stay
neighbours, in the order of their texts' hashes, and are spread over several parts where one id has many rows; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

#: At least so many documents a part, and so many parts at most: their totals fit in one small window and broadcast.
ROWS_A_PART, MOST_PARTS = 8192, 20_000
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


def by_ranges(docs: DataFrame, id_col: str, text_col: str, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """``id, text, part`` dealt by ranges of the id and sorted within them; the bounds come from the id column alone."""
    n = docs.count()
    parts = max(1, min(MOST_PARTS, -(-n // rows_a_part)))
    marks = [(k + 1) / parts for k in range(parts - 1)]
    bounds = docs.agg(F.percentile_approx(F.col(id_col), marks, 20 * parts).alias("b")).first()["b"] if marks else None
    edges = np.array(bounds or [], dtype=np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, tie: pd.Series) -> pd.Series:
        values = ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64)
        low, high = np.searchsorted(edges, values, "left"), np.searchsorted(edges, values, "right")
        place = low + (tie.to_numpy(np.float64) * (high - low + 1)).astype(np.int64)
        return pd.Series(np.minimum(place, high).astype(np.int32))

    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), tie.alias("tie"))
    unit = F.col("tie") / F.lit(2.0**64) + F.lit(0.5)
    dealt = src.withColumn("part", part_of("id", unit) if parts > 1 else F.lit(0))
    return dealt.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("part"), F.col("id").asc_nulls_first(), "tie").drop("tie")


def write_tokens(docs: DataFrame, out: str, path: str, pattern: str | None = None, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", encoding: str = "delta", row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10, rows_a_part: int = ROWS_A_PART) -> None:
    """Encode every whole text and write ``doc_id, part, start_in_part, n_tokens, ids`` to ``out``."""
    common.arrow_limits(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part, before = bpe.codec(path, pattern), None, 0
        for b in batches:
            flat, at = c.encode_flat(b.column(1))
            if end_id is not None:
                flat, at = np.insert(flat, at[1:], end_id), at + np.arange(len(at))
            lengths = np.diff(at)
            starts = np.empty(len(lengths), np.int64)
            for k, (p, n) in enumerate(zip(b.column(2).to_pylist(), lengths.tolist(), strict=True)):
                part, before = (p, before) if p == part else (p, 0)
                starts[k] = before
                before += n
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(starts), pa.array(lengths), ids], ["doc_id", "part", "start_in_part", "n_tokens", "ids"])

    rows = by_ranges(docs, id_col, text_col, rows_a_part).mapInArrow(common.trimmed(run), "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, ids array<int>")
    size = {"parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.write-checksum.enabled": "true"}
    rows.write.options(**size, **ENCODINGS[encoding]).parquet(out)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of written files; filters and column choices reach the Parquet pages."""
    rows = spark.read.parquet(out)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # at most MOST_PARTS rows
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def digest(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of what ``read_tokens`` gives."""
    common.arrow_limits(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            ids = b.column(3)
            flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(common.trimmed(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
