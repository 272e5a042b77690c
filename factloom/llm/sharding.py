"""Sharding by weighted rendezvous hashing of stable record keys, in DataFrame functions only.

Each shard scores a key with ``-weight / ln(u)``, where u in (0, 1) comes from an MD5 of key and shard number; the
largest score wins, ties going to the smaller shard. A new shard only takes rows to itself; a weight changes a
shard's share alone. Law ``key``: key and shards decide, nothing else.

Slots number a shard's rows from 0 without gaps. Rows are numbered within cells (shard and hash bucket), and a small
table of cell counts gives each cell's first slot, so no task sees a whole shard.

Edge cases: a null text has size 1 and checksum 0; rows with a null key all score as the key ``null``; rows with equal
keys stay in one shard and are spread over its cells by their checksum; fully equal rows get neighbouring slots in
any order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of a cell's hash: 256 cells a shard. Shards times cells bounds the broadcast of cell counts.
CELL_DIGITS, MOST_CELLS = 2, 1 << 20


def _unit(key: Column, salt: str) -> Column:
    """Key and salt to a number strictly between 0 and 1, from 52 bits of their MD5."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{salt}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard (from 0) whose weighted score for ``key`` is the largest."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("each shard needs a positive weight")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [F.struct((F.lit(float(w)) / -F.log(_unit(text, str(s)))).alias("score"), F.lit(-s).alias("s")) for s, w in enumerate(weights)]
    return -(F.greatest(*scores)["s"] if len(scores) > 1 else scores[0]["s"])


def assign(docs: DataFrame, weights: list[float], grown: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", cell_digits: int = CELL_DIGITS) -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard`` of each row.

    ``grown`` are the weights after a change of the shard count; by default one more shard of the mean weight.
    """
    if len(weights) * 16**cell_digits > MOST_CELLS:
        raise ValueError(f"shards times cells must not exceed {MOST_CELLS}")
    if not weights:
        raise ValueError("there is no shard")
    grown = grown or [*weights, sum(weights) / len(weights)]
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc"),
        shard_of(F.col(id_col), weights).alias("shard"),
        shard_of(F.col(id_col), grown).alias("grown"),
    )
    mark = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.col("crc").cast("string"))
    rows = rows.withColumn("cell", F.substring(F.md5(mark.cast("binary")), 1, cell_digits))
    counts = rows.groupBy("shard", "cell").count()
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "crc", "size"))
    # at most MOST_CELLS short rows
    out = rows.withColumn("n", number).join(F.broadcast(first), ["shard", "cell"])
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        (F.col("first") + F.col("n") - 1).alias("slot"), F.col("grown").alias("grown_shard"),
    )
