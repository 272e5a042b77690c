"""Language identification by the nearest of several centroids per language.

Byte n-grams (1 to 3) of the lower-cased letters are hashed, weighted by TF-IDF and normalised; spherical k-means
gives each language several centroids; a text gets the language of the centroid with the largest cosine. A text that
is far from every centroid (cosine below ``reject_below``) is rejected, as is one that has no letter. Unless given,
``reject_below`` is half the cosine that all but one in a thousand of the training rows reach with their own language,
0.2 at most.

The model is fitted on a bounded sample of labelled rows (``per_lang`` a language, the rows with the smallest id
hashes); prediction reads whole texts and nothing else. The model's size is fixed by ``DIM``, ``k`` and
``MOST_LANGS``, so broadcasting it is bounded.

Edge cases: null text or text without a letter gives ``und``, score 0 and a rejection; very long texts are read whole;
of centroids at the same distance the first counts, in the order of languages; rows with a null id or null label are
predicted but never learned from; an empty training set gives ``und`` for all; repeated rows get equal results; an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIM, MOST_LANGS = 1 << 14, 512
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of a whole text and how often each occurs."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = b[:-1] | b[1:] << np.uint32(8)
    three = two[:-1] | b[2:] << np.uint32(16)
    codes = np.concatenate((b | np.uint32(1 << 24), two | np.uint32(2 << 24), three | np.uint32(3 << 24)))
    counts = np.bincount((codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14), minlength=DIM)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    langs: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray  # DIM x number of centroids
    reject_below: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine with its nearest centroid, and whether that is rejected."""
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        at, n = grams(text)
        v = np.sqrt(n).astype(np.float32) * self.idf[at]
        cosines = (v / np.sqrt(v @ v)) @ self.centroids[at]
        best = int(np.argmax(cosines))
        score = min(1.0, max(0.0, float(cosines[best])))
        return self.langs[best], score, score < self.reject_below


def _cluster(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit rows; starts from evenly spaced rows, so equal input gives equal output."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[own == j].sum(0) for j in range(len(c))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 600, k: int = 4, reject_below: float | None = None) -> Model:
    """Fit on at most ``per_lang`` rows of each language, chosen by the hash of their id."""
    spark = labelled.sparkSession
    common.arrow_limits(spark)
    src = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in src.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not counts:
        return Model([], np.zeros(DIM, np.float32), np.zeros((DIM, 0), np.float32), reject_below or 0.0)
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(scale * min(1.0, 1.25 * (per_lang + 20) / n)))])
    sample = src.withColumn("h", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(scale))).where(F.col("h") < share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep, at, n = b.column(1).to_pylist(), [], [], []
            for i, t in enumerate(texts):
                if has_letter(t):
                    x, y = grams(t)
                    keep.append(i)
                    at.append(x.astype(np.uint16).tobytes())
                    n.append(y.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(j).take(pa.array(keep, pa.int64())) for j in (0, 2, 3)] + [pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["id", "lang", "h", "at", "n"])

    kind = src.schema["id"].dataType.simpleString()
    rows = sample.select("id", "text", "lang", "h").mapInArrow(common.trimmed(run), f"id {kind}, lang string, h bigint, at binary, n binary").collect()
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], str(r["id"]))):
        by.setdefault(r["lang"], []).append((np.frombuffer(bytes(r["at"]), np.uint16), np.frombuffer(bytes(r["n"]), np.uint32)))
    by = {lang: x[:per_lang] for lang, x in by.items()}
    df = np.zeros(DIM)
    for x in by.values():
        for at, _ in x:
            df[at] += 1
    total = sum(map(len, by.values()))
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    langs, cents, near = [], [], []
    for lang, x in by.items():
        dense = np.zeros((len(x), DIM), np.float32)
        for i, (at, n) in enumerate(x):
            dense[i, at] = np.sqrt(n) * idf[at]
        dense /= np.linalg.norm(dense, axis=1, keepdims=True)
        c = _cluster(dense, k)
        langs += [lang] * len(c)
        cents.append(c)
        near.append((dense @ c.T).max(1))
    if reject_below is None:
        reject_below = min(0.2, 0.5 * float(np.quantile(np.concatenate(near), 0.001))) if near else 0.0
    return Model(langs, idf, np.ascontiguousarray(np.concatenate(cents).T) if cents else np.zeros((DIM, 0), np.float32), reject_below)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A struct column ``lang string, score double, rejected boolean`` computed from the text alone."""
    common.arrow_limits(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t if isinstance(t, str) else None) for t in texts], columns=["lang", "score", "rejected"])

    return run(F.col(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
