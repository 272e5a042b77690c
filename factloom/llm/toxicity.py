"""Toxicity by a classifier chain of linear models.

Categories are predicted in order. Model k sees the words of the text and the log-odds of categories 1 to k-1; while
training, those log-odds come from models that never saw the row (out-of-fold), so later models learn from the same
kind of input that they get when predicting. The vocabulary has every word whose presence depends on a category by a
G-test at the level ``LEAST_G``, over the whole sample; there is no cap on their number. A model's penalty on a word's
weight is ``PENALTY`` times the largest G statistic over the word's own, so the many words that only just pass hardly
count.

The sample is bounded (``most_labelled`` rows, those with the smallest id hashes), and so are the vocabulary found in
it and the broadcast model; prediction reads whole texts.

Edge cases: null and empty texts have no words and get the base rates; very long texts are read whole, each distinct
word counting once; a document with several label rows counts as positive if any row says so; null labels and null ids
are skipped; a repeated id gives one training row for each row of documents; words that tie in the G-test are ordered by
their bytes, which changes no prediction; without any labelled row all probabilities are 0; repeated rows get equal
results; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .decontam import words

#: Categories in chain order, each a SQL condition over the columns of ``labels``.
CHAIN = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
FOLDS = 5
#: Least value of the G statistic of a chosen word; of words that don't matter, one in a thousand reaches it.
LEAST_G = 10.83
#: Penalties: of the word with the largest G statistic, and of an earlier category's log-odds.
PENALTY, CHAIN_PENALTY = 0.03, 0.1


@dataclass
class Model:
    names: list[str]
    vocab: dict[bytes, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)  # words, then earlier categories, then bias

    def predict(self, text: str | None) -> list[float]:
        if not self.weights:
            return [0.0] * len(self.names)
        at = [self.vocab[w] for w in self.vocab.keys() & set(words(text))]
        logits: list[float] = []
        n = len(self.vocab)
        for w in self.weights:
            logits.append(float(w[at].sum() + np.dot(w[n : n + len(logits)], logits) + w[-1]))
        return [1 / (1 + np.exp(-min(30.0, max(-30.0, z)))) for z in logits]


def _logit(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, dim: int, l2: np.ndarray, rounds: int = 250) -> np.ndarray:
    """Logistic regression over sparse 0/1 words and dense extra columns, by accelerated scaled gradients; ``l2`` is the
    penalty of each word."""
    n, k = len(y), extra.shape[1]
    l2 = np.concatenate((l2, np.full(k, CHAIN_PENALTY)))
    scale = np.concatenate((np.bincount(cols, minlength=dim), (extra**2).sum(0), [n])) / 4 + np.append(l2, 0.0)
    w = np.zeros(dim + k + 1)
    p = min(max(y.mean(), 1e-4), 1 - 1e-4)
    w[-1] = np.log(p / (1 - p))
    v, t = w.copy(), 1.0
    per_row = max(1.0, np.bincount(rows, minlength=n).max(initial=0) + k + 1.0)
    step = 1 / min(per_row, 12.0)
    for _ in range(rounds):
        z = np.bincount(rows, weights=v[cols], minlength=n) + extra @ v[dim:-1] + v[-1]
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.concatenate((np.bincount(cols, weights=r[rows], minlength=dim), r @ extra, [r.sum()]))
        g[:-1] += l2 * v[:-1]
        move = step * g / scale
        nxt, t1 = v - move, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = nxt + (t - 1) / t1 * (nxt - w), nxt, t1
        if np.abs(move).max() < 1e-5:
            break
    return w


def _margin(w: np.ndarray, rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, n: int, dim: int) -> np.ndarray:
    return np.bincount(rows, weights=w[cols], minlength=n) + extra @ w[dim:-1] + w[-1]


def fit_chain(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, fold: np.ndarray, dim: int, penalty: np.ndarray | None = None) -> list[np.ndarray]:
    """Weights for each column of ``labels``; row i has word j for each (rows, cols) pair (i, j). ``penalty`` has one
    for each word and column."""
    penalty = np.full((dim, labels.shape[1]), CHAIN_PENALTY) if penalty is None else penalty
    n, out, extra = len(labels), [], np.zeros((len(labels), 0))
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        out.append(_logit(rows, cols, extra, y, dim, penalty[:, k]))
        if k + 1 < labels.shape[1]:
            oof = np.zeros(n)
            for f in range(FOLDS):
                inside, keep = fold != f, fold[rows] != f
                number = np.cumsum(inside) - 1
                if inside.any() and not inside.all():
                    w = _logit(number[rows[keep]], cols[keep], extra[inside], y[inside], dim, penalty[:, k])
                    oof[~inside] = _margin(w, rows, cols, extra, n, dim)[~inside]
            extra = np.column_stack((extra, oof))
    return out


def fit(docs: DataFrame, labels: DataFrame, chain: dict[str, str] = CHAIN, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = 20_000, least_g: float = LEAST_G) -> Model:
    """Fit on at most about ``most_labelled`` labelled documents, chosen by the hash of their id."""
    spark = docs.sparkSession
    common.arrow_limits(spark)
    names, scale = list(chain), 1 << 30
    flags = [F.max(F.coalesce(F.expr(sql), F.lit(False)).cast("int")).alias(f"y{k}") for k, sql in enumerate(chain.values())]
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*flags)
    total = known.count()
    share = int(scale * min(1.0, most_labelled / max(total, 1)))
    # about most_labelled short rows, so the broadcast is bounded
    chosen = F.broadcast(known.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(scale)) < share))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [sorted(set(words(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w, pa.list_(pa.binary())), *b.columns[2:]], ["id", "words", *b.schema.names[2:]])

    kind = src.schema["id"].dataType.simpleString()
    ys = [f"y{k}" for k in range(len(names))]
    held = common.materialise(src.select("id", "text", *ys).mapInArrow(common.trimmed(split), f"id {kind}, words array<binary>, {', '.join(f'{y} int' for y in ys)}"), "toxic-sample")
    n, *pos = held.agg(F.count("*"), *[F.coalesce(F.sum(y), F.lit(0)) for y in ys]).first()
    if not n:
        return Model(names)
    by_word = held.select(F.explode("words").alias("w"), *ys).groupBy("w").agg(F.count("*").alias("df"), *[F.sum(y).alias(y) for y in ys])
    tests: dict[str, Column] = {}
    for y, p in zip(ys, pos, strict=True):

        def part(seen: Column, expected: Column) -> Column:
            return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

        a, df = F.col(y).cast("double"), F.col("df").cast("double")
        cells = [(a, df * p / n), (df - a, df * (n - p) / n), (p - a, (n - df) * p / n), (n - p - df + a, (n - df) * (n - p) / n)]
        g = 2 * sum((part(s, F.greatest(e, F.lit(1e-9))) for s, e in cells), F.lit(0.0))
        tests[f"g_{y}"] = F.round(g, 9)
    matter = by_word.select("w", *[g.alias(name) for name, g in tests.items()]).where(F.greatest(*tests, F.lit(0.0)) >= least_g)
    # as many as the bounded sample has words that matter
    chosen_words = sorted((bytes(r["w"]), *r[1:]) for r in matter.collect()) or [(b"", *[0.0] * len(names))]
    vocab = {r[0]: i for i, r in enumerate(chosen_words)}
    g = np.maximum(np.array([r[1:] for r in chosen_words], float), 1.0)
    penalty = PENALTY * g.max(0) / g
    words_held = spark.sparkContext.broadcast(vocab)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = words_held.value
        for b in batches:
            at = [np.array([v[w] for w in ws if w in v], np.int32).tobytes() for ws in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.binary()), *b.columns[2:]], ["id", "at", *b.schema.names[2:]])

    got = held.mapInArrow(common.trimmed(number), f"id {kind}, at binary, {', '.join(f'{y} int' for y in ys)}").collect()
    got.sort(key=lambda r: (r["id"], bytes(r["at"])))
    lists = [np.frombuffer(bytes(r["at"]), np.int32) for r in got]
    rows, cols = np.repeat(np.arange(len(got)), [len(x) for x in lists]), np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int64)
    y = np.array([[r[c] for c in ys] for r in got])
    # copies of a text share a fold, else a fold would be predicted from its own copies
    fold = np.array([zlib.crc32(bytes(r["at"])) % FOLDS for r in got])
    return Model(names, vocab, fit_chain(rows, cols, y, fold, len(vocab), penalty))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A struct column with one probability for each category, computed from the whole text."""
    common.arrow_limits(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = model.names

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t if isinstance(t, str) else None) for t in texts], columns=names)

    return run(F.col(text_col))
