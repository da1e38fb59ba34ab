"""Quality scores: random Fourier features, ridge regression by normal equations, isotonic calibration.

Statistics of each document are standardised and mapped to cosines of random projections, whose inner products approximate
a Gaussian kernel. Each partition of labelled rows sums its part of the normal equations, of a fixed size whatever the
rows; the sums are added on Spark and solved once. The raw scores of labelled rows that the equations left out, counted in fixed
bins, give a monotone map to probabilities (pool adjacent violators). All labelled rows outside the held-out fold are used: of
the other four, three for the ridge and one for the map.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, table
from tessera.llm.quality_rules import MEASURES, measure
from tessera.llm.words import Words, bounds, no_nulls, repeats, slices

COSINES, WIDTH, RIDGE, SEED, BINS = 256, 2.0, 1e-3, 20240101, 1000
FOLDS, THRESHOLD = 5, 0.3
#: The fold whose rows are held out, and the one that calibrates.
HELD_OUT, CALIBRATES = 0, 4
FEATURES = ("log_words", "word_chars", "symbols", "dup_lines", "repeat_words", "distinct_words", "equal_neighbours", "upper", "digits", "stops", "wide", "log_words_per_line")
_UPPER, _ALPHA, _DIGIT, _STOP = (np.zeros(256, bool) for _ in range(4))
_UPPER[0x41:0x5B] = True
_ALPHA[list(range(0x41, 0x5B)) + list(range(0x61, 0x7B))] = True
_DIGIT[0x30:0x3A] = True
_STOP[list(b".,;:!?")] = True


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; all are bounded or logarithms, and 0 where they would be 0 / 0."""
    texts = no_nulls(texts)
    measured = measure(texts)
    m = {name: measured.field(i).to_numpy().astype(float) for i, name in enumerate(MEASURES)}
    rest = []
    for a, b in slices(texts):
        w = Words(texts.slice(a, b - a), lower=True)
        raw = bounds(texts.slice(a, b - a))[0]
        n = np.maximum(np.diff(w.at), 1)
        per = lambda mask, w=w: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.off])
        _, later = repeats(w.code, w.doc)
        same = np.zeros(len(w.code), bool)
        same[1:] = (w.code[1:] == w.code[:-1]) & (w.doc[1:] == w.doc[:-1])
        size = np.maximum(np.diff(w.off), 1)
        count = lambda mask, w=w: np.bincount(w.doc[mask], minlength=w.docs)
        rest.append([1 - count(later) / n, count(same) / n, per(_UPPER[raw]) / np.maximum(per(_ALPHA[raw]), 1), per(_DIGIT[raw]) / size, per(_STOP[raw]) / n, per(raw >= 0x80) / size])
    if not rest:
        return np.zeros((0, len(FEATURES)))
    distinct, neighbours, upper, digits, stops, wide = (np.concatenate(x) for x in zip(*rest, strict=True))
    n, lines = np.maximum(m["n_words"], 1), np.maximum(m["n_lines"], 1)
    return np.stack([
        np.log1p(m["n_words"]), np.minimum(m["word_chars"] / n, 30), np.minimum(m["n_symbols"] / n, 3), m["n_dup_lines"] / lines, m["n_repeat_words"] / n,
        distinct, neighbours, upper, digits, np.minimum(stops, 3), wide, np.log1p(m["n_words"] / lines),
    ], axis=1)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pa.Array) -> pa.Array:
    x = features(texts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))


@dataclass(frozen=True)
class Model:
    """What scoring needs; its size doesn't depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    edges: np.ndarray
    values: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(0, 1 / WIDTH, (len(FEATURES), COSINES))
        b = rng.uniform(0, 2 * np.pi, COSINES)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / COSINES) * np.cos(((x - self.mean) / self.scale) @ w + b)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.cosines(x) @ self.beta, 0, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.values)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(FEATURES))


def pool(edges: np.ndarray, hits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the non-decreasing means closest to hits / counts, at the mean edge of each pool."""
    pools: list[list[float]] = []
    for e, h, n in zip(edges, hits, counts, strict=True):
        pools.append([e * n, h, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(described: DataFrame, labels: DataFrame, label_col: str) -> Model:
    """A model from described (doc_id, x) and labels (doc_id, label_col in 0/1); null labels and ids are left out, and several labels
    of one id count as their mean.

    To the driver go one row of moments, COSINES + 1 rows of the summed equations and at most BINS + 1 counts.
    """
    k, dim = len(FEATURES), COSINES + 1
    moments = described.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(k)])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(k)])
    model = Model(mean, scale, np.zeros(dim), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    y = F.col(f"`{label_col}`").cast("double")
    known = labels.select(F.col("doc_id").alias("of"), y.alias("y")).where("y is not null").groupBy("of").agg(F.avg("y").alias("y"))
    labelled = described.join(known, F.col("doc_id") == F.col("of")).select("x", "y", fold(F.col("doc_id")).alias("fold")).where(F.col("fold") != HELD_OUT)
    train = labelled.where(F.col("fold") != CALIBRATES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim + 2))
        for b in batches:
            z = model.cosines(_matrix(b["x"]))
            total[:, :dim] += z.T @ z
            total[:, dim] += z.T @ b["y"].to_numpy()
            total[0, dim + 1] += len(z)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(list(total))], names=["i", "row"])

    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("row", T.ArrayType(T.DoubleType()))])
    each = train.mapInArrow(sums, schema).select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    whole = np.zeros((dim, dim + 2))
    for r in each.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("row")).collect():
        whole[r["i"]] = [c["v"] for c in r["row"]]
    rows = whole[0, dim + 1]
    if not rows:
        return model
    beta = np.linalg.solve(whole[:, :dim] + RIDGE * rows * np.diag(np.r_[0, np.ones(COSINES)] / COSINES) + 1e-9 * np.eye(dim), whole[:, dim])
    model = Model(mean, scale, beta, model.edges, model.values)
    bins = labelled.where(F.col("fold") == CALIBRATES).select(F.round(_raw(model)("x") * BINS).cast("int").alias("bin"), "y").groupBy("bin").agg(F.sum("y").alias("hits"), F.count("*").alias("n")).collect()
    if not bins:
        return Model(mean, scale, beta, model.edges, model.edges)
    bins.sort(key=lambda r: r["bin"])
    edges, values = pool(np.array([r["bin"] / BINS for r in bins]), np.array([r["hits"] for r in bins]), np.array([r["n"] for r in bins], float))
    return Model(mean, scale, beta, edges, values)


def _udf(f):
    @F.arrow_udf(T.DoubleType())
    def apply(x: pa.Array) -> pa.Array:
        return pa.array(f(_matrix(x)))

    return apply


def _raw(model: Model):
    return _udf(model.raw)


def score(docs: DataFrame, labels: DataFrame, scratch: Scratch, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs.

    Null and empty texts are scored by their statistics, which are all zero. A null id is never held out and never learnt
    from; repeated rows of documents are scored, and learnt from, as often as they occur. Without labels every score is 0.5. Other
    columns of either table are ignored. The texts are read once; what is kept of them is a dozen numbers each.
    """
    x = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _features(F.col(f"`{text_col}`").cast("string")).alias("x"))
    x = scratch.write(x)
    model = fit(x, labels.select(F.col(f"`{label_id_col}`").alias("doc_id"), F.col(f"`{label_col}`")), label_col)
    out = x.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), _udf(model.score)("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "quality-classifier")
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), scratch)
