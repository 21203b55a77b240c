"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are its hashed n-grams (n = 4 and 5, lower-cased UTF-8 bytes), each with the binary logarithm of one
more than its count, so that a form that a text repeats counts for more than one it has once. Each is scaled by
log((p_j / |p|) / (q_j / |q|)), where p and q are smoothed sums of these over texts of either label; a text's vector is
brought to unit length; logistic regression with a small L2 penalty is fitted to those vectors.

The classifier is fitted on at most ``max_rows`` labelled rows, those with the smallest hashes of doc_id. Every text is
scored whole. Labels, lang, source and doc_id are never inputs of a score.

Edge cases: a null or empty text is scored by the intercept alone; without labelled rows of both kinds the score is the
share of label 1 (0 without labels); labels that contradict each other for one doc_id count as 1; repeated rows repeat;
extra columns are ignored by ``scores`` and kept by ``reject_toxic``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, whole_text

BUCKET_BITS = 18
SIZES = (4, 5)
MAX_ROWS = 6_000
CHUNK = 250
THRESHOLD = 0.3
SEED = 71


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept out of training; a row without doc_id is not, but is never a labelled one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class NGrams:
    """Distinct n-gram buckets of a text and log2(1 + count) of each, without sorting: each bucket remembers where it was
    last seen."""

    def __init__(self, bits: int = BUCKET_BITS, sizes: tuple[int, ...] = SIZES):
        self.bits, self.sizes = bits, sizes
        self.last = np.zeros(1 << bits, np.int32)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
        found = []
        for n in self.sizes:
            m = len(data) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for i in range(n):
                h = (h ^ data[i : i + m]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x9E3779B97F4A7C15)
            found.append((h >> np.uint64(64 - self.bits)).astype(np.int32))
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        buckets = np.concatenate(found)
        order = np.arange(len(buckets), dtype=np.int32)
        self.last[buckets] = order
        at = self.last[buckets]
        return buckets[at == order], np.log2(1 + np.bincount(at, minlength=len(at))[at == order]).astype(np.float32)


class Model:
    """weights: by bucket, log-count ratio times coefficient; squares: of the ratios, for a text's length."""

    def __init__(self, weights: np.ndarray, squares: np.ndarray, intercept: float):
        self.weights, self.squares, self.intercept = weights.astype(np.float32), squares.astype(np.float32), float(intercept)

    def score(self, features: tuple[np.ndarray, np.ndarray]) -> float:
        z, (buckets, amount) = self.intercept, features
        if len(buckets):
            length = float((self.squares[buckets] * amount**2).sum(dtype=np.float64)) ** 0.5
            if length > 1e-6:
                z += float((self.weights[buckets] * amount).sum(dtype=np.float64)) / length
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(texts: list[str], labels: np.ndarray, bits: int = BUCKET_BITS, rounds: int = 40, smooth: float = 1.0, least: int = 3, penalty: float = 1e-5, rate: float = 3.0) -> Model:
    width = 1 << bits
    y = np.asarray(labels, np.float64)
    share = float(y.mean()) if len(y) else 0.0
    if not len(y) or share in (0.0, 1.0):
        odds = np.log((share + 1e-9) / (1 - share + 1e-9))
        return Model(np.zeros(width), np.zeros(width), odds)
    grams, parts = NGrams(bits), []
    p, q, seen = np.full(width, smooth), np.full(width, smooth), np.zeros(width)
    for lo in range(0, len(texts), CHUNK):  # buckets, how many each text has, amounts: what is worked on at once stays small
        each = [grams(t) for t in texts[lo : lo + CHUNK]]
        at, amount = (np.concatenate(x) for x in zip(*each, strict=True))
        sizes = np.array([len(x) for x, _ in each], np.int32)
        mine = np.repeat(y[lo : lo + CHUNK], sizes)
        p += np.bincount(at, weights=mine * amount, minlength=width)
        q += np.bincount(at, weights=(1 - mine) * amount, minlength=width)
        seen += np.bincount(at, minlength=width)
        parts.append((slice(lo, lo + len(each)), at, sizes, amount))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[seen < least] = 0
    for rows, at, sizes, value in parts:  # amounts become values where they are
        row = np.repeat(np.arange(len(sizes)), sizes)
        value *= ratio[at].astype(np.float32)
        length = np.sqrt(np.bincount(row, weights=value.astype(np.float64) ** 2, minlength=len(y[rows])) + 1e-9)
        value /= length[row].astype(np.float32)
    w, b = np.zeros(width), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for k in range(1, rounds + 1):  # gradient steps with adaptive moments
        gw, gb = penalty * w, 0.0
        for rows, at, sizes, value in parts:
            row = np.repeat(np.arange(len(sizes)), sizes)
            z = np.bincount(row, weights=value * w[at], minlength=len(y[rows])) + b
            g = (1 / (1 + np.exp(-z)) - y[rows]) / len(y)
            gw += np.bincount(at, weights=g[row] * value, minlength=width)
            gb += float(g.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step, scale = rate / (1 - 0.9**k), 1 - 0.999**k
        w -= step * m / (np.sqrt(v / scale) + 1e-8)
        b -= step * mb / (np.sqrt(vb / scale) + 1e-8)
    return Model(w * ratio, ratio**2, b)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on a bounded sample of labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    chosen = known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(max_rows)
    ids = chosen.collect()
    local = docs.sparkSession.createDataFrame([(r["doc_id"], int(r["y"])) for r in ids], "doc_id long, y int")
    rows = docs.select("doc_id", whole_text().alias("text")).join(few(local, len(ids)), "doc_id").select("doc_id", "text", "y")
    if not ids:
        return fit([], np.zeros(0))
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches).sort_by("doc_id")  # sums in one order: reruns agree
        model = fit(table.column("text").to_pylist(), table.column("y").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.squares.tobytes()]), pa.array([model.intercept])], names=["weights", "squares", "intercept"])

    # the sample is bounded by max_rows: one task fits it, so that no texts reach the driver
    made = rows.repartition(1).mapInArrow(run, "weights binary, squares binary, intercept double").first()
    if made is None:  # no labelled document is among docs
        return fit([], np.zeros(0))
    return Model(np.frombuffer(made["weights"], np.float32), np.frombuffer(made["squares"], np.float32), made["intercept"])


def with_scores(rows: DataFrame, model: Model) -> DataFrame:
    """row and score of each row of (row, text); whole texts go through Arrow once."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        grams = NGrams()
        for batch in batches:
            score = pa.array([shared.value.score(grams(t)) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), score], names=["row", "score"])

    return rows.select("row", "text").mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    made = with_scores(docs.select(F.struct("doc_id").alias("row"), whole_text().alias("text")), model)
    return made.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold."""
    made = with_scores(docs.select(F.struct(*docs.columns).alias("row"), whole_text().alias("text")), model)
    return made.where(F.col("score") < threshold).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return scores(docs, train(docs, table(spark, sf_dir, "labels")))
