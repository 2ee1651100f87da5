"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Class means and covariances come from sums that tasks add up; covariances are shrunk towards their own
diagonal and the pooled matrix; a score is the logistic of the difference of two log densities, each a
Mahalanobis distance by a cached Cholesky factor.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

_CLASSES = [
    bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"-", b"!?", bytes(c for c in range(33, 127) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c in b".,;:'\"-!?")),
]

FEATURES = (
    "length words word_length spread capital digit line_length point shout symbol repeat distinct top worst_symbol worst_shout worst_repeat short sentence"
).split()


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text: log counts, square roots of shares, and the worst line's shares.

    Shares have a constant added below the line, so that a short text's few words do not make extreme ones.
    Null and empty texts have zeros throughout.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    count = [size - len(raw.translate(None, keep)) for keep in _CLASSES]
    capital, _, digit, _, line, point, shout, symbol = count
    lengths = np.fromiter(map(len, words), np.int64, n)
    repeat = sum(map(bytes.__eq__, words, words[1:]))
    distinct = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    worst = [0.0, 0.0, 0.0]
    for own in raw.split(b"\n"):
        parts = own.split()
        if len(parts) < 3:
            continue
        k = len(parts)
        worst[0] = max(worst[0], (len(own) - len(own.translate(None, _CLASSES[7]))) / (k + 5))
        worst[1] = max(worst[1], (len(own) - len(own.translate(None, _CLASSES[6]))) / (k + 5))
        worst[2] = max(worst[2], sum(map(bytes.__eq__, parts, parts[1:])) / (k + 5))
    root = lambda x: float(np.sqrt(x))
    return [
        float(np.log1p(size)), float(np.log1p(n)), float(np.log(lengths.mean())), float(np.log1p(lengths.std())),
        root(capital / (size + 150)), root(digit / (size + 150)), float(np.log1p(n / (line + 1))),
        root(point / (n + 20)), root(shout / (n + 20)), root(symbol / (n + 20)), root(repeat / (n + 20)),
        float(np.log((len(distinct) + 20) / (n + 20)) / np.log(n + 20)), root(max(distinct.values()) / (n + 20)),
        *map(root, worst), root((lengths <= 2).sum() / (n + 20)), float(np.log1p(n / (raw.count(b".") + 1))),
    ]


def matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(FEATURES))


@dataclass
class Quadratic:
    """Per class: log prior, mean, inverse Cholesky factor, log determinant."""

    prior: list[float]
    mean: list[np.ndarray]
    factor: list[np.ndarray]
    logdet: list[float]
    scale: tuple

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.scale[0]) / self.scale[1]
        density = []
        for prior, mean, factor, logdet in zip(self.prior, self.mean, self.factor, self.logdet):
            y = (x - mean) @ factor.T
            density.append(prior - 0.5 * (logdet + (y * y).sum(axis=1)))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def solve(n: list[float], total: list[np.ndarray], square: list[np.ndarray], shrink: float, pool: float) -> Quadratic:
    """The discriminant from counts, sums and sums of products of the two classes.

    Each covariance is (1 - pool) of its own and ``pool`` of both together, then ``shrink`` of its diagonal's
    mean is mixed in. A class without rows takes the pooled mean and matrix and no prior to speak of.
    """
    d = len(total[0])
    all_n, all_sum, all_sq = max(sum(n), 1.0), sum(total), sum(square)
    centre = all_sum / all_n
    width = np.sqrt(np.maximum(np.diag(all_sq) / all_n - centre**2, 1e-12))
    width[width < 1e-5] = 1.0
    means = [(t / k if k else centre) for t, k in zip(total, n)]
    within = [(s / k - np.outer(m, m) if k else np.zeros((d, d))) / np.outer(width, width) for s, k, m in zip(square, n, means)]
    pooled = sum(k * c for k, c in zip(n, within)) / all_n
    factors, logdets = [], []
    for k, cov in zip(n, within):
        mix = (1 - pool) * cov + pool * pooled if k > d else pooled
        mix = (1 - shrink) * mix + shrink * max(float(np.trace(mix)) / d, 1e-3) * np.eye(d)
        lower = np.linalg.cholesky(mix)
        factors.append(np.linalg.inv(lower))
        logdets.append(2 * float(np.log(np.diag(lower)).sum()))
    prior = [float(np.log((k + 1) / (all_n + 2))) for k in n]
    return Quadratic(prior, [(m - centre) / width for m in means], factors, logdets, (centre, width))


def measure(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc``, x: the statistics) of each row. No shuffle."""
    common.small_batches(documents.sparkSession)
    rows = documents.select(F.col(doc).alias("d"), F.col(text).alias("t"))

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["d", "x"])
        common.give_back()

    return rows.mapInArrow(run, f"d {rows.schema['d'].dataType.simpleString()}, x array<double>").withColumnRenamed("d", doc)


def fit(measured: DataFrame, labels: DataFrame, doc: str = "doc_id", label: str = "quality", shrink: float = 0.02, pool: float = 0.5) -> Quadratic:
    """Fitted on every measured row with a label 0 or 1 among the given ``labels``; repeated labels count as often as they stand.

    Statistics, not texts, meet the labels. A task returns counts, sums and products of each class; they are
    added up on the cluster, and the driver gets one row for each class and entry of the matrix:
    2 * (1 + d + d * d) numbers, whatever the input.
    """
    rows = measured.select(F.col(doc).alias("d"), "x").join(
        labels.select(F.col(doc).alias("d"), F.col(label).cast("int").alias("y")).where("y IN (0, 1)"), "d"
    ).select("x", "y")
    d = len(FEATURES)

    def run(batches):
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = np.array(batch.column(0).to_pylist(), float).reshape(-1, d), np.array(batch.column(1).to_pylist(), int)
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        at = np.arange(sums.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], len(at)), pa.int32()), pa.array(np.tile(at, 2), pa.int32()), pa.array(sums.ravel())], ["y", "i", "v"])

    found = np.zeros((2, 1 + d + d * d))
    for row in rows.mapInArrow(run, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect():
        found[row.y, row.i] = row.v
    return solve(list(found[:, 0]), list(found[:, 1 : 1 + d]), [m.reshape(d, d) for m in found[:, 1 + d :]], shrink, pool)


def score(measured: DataFrame, model: Quadratic, doc: str = "doc_id") -> DataFrame:
    """``doc``, score (0 to 1, higher: label 1 likelier), predicted, for each measured row. No shuffle."""
    rows = measured.select(F.col(doc).alias("d"), "x")

    def run(batches):
        for batch in batches:
            s = model.scores(np.array(batch.column(1).to_pylist(), float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["d", "score", "predicted"])

    return rows.mapInArrow(run, f"d {rows.schema['d'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("d", doc)


def keep_good(documents: DataFrame, model: Quadratic, text: str = "text") -> DataFrame:
    """The rows of ``documents`` whose text scores 0.5 or more, all columns as they were. No shuffle."""
    common.small_batches(documents.sparkSession)
    at = documents.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(matrix(batch.column(at).to_pylist())) >= 0.5))

    return documents.mapInArrow(run, documents.schema)


def held_out(doc: str = "doc_id"):
    """Rows that the fit never sees. A null id is in no fold that learns, and not held out."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(documents: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, held_out, score, predicted for each row of ``documents``; learnt from labels of the other folds only.

    Repeated documents stay; an empty table gives no rows, and without labels every score is that of equal
    classes. Other columns are not read, so none can clash.
    """
    measured = common.written(measure(documents, doc, text), "statistics")
    model = fit(measured, labels.where(~held_out(doc)), doc)
    return score(measured, model, doc).select(doc, held_out(doc).alias("held_out"), "score", "predicted")


def query(spark, sf_dir):
    return classify(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "labels", "doc_id", "quality"))


SQL = None
