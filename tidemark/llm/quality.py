"""Quality scores by a regularised quadratic discriminant.

Statistics of a document are turned into logarithms and shares. Each class gets a mean and a covariance,
shrunk towards the pooled covariance and towards its own diagonal; a score is the logistic of the
difference of the two log densities, from Mahalanobis distances through Cholesky factors that are computed
once when the model is made.

The sums behind the means and covariances run over all labelled rows in Spark; only 2 x (d + d*d) sums reach
the driver. A label other than 0 or 1 is ignored, several labels of one document count each, a null or
empty text has statistics 0 and is scored like any other. With fewer than two classes among the labels
every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import document_stats
from .text import held_out

#: Shares of the pooled covariance and of the diagonal in each class covariance.
POOL, DIAGONAL = 0.1, 0.1
FEATURES = 14


def transform(s: dict[str, np.ndarray]) -> np.ndarray:
    """One row of features for each document."""
    f = {k: v.astype(np.float64) for k, v in s.items()}
    words, chars, lines = f["n_words"] + 1, f["n_chars"] + 1, f["n_lines"] + 1
    share = lambda a, b: np.log((a + 0.5) / (np.maximum(b - a, 0) + 0.5))
    root = lambda a, b: np.sqrt(a / b)
    return np.stack(
        [
            np.log(words),
            np.log(f["word_chars"] + 1) - np.log(words),
            root(f["n_symbols"], chars),
            root(f["n_upper"], chars),
            root(f["n_lower"], chars),
            root(f["n_digits"], chars),
            root(f["n_marks"], chars),
            root(f["n_bangs"], words),
            root(f["n_ends"], words),
            root(f["n_dup_lines"], lines),
            root(f["n_repeat_words"], words),
            np.log(words) - np.log(f["n_distinct_words"] + 1),
            np.log(words) - np.log(lines),
            0.2 * share(f["n_symbols"], f["word_chars"]),
        ],
        axis=1,
    )


class Discriminant:
    def __init__(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray, pool: float = POOL, diagonal: float = DIAGONAL):
        """n: rows, sums: feature sums, squares: sums of products; each for class 0 and class 1."""
        self.share = float(n[1] / n.sum()) if n.sum() else 0.5
        self.fitted = bool(n.min() >= 2)
        if not self.fitted:
            return
        self.mean = sums / n[:, None]
        cov = squares / n[:, None, None] - self.mean[:, :, None] * self.mean[:, None, :]
        pooled = (cov * n[:, None, None]).sum(axis=0) / n.sum()
        self.factor, self.log_det = [], []
        for c, size in zip(cov, n, strict=True):
            a = max(pool, len(pooled) / (len(pooled) + size))  # small classes lean on the pool
            c = (1 - a) * c + a * pooled
            c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-6 * np.eye(len(c))
            chol = np.linalg.cholesky(c)
            self.factor.append(np.linalg.inv(chol))
            self.log_det.append(2 * np.log(np.diag(chol)).sum())
        self.prior = np.log(n / n.sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        density = [p - 0.5 * (d + (((x - m) @ f.T) ** 2).sum(axis=1)) for p, d, m, f in zip(self.prior, self.log_det, self.mean, self.factor, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def featurise(stats: DataFrame) -> DataFrame:
    """doc_id and x array<double> of rows of document_stats()."""
    names = [c for c in stats.columns if c != "doc_id"]

    def run(batches):
        for b in batches:
            x = transform({c: b.column(b.schema.get_field_index(c)).to_numpy() for c in names})
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "x"])

    return stats.mapInArrow(run, "doc_id bigint, x array<double>")


def fit(labelled: DataFrame, d: int = FEATURES) -> Discriminant:
    """From rows (x array<double>, label int): partial sums in tasks, one sum for each entry in Spark."""

    def partial(batches):
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, d)
            y = b.column(1).to_numpy()
            for k in (0, 1):
                z = x[y == k]
                n[k] += len(z)
                s[k] += z.sum(axis=0)
                q[k] += z.T @ z
        v = np.concatenate([n, s.ravel(), q.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["i", "v"])

    rows = labelled.select("x", "label").mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(2 + 2 * d + 2 * d * d)
    for r in rows:
        v[r.i] = r.v
    return Discriminant(v[:2], v[2 : 2 + 2 * d].reshape(2, d), v[2 + 2 * d :].reshape(2, d, d))


def score_documents(docs: DataFrame, labels: DataFrame, scratch) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    labels: (doc_id, quality). The statistics are written once to the shared folder, as fitting and scoring
    both read them.
    """
    x = scratch.write(featurise(document_stats(docs)), "features")
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    model = fit(x.join(known, "doc_id"))

    def run(batches):
        for b in batches:
            s = model.score(b.column(1).flatten().to_numpy().reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = x.mapInArrow(run, "doc_id bigint, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
