"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text gives a fixed vector of transformed statistics. A class's mean and covariance come from sums over all its
labelled rows; covariances are shrunk towards the pooled diagonal, factored once (Cholesky) and kept. A score is the
difference of the two log densities (Mahalanobis distance and log determinant), mapped to [0, 1] by a calibration
fitted on a histogram of the training differences.

Defined cases: a null or empty text is scored like any other (all its statistics are 0); rows without a label, or with
a label other than 0 and 1, teach nothing; repeated rows count as often as they occur; with fewer than two classes the
score is the share of label 1 among the training rows (0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written

#: Classes of a byte, for counting.
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, BANG, SYMBOL, QUOTE, BAR, WIDE, CONTROL = range(12)
#: Names of the statistics, in the order of the vector.
STATISTICS = ("length", "upper", "digit", "line", "stop", "bang", "symbol", "quote", "bar", "wide", "control", "word_length", "word_spread", "long_words", "variety", "repeats", "line_repeats", "line_spread")
#: Bins of the calibration histogram.
BINS = 512


def byte_classes() -> np.ndarray:
    kinds = np.full(256, SYMBOL, np.uint8)
    kinds[0:32] = CONTROL
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), ("0123456789", DIGIT), (" \t\r\f\v", SPACE), ("\n", LINE), (".,;:", STOP), ("!?", BANG), ("'\"()-", QUOTE), ("|", BAR)):
        kinds[list(chars.encode())] = kind
    kinds[128:] = WIDE
    return kinds


def statistics(text: str | None, kinds: np.ndarray) -> list[float]:
    """The vector of a text; every entry is finite."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = np.bincount(kinds[np.frombuffer(raw, np.uint8)], minlength=12).astype(float)
    size = max(len(raw), 1)
    words = raw.split()
    count = max(len(words), 1)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    lines = [x for x in raw.split(b"\n") if x]
    sizes = np.fromiter(map(len, lines), float, len(lines)) if lines else np.zeros(1)
    share = lambda k: math.log((n[k] + 0.5) / (size + 1))
    distinct = len(set(words))
    return [
        math.log1p(len(raw)),
        math.log((n[UPPER] + 0.5) / (n[UPPER] + n[LOWER] + 1)),
        share(DIGIT), share(LINE), share(STOP), share(BANG), share(SYMBOL), share(QUOTE), share(BAR), share(WIDE), share(CONTROL),
        math.log1p(lengths.mean()), math.log1p(lengths.std()), float((lengths > 12).mean()),
        math.log((distinct + 1) / math.sqrt(count)), 1 - distinct / count if words else 0.0,
        1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0, math.log1p(sizes.std()),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats): one vector for each row."""

    def make():
        kinds = byte_classes()
        return lambda rows: {"id": rows["id"], "stats": [statistics(t, kinds) for t in rows["text"]]}

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {kind}, stats array<double>").withColumnRenamed("id", id_col)


@dataclass
class Discriminant:
    """Two class densities with cached Cholesky factors, and the calibration slope and offset."""

    prior: float
    means: np.ndarray | None = None
    #: Inverse Cholesky factors of the covariances, and log determinants.
    factors: np.ndarray | None = None
    logdets: np.ndarray | None = None
    slope: float = 1.0
    offset: float = 0.0

    def differences(self, x: np.ndarray) -> np.ndarray:
        """Log density of label 1 less that of label 0, bounded by the square root law beyond 1."""
        if self.means is None:
            return np.zeros(len(x))
        logs = [-0.5 * ((((x - m) @ f.T) ** 2).sum(1) + d) for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        diff = logs[1] - logs[0]
        return np.sign(diff) * np.log1p(np.abs(diff))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(x) + self.offset, -60, 60)))


def fit(rows: DataFrame, label_col: str, stats_col: str = "stats", shrinkage: float = 0.1) -> Discriminant:
    """Fit on (label, stats) rows: two aggregations whose results have a fixed size, whatever the input."""
    rows = rows.where(F.col(label_col).isin(0, 1)).select(F.col(label_col).cast("int").alias("label"), F.col(stats_col).alias("stats"))
    d = len(STATISTICS)

    def make():
        def step(cols):
            out = {"label": [], "at": [], "value": []}
            x, y = np.array(cols["stats"], float).reshape(-1, d), np.array(cols["label"])
            for label in (0, 1):
                own = x[y == label]
                sums = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                out["label"] += [label] * len(sums)
                out["at"] += range(len(sums))
                out["value"] += sums.tolist()
            return out

        return step

    sums = np.zeros((2, 1 + d + d * d))
    for r in arrow_map(rows, make, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect():
        sums[r["label"], r["at"]] = r["value"]
    n = sums[:, 0]
    prior = float(n[1] / n.sum()) if n.sum() else 0.5
    if n.min() < 2:
        return Discriminant(prior)
    means = sums[:, 1 : 1 + d] / n[:, None]
    covs = sums[:, 1 + d :].reshape(2, d, d) / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = np.maximum(sum(n[k] * np.diag(covs[k]) for k in (0, 1)) / n.sum(), 1e-6)
    shrunk = (1 - shrinkage) * covs + shrinkage * np.diag(pooled)
    lower = np.linalg.cholesky(shrunk)
    model = Discriminant(prior, means, np.linalg.inv(lower), 2 * np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(1))

    def bins():
        def step(cols):
            diff = model.differences(np.array(cols["stats"], float).reshape(-1, d))
            return {"label": cols["label"], "bin": np.clip((diff + 16) / 32 * BINS, 0, BINS - 1).astype(int).tolist()}

        return step

    counts = np.zeros((2, BINS))
    for r in arrow_map(rows, bins, "label int, bin int").groupBy("label", "bin").count().collect():
        counts[r["label"], r["bin"]] = r["count"]
    model.slope, model.offset = calibrate((np.arange(BINS) + 0.5) / BINS * 32 - 16, counts)
    return model


def calibrate(at: np.ndarray, counts: np.ndarray, steps: int = 50, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and offset of a logistic curve through a histogram of both classes, by Newton's method."""
    w = np.array([1.0, 0.0])
    x, total = np.stack([at, np.ones_like(at)], 1), counts.sum(0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        gradient = x.T @ (counts[1] - total * p) - ridge * w
        hessian = (x * (total * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        w = w + np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def text_score(model: Discriminant):
    """A column function from texts to scores, for filters."""
    kinds = byte_classes()

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(model.scores(np.array([statistics(t, kinds) for t in texts], float).reshape(-1, len(STATISTICS))))

    return scored


def score(rows: DataFrame, model: Discriminant, stats_col: str = "stats") -> DataFrame:
    """The rows with a score column instead of their statistics."""

    @F.pandas_udf("double")
    def scored(stats):
        import pandas as pd

        return pd.Series(model.scores(np.array(stats.tolist(), float).reshape(-1, len(STATISTICS))))

    return rows.withColumn("score", scored(F.col(stats_col))).drop(stats_col)


def classify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score) for each document; ``labelled`` has (id, label) rows to learn from.

    The texts are read once; all later steps use the written vectors, a few dozen bytes a row.
    """
    vectors, model = trained(docs, labelled, id_col, text_col, label_col)
    return score(vectors, model)


def trained(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[DataFrame, Discriminant]:
    """The written (id, stats) vectors of all documents, and the model of those that are labelled."""
    vectors = written(features(docs, id_col, text_col), "quality")
    known = labelled.select(F.col(id_col).alias("_id"), label_col)
    return vectors, fit(vectors.join(known, vectors[id_col] == known["_id"]).select(label_col, "stats"), label_col)
