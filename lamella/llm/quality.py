"""Quality classifier: naive Bayes support vectors. n-gram indicators are scaled by class log-count ratios; a linear hinge-loss model is fitted by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import small_batches, stored
from lamella.llm.labelled import remainder, sample
from lamella.llm.tokens import BASE, Words, mix64, pieces, split

#: Labelled rows learned from at most; bits of a feature's number; smoothing of counts; cost of a hinge; rounds; share kept for calibration.
SAMPLE, BITS, ALPHA, COST, ROUNDS, SEED = 6000, 18, 1.0, 0.5, 12, 23
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7


def _kinds() -> np.ndarray:
    """Kind of each byte: lower and upper letters, digits, bytes of other scripts; each other sign is its own kind."""
    k = np.arange(256, dtype=np.uint64)
    k[97:123], k[65:91], k[48:58], k[128:] = 97, 65, 48, 97
    return k


_KIND = _kinds()


def _shapes(data: np.ndarray, w: Words) -> np.ndarray:
    """Hash of each word's shape: kinds of its bytes, runs of one kind once."""
    kind = _KIND[data]
    turn = np.ones(len(data), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[w.start] = True
    last = np.concatenate([[0], np.cumsum(turn)])
    order = (last[:-1] - np.repeat(last[w.start], np.diff(np.concatenate([w.start, [len(data)]])))) if len(w.start) and w.start[0] == 0 else None
    if order is None:  # bytes before the first word belong to none
        head = int(w.start[0]) if len(w.start) else len(data)
        order = np.concatenate([np.zeros(head, np.int64), last[head:-1] - np.repeat(last[w.start], np.diff(np.concatenate([w.start, [len(data)]])))])
    part = mix64(kind * np.uint64(1 << 20) + order.astype(np.uint64)) * turn
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
    return mix64(total[w.end] - total[w.start])


def features(data: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the n-grams that occur in each text, each once, and each text's first: words, pairs of words, shapes of words,
    pairs of shapes, and whether a pair is one word twice. A text without words has none."""
    w = split(data, offs)
    shape, doc = _shapes(data, w), w.doc
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    same = (w.hash[pair] == w.hash[pair + 1]).astype(np.uint64)
    grams = [(doc, w.hash, 1), (doc[pair], w.hash[pair] * BASE + w.hash[pair + 1], 2), (doc, shape, 3), (doc[pair], shape[pair] * BASE + shape[pair + 1], 4), (doc[pair], same, 5)]
    at = np.concatenate([(d.astype(np.uint64) << np.uint64(bits)) | (mix64(h + np.uint64(k << 40)) >> np.uint64(64 - bits)) for d, h, k in grams])
    at = np.unique(at)
    return (at & np.uint64((1 << bits) - 1)).astype(np.int64), np.searchsorted(at >> np.uint64(bits), np.arange(len(offs)))


@dataclass(frozen=True)
class Model:
    """Score of a text: logistic of slope * (mean weight of its n-grams, by their root) + shift."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[at])])
        return (total[first[1:]] - total[first[:-1]]) / np.sqrt(np.maximum(1, np.diff(first))) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def dual_coordinate_descent(at: np.ndarray, first: np.ndarray, value: np.ndarray, y: np.ndarray, size: int, cost: np.ndarray, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model with the least half square norm plus hinges: one dual variable at a time, in seeded order."""
    w, b, alpha, rnd = np.zeros(size), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    square = np.array([1 + np.square(value[i:j]).sum() for i, j in zip(first[:-1], first[1:], strict=True)])
    for _ in range(rounds):
        for k in rnd.permutation(len(y)):
            rows, x = at[first[k] : first[k + 1]], value[first[k] : first[k + 1]]
            new = min(max(alpha[k] - (y[k] * (w[rows] @ x + b) - 1) / square[k], 0.0), cost[k])
            if step := (new - alpha[k]) * y[k]:
                w[rows] += step * x
                b += step
                alpha[k] = new
    return w, b


def _calibrate(margins: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of a logistic curve (Newton, with the usual soft targets), rows weighed so that labels have the share ``prior``."""
    up, down = (y > 0).sum(), (y < 0).sum()
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    weigh = np.where(y > 0, prior / max(1, up), (1 - prior) / max(1, down)) * len(y)
    x, theta = np.stack([margins, np.ones_like(margins)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weigh * (p - goal)) + 1e-3 * theta * [1, 0]
        theta = theta - np.linalg.solve((x * (weigh * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
    return max(float(theta[0]), 1e-3), float(theta[1])


def fit(texts: list[str | None], labels: list[int], share: float, bits: int = BITS, alpha: float = ALPHA, cost: float = COST, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """A model from labelled texts; ``share`` is label 1's share among all labelled rows. With one label only, its share is every score."""
    y, size = np.where(np.array(labels, int) > 0, 1, -1) if labels else np.zeros(0, int), 1 << bits
    if not len(y) or abs(y.sum()) == len(y):
        p = min(max(share, 0.01), 0.99) if len(y) else 0.5
        return Model(np.zeros(size), 0.0, 0.0, float(np.log(p / (1 - p))))
    found = [features(data, offs, bits) for _, data, offs in pieces(pa.array(texts, pa.string()))]
    at, counts = np.concatenate([f[0] for f in found]), np.concatenate([np.diff(f[1]) for f in found])
    first = np.concatenate([[0], np.cumsum(counts)])
    tested = np.random.default_rng(seed).random(len(y)) < 0.2

    def trained(use: np.ndarray) -> tuple[np.ndarray, float]:
        on = np.repeat(use, counts)
        up, down = (alpha + np.bincount(at[on & np.repeat(y == s, counts)], minlength=size) for s in (1, -1))
        ratio = np.log(up / up.sum()) - np.log(down / down.sum())
        rows = at[on]
        value = ratio[rows] / np.sqrt(np.maximum(1, np.repeat(counts[use], counts[use])))
        each = np.where(y[use] > 0, 1 / max(1e-9, (y[use] > 0).mean()), 1 / max(1e-9, (y[use] < 0).mean())) * cost / 2  # both labels weigh the same
        w, b = dual_coordinate_descent(rows, np.concatenate([[0], np.cumsum(counts[use])]), value, y[use], size, each, rounds, seed)
        return w * ratio, b

    w, b = trained(~tested)
    m = Model(w, b, 1.0, 0.0).margins(at, first)[tested]
    slope, shift = _calibrate(m, y[tested], share)
    return Model(*trained(np.ones(len(y), bool)), slope, shift)


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """``id_col``, held_out, score, predicted for each row of ``docs``.

    Learns from at most ``sample_rows`` labelled rows (a bound for the fit alone; every text is scored whole). Only n-grams of the
    text are inputs. Empty, blank and null texts have no n-grams and get the score of the bias. Ids may be null or repeated."""
    train = sample(docs, labels, label, FOLDS, HELD_OUT, sample_rows, id_col, text_col).toPandas()
    counts = {r["y"]: r["count"] for r in labels.filter(remainder(F.col(id_col), FOLDS) != HELD_OUT).groupBy(F.col(label).cast("int").alias("y")).count().collect()}
    up, down = counts.get(1, 0), counts.get(0, 0)
    train = train.sort_values("id")
    model = fit(train["text"].tolist(), train["y"].tolist(), up / max(1, up + down))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offs in pieces(batch.column("text")):
                n = len(offs) - 1
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, n), batch.column("held_out").slice(at, n), pa.array(model.scores(model.margins(*features(data, offs))))], ["id", "held_out", "score"])

    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), (remainder(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        scored = stored(texts.mapInArrow(run, f"id {kind}, held_out boolean, score double"))
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
