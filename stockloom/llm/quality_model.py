"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text is shared by all grades; ordered thresholds cut its score into grades:
``P(grade > g) = logistic(w.x - theta_g)``. It gives the expected grade and the tail probabilities. The tail at which documents
are selected comes from rows that the model judging them has not seen: it keeps a stated share of the documents graded 1 or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.samples import labelled_sample
from stockloom.llm.text import chunks, held_out, ngram_counts

WIDTH, ORDERS = 2048, (1, 2, 3)
SIDE = WIDTH + 2
KEEP, TURNS = 0.997, 4


def rating(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Grades from the two labels: 0 poor, 1 good but toxic, 2 good and clean; null where a label that decides is null."""
    return F.when(F.col(quality) == 0, 0).when(F.col(quality).isNotNull() & (F.col(toxic) == 1), 1).when(F.col(quality).isNotNull() & F.col(toxic).isNotNull(), 2)


def features(text: bytes) -> np.ndarray:
    """Hashed byte n-grams at unit length, then the share of words that repeat the one before, and of those that came before."""
    x = np.zeros(SIDE, np.float32)
    grams = np.sqrt(ngram_counts(text, WIDTH, ORDERS))
    x[:WIDTH] = grams / max(float(np.linalg.norm(grams)), 1e-9)
    words = text.split()
    if words:
        x[WIDTH:] = sum(map(eq, words, words[1:])) / len(words), 1 - len(set(words)) / len(words)
    return x


@dataclass
class OrdinalModel:
    weights: np.ndarray
    cuts: np.ndarray  # rising, one fewer than the grades
    min_tail: float = 0.5  # P(grade >= 1) from which a document is kept

    def tails(self, x: np.ndarray) -> np.ndarray:
        """``P(grade >= 1), P(grade >= 2), ...`` for each row; they fall from left to right."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights)[:, None] - self.cuts[None, :], -30, 30)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, ease: float = 1e-4, rounds: int = 250, rate: float = 0.15) -> OrdinalModel:
    """Maximum likelihood by Adam; thresholds are a first one and positive steps, so they stay in order."""
    n, d = x.shape
    share = np.clip([(y >= g).mean() if n else 0.5 for g in range(1, grades)], 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
    theta = np.concatenate([np.zeros(d), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    if not n:
        return OrdinalModel(np.zeros(d), start)
    cuts = lambda t: np.cumsum(np.concatenate([t[d : d + 1], np.exp(t[d + 1 :])]))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        c = cuts(theta)
        s = (x @ theta[:d].astype(x.dtype)).astype(float)
        tail = 1 / (1 + np.exp(-np.clip(s[:, None] - c, -30, 30)))
        full = np.hstack([np.ones((n, 1)), tail, np.zeros((n, 1))])
        slope = np.hstack([np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))])
        rows = np.arange(n)
        p = np.maximum(full[rows, y] - full[rows, y + 1], 1e-9)
        gs = (slope[rows, y] - slope[rows, y + 1]) / p
        gc = np.zeros((n, grades + 1))
        gc[rows, y] -= slope[rows, y] / p
        gc[rows, y + 1] += slope[rows, y + 1] / p
        gc = gc[:, 1:-1].sum(0) / n
        tail_sums = np.cumsum(gc[::-1])[::-1]
        g = np.concatenate([gs.astype(x.dtype) @ x / n - ease * theta[:d], tail_sums[:1], tail_sums[1:] * np.exp(theta[d + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(theta[:d], cuts(theta))


def select_tail(x: np.ndarray, y: np.ndarray, grades: int, keep: float) -> float:
    """The tail at which to keep, by models that have not seen the rows they judge: rows take turns.

    A share of ``keep`` of the rows graded 1 or more stays; below that bound the tail lies midway to the next poor row, so that
    no stricter than poor rows call for. 0.5 if no row, or every row, has such a grade.
    """
    good = y >= 1
    if good.all() or not good.any():
        return 0.5
    turn, tail = np.arange(len(y)) % TURNS, np.full(len(y), 0.5)
    for k in range(TURNS):
        if (turn == k).any() and (turn != k).any():
            tail[turn == k] = fit_ordinal(x[turn != k], y[turn != k], grades).tails(x[turn == k])[:, 0]
    most = float(np.quantile(tail[good], 1 - keep))
    return (most + float(tail[~good & (tail < most)].max(initial=0.0))) / 2


def fit_quality(docs: DataFrame, ratings: DataFrame, grade_col: str = "grade", grades: int = 3, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 4000, keep: float = KEEP) -> OrdinalModel:
    """Learns from at most ``max_rows`` rated documents that are not held out; half-precision hashed counts reach the
    driver (4 kB a row). Rows with a null grade, or one outside 0 to ``grades - 1``, teach nothing; a grade without rows keeps a
    small probability. Without rows the thresholds alone grade, and all documents are kept."""
    known = ratings.where(F.col(grade_col).between(0, grades - 1))
    sample = labelled_sample(docs, known, [grade_col], max_rows, id_col, text_col).select("_id", F.col(grade_col).cast("int").alias("y"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, 2, 4_000_000):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([features(t).astype(np.float16).tobytes() for t in texts], pa.binary())], ["_id", "y", "x"])

    got = sorted(sample.mapInArrow(run, "_id long, y int, x binary").collect(), key=lambda r: r["_id"])  # sorted here: a sort in Spark would make features twice
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, SIDE), np.float32)
    y = np.array([r["y"] for r in got], int)
    model = fit_ordinal(x, y, grades)
    model.min_tail = select_tail(x, y, grades, keep) if len(y) else 0.0
    return model


def score_quality(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", min_tail: float | None = None) -> DataFrame:
    """``(id, held_out, expected_grade, tail_1, tail_2, ..., kept)`` for each row; kept: ``tail_1`` is the model's tail or more.

    Null and empty texts have no n-grams, so that the thresholds alone grade them.
    """
    tails = [f"tail_{g}" for g in range(1, len(model.cuts) + 1)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, 1, 2_000_000):
            p = np.vstack([shared.value.tails(np.stack([features(t) for t in texts[i : i + 512]])) for i in range(0, len(texts), 512)])
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(p[:, i].astype(np.float64)) for i in range(p.shape[1]))], ["_id", *tails])

    got = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string")).mapInArrow(run, "_id long, " + ", ".join(f"{t} double" for t in tails))
    return got.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), sum((F.col(t) for t in tails), F.lit(0.0)).alias("expected_grade"), *tails, (F.col("tail_1") >= (model.min_tail if min_tail is None else min_tail)).alias("kept"))


def select_quality(docs: DataFrame, model: OrdinalModel, text_col: str = "text", min_tail: float | None = None) -> DataFrame:
    """The rows of ``docs`` that ``score_quality`` keeps, all columns as they are; repeated rows stay repeated."""
    least = model.min_tail if min_tail is None else min_tail
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, at, 2_000_000):
            p = np.concatenate([shared.value.tails(np.stack([features(t) for t in texts[i : i + 512]]))[:, 0] for i in range(0, len(texts), 512)])
            yield part.filter(pa.array(p >= least))

    return docs.mapInArrow(run, docs.schema)
