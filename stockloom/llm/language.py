"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit a linear classifier over hashed byte n-grams predicts whether a text's
codeword has it. Decoding adds up, for each language, the losses of all bits against its codeword, weighted by
how well each bit is predicted, and takes the smallest sum. A small lead over the second is flagged.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.samples import first_by_hash
from stockloom.llm.text import chunks, held_out, ngram_counts
from stockloom.plans.durable import staged

WIDTH, ORDERS = 4096, (1, 2, 3)
MOST_SENT = 100_000  # training rows whose ids are sent to every executor; more are joined by a shuffle
_OTHER = re.compile(r"[\W\d_]+")
_WORDLIKE = re.compile(r"[^\W\d_]")  # letters, but also numbers such as fractions


def letters_only(text: bytes) -> bytes:
    """The text in lower case with one space for each run of other characters than letters; empty without a letter."""
    s = text.decode("utf-8", "replace")
    return _OTHER.sub(" ", s.lower()).encode() if any(m[0].isalpha() for m in _WORDLIKE.finditer(s)) else b""


def features(plain: bytes) -> np.ndarray:
    x = np.sqrt(ngram_counts(b" " + plain + b" ", WIDTH, ORDERS))
    return x / max(float(np.linalg.norm(x)), 1e-9)


def codewords(classes: int, seed: int = 5) -> np.ndarray:
    """A row of +-1 for each class: all distinct splits for up to 5 classes, else the best of 200 random codes."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 5:
        splits = np.arange(1, 2 ** (classes - 1))
        return np.array([[1.0] * len(splits), *([-1.0 if s >> i & 1 else 1.0 for s in splits] for i in range(classes - 1))])
    bits = max(15, int(np.ceil(6 * np.log2(classes))))
    rng, best, apart = np.random.default_rng(seed), None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (classes, bits))
        least = min(_nearest(code, at) for at in range(0, classes, 2000))
        if least > apart and (np.abs(code.sum(0)) < classes).all():
            best, apart = code, least
    return best


def _nearest(code: np.ndarray, at: int) -> float:
    """The least distance of the codewords from ``at`` on (2,000 at most) to any other."""
    agree = code[at : at + 2000] @ code.T
    agree[np.arange(len(agree)), at + np.arange(len(agree))] = -np.inf
    return float((code.shape[1] - agree.max()) / 2)


def losses(out: np.ndarray, code: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """Weighted hinge losses of each row against each codeword."""
    agree, differ = np.maximum(0, 1 - out), np.maximum(0, 1 + out)
    return ((agree + differ) / 2 @ trust)[:, None] + ((agree - differ) / 2 * trust) @ code.T


@dataclass
class LanguageModel:
    names: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    sharpness: float

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its probability, and the lead of its loss over the second's."""
        out = x @ self.weights[:-1] + self.weights[-1]
        loss = losses(out, self.code, self.trust)
        p = np.exp(-self.sharpness * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        order = np.partition(loss, 1, 1) if loss.shape[1] > 1 else None
        lead = order[:, 1] - order[:, 0] if order is not None else np.full(len(x), np.inf)
        return loss.argmin(1), p.max(1), lead


SHARP = (1, 2, 4, 6, 8, 12, 16, 24)
EASE = 0.02
SIDE = WIDTH + 1


def _trust(right: np.ndarray) -> np.ndarray:
    """Weights of the bits from the share of rows in which each is right."""
    trust = np.maximum(2 * right - 1, 0.05)
    return trust / trust.sum()


def _likelihoods(loss: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Log-likelihood of the labels at each sharpness, summed over the rows."""
    over = loss - loss.min(1, keepdims=True)
    own = over[np.arange(len(over)), label]
    return np.array([np.sum(-s * own - np.log(np.exp(-s * over).sum(1))) for s in SHARP])


def _matrices(batches: Iterator[pa.RecordBatch], at: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features with a column of ones, and labels, of up to 1,024 rows at a time; the columns are _id, lang and x."""
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            x = np.frombuffer(b"".join(part.column(2).to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float64)
            yield np.hstack([x, np.ones((len(x), 1))]), np.array([at[n] for n in part.column(1).to_pylist()])


def _normal_sums(rows: DataFrame, at: dict[str, int], code: np.ndarray, gram: np.ndarray, right: np.ndarray, tasks: int) -> None:
    """Adds the Gram matrix of the rows and their products with the codewords to ``gram`` and ``right``.

    Each of ``tasks`` tasks sums its rows; the sums meet by lines of the matrix (its upper half), a few lines in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, r, some = np.zeros((SIDE, SIDE)), np.zeros((SIDE, code.shape[1])), False
        for x, label in _matrices(batches, at):
            some = True
            for low in range(0, SIDE, 512):
                g[low : low + 512, low:] += x[:, low : low + 512].T @ x[:, low:]
            r += x.T @ code[label]
        for low in range(0, SIDE if some else 0, 256):
            own = range(low, min(low + 256, SIDE))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([g[i, i:].tobytes() + r[i].tobytes() for i in own], pa.binary())], ["line", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(b.as_py())
                total[i] = total[i] + v if i in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["line", "sums"])

    kind = "line int, sums binary"
    for row in rows.repartition(tasks).mapInArrow(run, kind).repartition(64, "line").mapInArrow(add, kind).toLocalIterator():
        i, v = row["line"], np.frombuffer(row["sums"])
        gram[i, i:] += v[: SIDE - i]
        gram[i + 1 :, i] += v[1 : SIDE - i]
        right[i] += v[SIDE - i :]


def _summed(rows: DataFrame, at: dict[str, int], f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``f(features, labels)``, a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [f(x, label) for x, label in _matrices(batches, at)]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, 0).astype(np.float64).tobytes()], pa.binary())], ["sums"])

    return np.sum([np.frombuffer(r["sums"]) for r in rows.mapInArrow(run, "sums binary").collect()], 0)


def _aside() -> Column:
    """The fifth of the training rows that trust and sharpness come from, by the id alone."""
    return F.pmod(F.xxhash64(F.lit(7), "_id"), F.lit(5)) == 0


def _judged(predicted: np.ndarray, label: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, float]:
    """Trust of each bit and the sharpness, from predictions for rows that were set aside; without any all bits count alike."""
    trust = _trust((np.sign(predicted) == code[label]).mean(0) if len(label) else np.ones(code.shape[1]))
    fits = sum((_likelihoods(losses(predicted[i : i + 512], code, trust), label[i : i + 512]) for i in range(0, len(label), 512)), np.zeros(len(SHARP)))
    return trust, float(SHARP[int(np.argmax(fits))])


def _fit_here(rows: DataFrame, names: list[str], code: np.ndarray) -> LanguageModel:
    """As ``_fit_in_tasks`` with all rows on the driver, where few rows make their products with each other the smaller system."""
    at = {n: i for i, n in enumerate(names)}
    got = rows.withColumn("aside", _aside()).orderBy("_id", "lang").collect()
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float64)
    x = np.hstack([x, np.ones((len(x), 1))])
    label, back = np.array([at[r["lang"]] for r in got]), np.array([r["aside"] for r in got])

    def weights(own: np.ndarray) -> np.ndarray:
        return x[own].T @ np.linalg.solve(x[own] @ x[own].T + EASE * np.eye(int(own.sum())), code[label[own]])

    trust, sharp = _judged(x[back] @ weights(~back), label[back], code)
    return LanguageModel(names, code, weights(np.ones(len(x), bool)).astype(np.float32), trust, sharp)


def _fit_in_tasks(rows: DataFrame, names: list[str], code: np.ndarray, count: int) -> LanguageModel:
    """Sums of all rows in tasks; trust and sharpness from the predictions for a fifth of them, by weights learned without it."""
    at = {n: i for i, n in enumerate(names)}
    tasks = min(64, -(-count // WIDTH))
    gram, right = EASE * np.eye(SIDE), np.zeros((SIDE, code.shape[1]))
    _normal_sums(rows.where(~_aside()), at, code, gram, right, tasks)
    first = np.linalg.solve(gram, right)
    aside = rows.where(_aside())
    hits = _summed(aside, at, lambda x, label: np.append((np.sign(x @ first) == code[label]).sum(0), len(x)))
    trust = _trust(hits[:-1] / hits[-1])
    fits = _summed(aside, at, lambda x, label: _likelihoods(losses(x @ first, code, trust), label))
    _normal_sums(aside, at, code, gram, right, tasks)
    return LanguageModel(names, code, np.linalg.solve(gram, right).astype(np.float32), trust, float(SHARP[int(np.argmax(fits))]))


def fit_language(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = 400, most_here: int = WIDTH) -> LanguageModel:
    """Learns every language from the whole texts of ``per_language`` of its documents (those of the smallest id hashes) that
    are not held out. Up to ``most_here`` training rows are solved on the driver, more are summed in tasks; either way gives
    the same weights, and the same trust and sharpness, which come from a fifth of the rows and weights learned without it."""
    known = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(lang_col).cast("string").alias("lang")).dropna().where(~held_out("_id"))
    picked = staged(first_by_hash(known.distinct(), "lang", per_language).select("_id", "lang"), "picked")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches, 2, 4_000_000):
            plain = [letters_only(t) for t in raw]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([features(t).astype(np.float16).tobytes() if t else None for t in plain], pa.binary())], ["_id", "lang", "x"]
            )

    side = F.broadcast(picked) if picked.count() <= MOST_SENT else picked.hint("merge")  # rows of an id and a name, the same result
    one = texts.join(side, ["_id", "lang"]).groupBy("_id", "lang").agg(F.max("text").alias("text"))
    rows = staged(one.mapInArrow(run, "_id long, lang string, x binary").where("x is not null"), "languages")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    names, count = sorted(counts), sum(counts.values())
    if not names:
        return LanguageModel([], np.ones((0, 1)), np.zeros((SIDE, 1)), np.ones(1), 1.0)
    code = codewords(len(names))
    if count <= most_here:
        return _fit_here(rows, names, code)
    return _fit_in_tasks(rows, names, code, count)


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", min_lead: float = 0.1) -> DataFrame:
    """``(id, held_out, lang_pred, score, ambiguous)`` for each row.

    ``und`` with score 0 if the text is null or has no letter, or no language was learned. ``ambiguous`` marks a lead under
    ``min_lead`` (and ``und``).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, raw in chunks(batches, 1, 2_000_000):
            plain = [letters_only(t) for t in raw]
            names, score, doubt = ["und"] * len(raw), np.zeros(len(raw)), np.ones(len(raw), bool)
            own = [i for i, t in enumerate(plain) if t] if m.names else []
            step = max(16, min(512, 2**21 // max(1, len(m.names))))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                best, p, lead = m.decode(np.stack([features(plain[i]) for i in some]).astype(np.float32))
                score[some], doubt[some] = np.clip(p, 0, 1), lead < min_lead
                for i, b in zip(some, best, strict=True):
                    names[i] = m.names[b]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(score), pa.array(doubt)], ["_id", "lang_pred", "score", "ambiguous"])

    got = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string")).mapInArrow(run, "_id long, lang_pred string, score double, ambiguous boolean")
    return got.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "lang_pred", "score", "ambiguous")
