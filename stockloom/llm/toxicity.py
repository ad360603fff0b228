"""Toxicity: gradient-boosted trees over dense features of the whole text, calibrated by isotonic regression.

Training rows are split into ten parts by id hash. Lexicons (word stems by log-odds, counted in Spark) are learned from several sets
of parts, so that trees learn from features that a row's own label has no part in. The scoring trees learn from all rows; the same
fit is done five times with two parts kept back, at every size, and the calibration learns from the margins of those. Rows of the
rarer label are sampled more densely; the calibration puts that right.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.samples import label_sample
from stockloom.llm.text import chunks, held_out
from stockloom.plans.durable import staged

# Fixed word lists: plain insults, and words that address a person, in the languages of the corpus.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting trash scum clown garbage imbecile fool "
    "dummkopf trottel versager abschaum idiota imbécil estúpido basura payaso imbécile stupide ordure crétin".split()
)
PERSONS = frozenset("you your yours yourself you're youre ur u du dich dir dein deine ihr euch tu te toi ton ta vous votre tú usted ti vosotros vos".split())
LEET = str.maketrans("0134578@$!|", "oieastbasil")

FEATURES = (
    "log_words insult_count insult_density learned_count learned_density weak_density top_weight weight_sum person_density near_person "
    "caps_words upper_share exclaims questions punctuation obfuscated digits word_length"
).split()
STEMS = (4, 5, 6)
NEAR = 5
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")


def stems(word: str) -> list[str]:
    """The whole word, marked, and its beginnings."""
    return ["=" + word, *(word[:n] for n in STEMS if len(word) >= n)]


@dataclass
class Trees:
    """Boosted regression trees of depth 3 on quantile bins, for the logistic loss."""

    rounds: int = 60
    rate: float = 0.15
    depth: int = 3
    bins: int = 32
    least: float = 4.0
    start: float = 0.0
    cuts: list = field(default_factory=list)
    nodes: list = field(default_factory=list)  # (feature[7], cut[7], leaf[8])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = math.log(p / (1 - p))
        f = np.full(n, self.start)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            at = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                for node in range(2**level):
                    own = np.flatnonzero(at == node)
                    best = self._split(binned[own], g[own], h[own]) if len(own) else None
                    if best:
                        feature[2**level - 1 + node], cut[2**level - 1 + node] = best[0], self.cuts[best[0]][best[1]]
                spot = 2**level - 1 + at
                at = 2 * at + (x[np.arange(n), feature[spot]] > cut[spot])
            leaf = self.rate * np.bincount(at, g, 2**self.depth) / (np.bincount(at, h, 2**self.depth) + 1.0)
            f += leaf[at]
            self.nodes.append((feature, cut, leaf))
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        best, gain = None, 1e-6
        whole, weight = g.sum(), h.sum()
        for j in range(b.shape[1]):
            if not len(self.cuts[j]):
                continue
            gl = np.cumsum(np.bincount(b[:, j], g, len(self.cuts[j]) + 1))[:-1]
            hl = np.cumsum(np.bincount(b[:, j], h, len(self.cuts[j]) + 1))[:-1]
            cl = np.cumsum(np.bincount(b[:, j], minlength=len(self.cuts[j]) + 1))[:-1]
            value = gl**2 / (hl + 1) + (whole - gl) ** 2 / (weight - hl + 1) - whole**2 / (weight + 1)
            value[(cl < self.least) | (len(b) - cl < self.least)] = -1
            k = int(value.argmax())
            if value[k] > gain:
                best, gain = (j, k), value[k]
        return best

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.nodes:
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                spot = 2**level - 1 + at
                at = 2 * at + (x[rows, feature[spot]] > cut[spot])
            f += leaf[at]
        return f


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of a rising map from margin to probability, each pool eased by half a row of either label."""
    pools: list[list[float]] = []  # positives, rows, sum of margins
    for m, v in sorted(zip(margin.tolist(), y.tolist(), strict=True)):
        pools.append([v, 1, m])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            v2, n2, m2 = pools.pop()
            pools[-1] = [pools[-1][0] + v2, pools[-1][1] + n2, pools[-1][2] + m2]
    x = np.array([m / n for _, n, m in pools])
    p = np.array([(v + 0.5) / (n + 1) if 0 < v < n else (0.5 / (n + 1) if v == 0 else 1 - 0.5 / (n + 1)) for v, n, _ in pools])
    return x, np.maximum.accumulate(p)


class _Lexicon(dict):
    """What is known of each word as it stands in a text: a row of ``table``; forgets all when ``most`` words are known."""

    most = 600_000

    def __init__(self, weights: dict[str, float], most: int = most):
        super().__init__()
        self.weights, self.most = weights, most
        self.table = np.empty((self.most, 11), np.float32)

    def weight(self, core: str) -> float:
        get = self.weights.get
        return max(get("=" + core, 0.0), *(get(core[:n], 0.0) for n in STEMS)) if len(core) >= STEMS[0] else get("=" + core, 0.0)

    def __missing__(self, raw: bytes) -> int:
        w = raw.decode("utf-8", "replace")
        low = w.lower()
        core = low.strip(".,")
        hidden, digits, marks = 0, 0, len(low) - len(core)
        if core.isalpha():
            weight = self.weight(core)
            insult = core in INSULTS
        else:
            core = _TRIM.sub("", low)
            plain = _INNER.sub("", core.translate(LEET))
            weight, insult = self.weight(core), core in INSULTS
            if plain != core and weight == 0 and (plain in INSULTS or self.weight(plain) > 0):
                hidden, weight, insult = 1, self.weight(plain), insult or plain in INSULTS
            marks = sum(not (c.isalnum() or c.isspace()) for c in w)
            digits = sum(c.isdigit() for c in w)
        upper = 0 if w == low else 1 if w[1:] == low[1:] else sum(c.isupper() for c in w)
        n = self[raw] = len(self)
        self.table[n] = (insult, weight, core in PERSONS, upper == len(core) and upper > 1, upper, w.count("!"), w.count("?"), marks, hidden, digits, len(core))
        return n


def _features(texts: list[bytes], lexicon: _Lexicon) -> np.ndarray:
    out = np.zeros((len(texts), len(FEATURES)))
    for i, t in enumerate(texts):
        words = t.split()
        if not words:
            continue
        if len(lexicon) + len(words) > lexicon.most:
            lexicon.clear()
            if len(words) > lexicon.most:
                lexicon.table = np.empty((len(words), 11), np.float32)
        codes = np.fromiter(map(lexicon.__getitem__, words), np.int64, len(words))
        used, again = np.unique(codes, return_inverse=True)
        table = lexicon.table[used].astype(np.float64)
        n = np.bincount(again).astype(float)
        total = n @ table
        hit = (table[:, 0] > 0) | (table[:, 1] > 1)
        near = 0
        if hit.any() and total[2]:
            here, them = np.flatnonzero(hit[again]), np.flatnonzero(table[again, 2])
            k = np.searchsorted(them, here)
            gap = np.minimum(np.abs(here - them[np.minimum(k, len(them) - 1)]), np.abs(here - them[np.maximum(k - 1, 0)]))
            near = int((gap <= NEAR).sum())
        size, letters = len(words), max(total[10], 1)
        strong, weak = n[table[:, 1] > 2].sum(), n[(table[:, 1] > 0) & (table[:, 1] <= 2)].sum()
        out[i] = (
            math.log1p(size), total[0], total[0] / size, strong, strong / size, weak / size, table[:, 1].max(), total[1], total[2] / size, near,
            total[3] / size, total[4] / letters, total[5] / size, total[6] / size, total[7] / size, total[8], total[9] / size, total[10] / size,
        )
    return out


PARTS, TURNS = 10, 5


def _place(part, turn: int):
    """Where a part stands in a turn: under 4 in its first half, under 8 in its second, else kept back; columns or arrays."""
    return (part + (PARTS - 2 * turn)) % PARTS


#: The parts that each lexicon is learned from: the first halves of the turns, all but what a turn keeps back, and all.
HALVES = [[p for p in range(PARTS) if _place(p, k) < 4] for k in range(TURNS)]
FOLDS = [[p for p in range(PARTS) if _place(p, k) < 8] for k in range(TURNS)]
LEXICONS = [*HALVES, *FOLDS, list(range(PARTS))]


def lexicons_of(part: int) -> list[int]:
    """The lexicons, by their place in ``LEXICONS``, whose features a row's part gets: halves that have not learned from it, then the fold that keeps it back."""
    return [k for k in range(TURNS) if part not in HALVES[k]] + [TURNS + k for k in range(TURNS) if part not in FOLDS[k]]


def learn_lexicons(sample: DataFrame, label: str, totals: list[tuple[int, int]]) -> list[dict[str, float]]:
    """For each of ``LEXICONS`` the word stems that speak for label 1, with their log-odds, counted by documents in one job.

    A stem counts if its odds are over eight times those of label 0 and it is in two documents of label 1 or more (one in 200 of
    them). sample: _id, text, label, part; totals: rows of label 1 and all rows that a lexicon learns from. What reaches the driver
    follows the bounded sample.
    """
    word = F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}\s]+", " ")), r"\s+")))
    words = sample.select("_id", "part", label, word.alias("w")).where("w <> ''")
    stem = F.explode(F.array(F.concat(F.lit("="), F.col("w")), *(F.when(F.length("w") >= n, F.substring("w", 1, n)) for n in STEMS)))
    terms = words.select("_id", "part", label, stem.alias("s")).where("s is not null").distinct()
    by_part = terms.groupBy("s").agg(*(F.sum(F.when(F.col("part") == p, F.col(label)).otherwise(0)).alias(f"a{p}") for p in range(PARTS)), *(F.sum(F.when(F.col("part") == p, 1 - F.col(label)).otherwise(0)).alias(f"b{p}") for p in range(PARTS)))
    weights = []
    for k, (parts, (p, n)) in enumerate(zip(LEXICONS, totals, strict=True)):
        a, b = (sum((F.col(f"{c}{i}") for i in parts[1:]), F.col(f"{c}{parts[0]}")) for c in "ab")
        odds = F.log((a + 0.5) / (p + 1)) - F.log((b + 0.5) / (n - p + 1))
        weights.append(F.when((a >= max(2, p // 200)) & (a * (n - p) > 8 * p * b), odds).alias(f"w{k}"))
    found = by_part.select("s", *weights).where(" or ".join(f"w{k} is not null" for k in range(len(LEXICONS)))).collect()
    return [{r["s"]: float(r[f"w{k}"]) for r in found if r[f"w{k}"] is not None} for k in range(len(LEXICONS))]


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None  # there whenever there are trees
    base: float
    lexicon: _Lexicon | None = None

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.base)
        if self.lexicon is None:  # made where texts are scored, and kept from task to task
            self.lexicon = _Lexicon(self.weights)
        m = self.trees.margin(_features(texts, self.lexicon))
        return np.clip(np.interp(m, *self.knots), 0.0, 1.0)


def _feature_rows(lexicons: list[dict[str, float]]):
    """For each row its features under the lexicons of its part, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [_Lexicon(w, 200_000) for w in lexicons[:-1]]
        for some, texts in chunks(batches, 3, 4_000_000):
            part = some.column(2).to_pylist()
            x: list[list[float]] = [[] for _ in texts]
            for k, lexicon in enumerate(known):
                own = [i for i, p in enumerate(part) if k in lexicons_of(p)]
                for i, row in zip(own, _features([texts[i] for i in own], lexicon).tolist(), strict=True):
                    x[i] += row
            yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(3)), pa.array(x, pa.list_(pa.float64()))], ["_id", "y", "part", "x"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 12_000) -> ToxicityModel:
    """Learns from at most ``max_rows`` labelled documents that are not held out, with as many of the rarer label as half of
    them hold; only dense features reach the driver.

    Trees learn from features that a row's own label has no part in: each half of the rows has them from the lexicon of another one. They are
    fitted on all rows and score with the lexicon of all. The calibration comes from the same fit done five times with a fifth of the
    rows kept back, whose margins are taken with the lexicon of the others. Without rows of both labels in such a fit the model is the
    share of label 1 (0 without rows).
    """
    picked, dense = label_sample(docs, labels, label, max_rows, id_col, text_col)
    sample = staged(picked.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(PARTS)).cast("int")), "labelled")
    counts = {(int(r[label]), int(r["part"])): r["count"] for r in sample.groupBy(label, "part").count().collect()}
    of = lambda v, parts=range(PARTS): sum(counts.get((v, p), 0) for p in parts)
    toxic, clean = of(1) / (dense[1] or 1), of(0) / (dense[0] or 1)
    base = toxic / (toxic + clean) if toxic + clean else 0.0
    able = [k for k in range(TURNS) if of(0, FOLDS[k]) and of(1, FOLDS[k])]
    if not able:
        return ToxicityModel({}, None, None, base)
    lexicons = learn_lexicons(sample, label, [(of(1, parts), of(0, parts) + of(1, parts)) for parts in LEXICONS])
    rows = sample.select("_id", F.col(label).cast("int").alias("y"), "part", "text").mapInArrow(_feature_rows(lexicons), "_id long, y int, part int, x array<double>")
    got = sorted(rows.collect(), key=lambda r: r["_id"])  # sorted here: a sort in Spark would make features twice
    part, y = np.array([r["part"] for r in got]), np.array([r["y"] for r in got], float)
    wide = len(FEATURES)

    def features(of_part) -> np.ndarray:
        """Each row's features under the lexicon that ``of_part`` names for its part."""
        at = [lexicons_of(p).index(of_part(p)) * wide if of_part(p) is not None else None for p in range(PARTS)]
        return np.array([r["x"][at[p] : at[p] + wide] if at[p] is not None else [np.nan] * wide for r, p in zip(got, part.tolist(), strict=True)])

    margins, truth = [], []
    for k in able:
        other = (k + 2) % TURNS  # its first half is this turn's second
        x = features(lambda p: k if _place(p, k) >= 4 and _place(p, k) < 8 else other if _place(p, k) < 4 else TURNS + k)  # noqa: B023
        kept = _place(part, k) >= 8
        trees = Trees().fit(x[~kept], y[~kept])
        margins.append(trees.margin(x[kept]))
        truth.append(y[kept])
    knots, p = isotonic(np.concatenate(margins), np.concatenate(truth))
    if not len(knots):
        return ToxicityModel({}, None, None, base)
    trees = Trees().fit(features(lambda p: lexicons_of(p)[0]), y)
    return ToxicityModel(lexicons[-1], trees, (knots, p * dense[0] / (p * dense[0] + (1 - p) * dense[1])), base)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """``(id, held_out, score, predicted)`` for each row; null and empty texts are scored as texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # stems of a bounded sample and 60 small trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, 1, 4_000_000):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(texts), pa.float64())], ["_id", "score"])

    got = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string")).mapInArrow(run, "_id long, score double")
    return got.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
