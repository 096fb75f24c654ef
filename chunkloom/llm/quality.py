"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees on resampled rows give paths, each a conjunction of thresholds over
statistics of a text. A logistic model with lasso weights keeps few of these rules, and
those are compiled into one Spark column expression, so that scoring is a projection
without Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id

#: Labelled rows that come to the driver for training, at most (about; a hash picks them).
TRAIN_ROWS = 8_000
THRESHOLD = 0.3
TREES, DEPTH, LEAF = 24, 3, 5
LASSO, STEPS = 2e-3, 400

STATISTICS = ("log_words", "word_length", "distinct", "repeats", "symbols", "upper", "digits", "bangs", "bars", "stops", "lines", "same_lines")


def statistics(text: Column) -> list[Column]:
    """Words, lines and counts of characters, from which the statistics follow."""
    t = F.coalesce(text, F.lit(""))
    without = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    return [
        F.split(F.btrim(t), r"\s+").alias("_w"),
        F.split(t, "\n").alias("_l"),
        F.length(t).alias("_n"),
        without(r"[^\p{L}\p{N}\s.,;:'\"()?!|-]+").alias("_symbols"),
        without(r"\p{Lu}+").alias("_upper"),
        without(r"[0-9]+").alias("_digits"),
        (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).alias("_bangs"),
        (F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))).alias("_bars"),
        (F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))).alias("_stops"),
    ]


def with_statistics(docs: DataFrame, text: Column, keep: Sequence[Column]) -> DataFrame:
    """``keep`` and a double for each of STATISTICS, finite for every text; null counts
    as empty."""
    raw = docs.select(*keep, *statistics(text))
    names = [c for c in raw.columns if c not in ("_w", "_l")]
    words, lines = F.greatest(F.size("_w"), F.lit(1)).cast("double"), F.size("_l").cast("double")
    same = F.size(F.filter("_w", lambda x, i: x == F.get(F.col("_w"), i + 1)))
    flat = raw.select(
        *names,
        words.alias("_words"),
        lines.alias("_lines"),
        F.size(F.array_distinct("_w")).alias("_distinct"),
        F.size(F.array_distinct("_l")).alias("_distinct_lines"),
        same.alias("_same"),
    )
    words, chars = F.col("_words"), F.greatest(F.col("_n"), F.lit(1))
    values = (
        F.log1p(words),
        F.col("_n") / words,
        F.col("_distinct") / words,
        F.col("_same") / words,
        F.col("_symbols") / chars,
        F.col("_upper") / chars,
        F.col("_digits") / chars,
        F.col("_bangs") / words,
        F.col("_bars") / words,
        F.col("_stops") / words,
        F.col("_lines") / words,
        1 - F.col("_distinct_lines") / F.col("_lines"),
    )
    kept = [c for c in names if not c.startswith("_")]
    return flat.select(*kept, *[v.cast("double").alias(n) for n, v in zip(STATISTICS, values)])


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    value: float


@dataclass
class RuleModel:
    """score = logistic(bias + sum of the weights of the rules that hold)."""

    bias: float = 0.0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for conditions, weight in self.rules:
            z += weight * holds(conditions, x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        z = F.lit(self.bias)
        for conditions, weight in self.rules:
            fits = F.lit(True)
            for c in conditions:
                f = F.col(STATISTICS[c.feature])
                fits = fits & (f > c.value if c.above else f <= c.value)
            z = z + F.when(fits, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def holds(conditions: Sequence[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in conditions:
        out &= x[:, c.feature] > c.value if c.above else x[:, c.feature] <= c.value
    return out


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray) -> tuple[float, int, float] | None:
    """The split with the least squared error, if any improves."""
    best, n, total = None, len(y), y.sum()
    base = total * total / n
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, left = x[order, f], np.cumsum(y[order])[:-1]
        k = np.arange(1, n)
        gain = left**2 / k + (total - left) ** 2 / (n - k) - base
        gain[(v[1:] == v[:-1]) | (k < LEAF) | (n - k < LEAF)] = -1
        if n > 1 and (at := int(gain.argmax())) is not None and gain[at] > (best[0] if best else 1e-9):
            best = (float(gain[at]), int(f), float((v[at] + v[at + 1]) / 2))
    return best


def tree_rules(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, path: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """Paths to all nodes but the root of a tree grown on these rows."""
    if len(path) >= DEPTH or len(y) < 2 * LEAF or y.min() == y.max():
        return []
    features = rng.permutation(x.shape[1])[: max(1, x.shape[1] // 2)]
    found = _split(x, y, features)
    if not found:
        return []
    _, f, value = found
    out = []
    for above in (False, True):
        side = x[:, f] > value if above else x[:, f] <= value
        here = (*path, Condition(f, above, value))
        out += [here, *tree_rules(x[side], y[side], rng, here)]
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Bias (not penalised) and weights, by accelerated proximal gradient."""
    n, m = z.shape
    rate = 4.0 / (np.linalg.norm(np.c_[np.ones(n), z], 2) ** 2 / n)
    w, bias = np.zeros(m), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    pw, pb, t = w, bias, 1.0
    for _ in range(steps):
        g = (1 / (1 + np.exp(-(pb + z @ pw))) - y) / n
        nw = pw - rate * (z.T @ g)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = pb - rate * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - bias)
        w, bias, t = nw, nb, nt
    return bias, w


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleModel:
    """A model of labels 0/1; without rows every score is 0.5, with one label its share."""
    if not len(y):
        return RuleModel()
    share = (y.sum() + 0.5) / (len(y) + 1)
    if y.min() == y.max():
        return RuleModel(float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    paths: dict[bytes, tuple[Condition, ...]] = {}
    for _ in range(TREES):
        rows = rng.integers(0, len(y), len(y))
        for p in tree_rules(x[rows], y[rows].astype(float), rng):
            key = np.packbits(holds(p, x)).tobytes()
            if key not in paths or len(p) < len(paths[key]):
                paths[key] = p  # of rules that hold on the same rows the shortest stays
    rules = list(paths.values())
    if not rules:
        return RuleModel(float(np.log(share / (1 - share))))
    z = np.stack([holds(p, x) for p in rules], axis=1).astype(np.float64)
    bias, w = lasso_logistic(z, y.astype(float))
    return RuleModel(bias, [(p, float(v)) for p, v in zip(rules, w) if abs(v) > 1e-4])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> RuleModel:
    """Fit on labelled rows whose id isn't held out, about ``rows`` of them by a hash of
    the id. Rows with a null label are left out; labels other than 0 count as 1; a
    document labelled more than once counts more than once."""
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) != 0).cast("int").alias("y"))
    known = known.where(F.col("y").isNotNull() & (crc_of_id(F.col("id")) % 5 != 0))
    n = known.count()
    if not n:
        return RuleModel()
    luck = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    known = known.where(luck < rows / n)
    few = F.broadcast(known.limit(2 * rows))  # size bound: 2 * rows pairs of numbers
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(few, "id")
    got = with_statistics(texts, F.col("text"), [F.col("id"), F.col("y")]).collect()
    got.sort(key=lambda r: tuple(r))
    x = np.array([[r[c] for c in STATISTICS] for r in got], float).reshape(len(got), len(STATISTICS))
    return fit_rules(x, np.array([r["y"] for r in got], int))


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every input row: ``doc_id, held_out, score, predicted``.

    Null and empty texts are scored by their statistics, all zero; null ids are not held
    out; repeated rows come repeated; other columns are ignored; an empty table gives no
    rows. ``predicted`` is 1 from a score of 0.3 on.
    """
    held = F.coalesce(crc_of_id(F.col(id_col)) % 5 == 0, F.lit(False))
    rows = with_statistics(docs, F.col(text_col), [F.col(id_col).alias("doc_id"), held.alias("held_out")])
    out = rows.select("doc_id", "held_out", model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on ``labels`` and score all ``docs``."""
    return score(docs, train(docs, labels, label_col, id_col, text_col), id_col, text_col)
