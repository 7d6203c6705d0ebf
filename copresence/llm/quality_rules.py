"""A quality classifier as a sparse ensemble of rules over text statistics.

Small trees are boosted on a bounded sample of labelled documents; every path from a root to a node is a conjunctive rule; a lasso
logistic regression weighs the rules and leaves most of them at zero; the rest is compiled into Spark column expressions. The statistics and the score
of all documents are plain columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from copresence.llm.common import id_crc

#: At most so many labelled documents are learned from, those with the lowest hash of their id.
MAX_ROWS = 12_000
TREES = 30
DEPTH = 3
CUTS = 24
#: Penalty of the lasso, per row.
PENALTY = 0.002
#: Rules must hold for this share of the sample, and not for more than the rest.
SUPPORT = 0.005

_UPPER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_STOPS, _MARKS, _SYMBOLS = ".,;:", "!?", "#$%&*+<=>@^_`|~/\\{}[]"
STATISTICS = [
    "log_chars", "mean_word", "upper_share", "digit_share", "stop_share", "mark_share", "symbol_share", "blank_share", "line_words",
    "distinct_words", "distinct_lines", "letter_share",
]


def with_statistics(rows: DataFrame, text: str) -> DataFrame:
    """Add the statistics of a whole text column; a null text counts as empty, and shares of nothing are 0.

    Letters and blanks, the bulk of a text, are taken off first; the rarer kinds of characters are counted in what is left.
    """
    blanks, least = r"[\x20\x09-\x0D]+", lambda c: F.greatest(c, F.lit(1)).cast("double")
    rows = rows.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn("_unlettered", F.regexp_replace("_text", "[a-z]+", "")).withColumn("_words", F.array_remove(F.split("_text", blanks), ""))
    rows = rows.withColumn("_rest", F.regexp_replace("_unlettered", blanks, "")).withColumn("_lines", F.array_remove(F.split("_text", r"[\r\n]+"), ""))
    size = rows.select(
        *[F.col(c) for c in rows.columns if c not in ("_text", "_unlettered", "_words", "_lines", "_rest")], "_rest",
        F.length("_text").alias("_chars"), F.length("_unlettered").alias("_other"), F.size("_words").alias("_n_words"), F.size("_lines").alias("_n_lines"),
        F.size(F.array_distinct("_words")).alias("_d_words"), F.size(F.array_distinct("_lines")).alias("_d_lines"))
    chars, words, lines = least(F.col("_chars")), least(F.col("_n_words")), least(F.col("_n_lines"))
    share = lambda kinds: (F.length("_rest") - F.length(F.translate("_rest", kinds, ""))) / chars
    blank = F.col("_other") - F.length("_rest")
    values = {
        "log_chars": F.log1p(F.col("_chars").cast("double")),
        "mean_word": (F.col("_chars") - blank) / words,
        "upper_share": share(_UPPER),
        "digit_share": share(_DIGITS),
        "stop_share": share(_STOPS),
        "mark_share": share(_MARKS),
        "symbol_share": share(_SYMBOLS),
        "blank_share": blank / chars,
        "line_words": F.col("_n_words") / lines,
        "distinct_words": F.col("_d_words") / words,
        "distinct_lines": F.col("_d_lines") / lines,
        "letter_share": (F.col("_chars") - F.col("_other")) / chars,
    }
    own = [c for c in size.columns if c not in ("_rest", "_chars", "_other", "_n_words", "_n_lines", "_d_words", "_d_lines")]
    return size.select(*own, *[c.alias(n) for n, c in values.items()])


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is above, cut) must hold."""

    parts: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        out = np.True_
        for name, above, cut in self.parts:
            out = out & ((values[name] > cut) == above)
        return out

    def column(self) -> Column:
        out = None
        for name, above, cut in self.parts:
            part = F.col(name) > F.lit(cut) if above else F.col(name) <= F.lit(cut)
            out = part if out is None else out & part
        return out

    def __str__(self) -> str:
        return " and ".join(f"{name} {'>' if above else '<='} {cut:g}" for name, above, cut in self.parts)


def _simplified(parts: list[tuple[str, bool, float]]) -> tuple:
    """One bound for each statistic and side, in the order of names."""
    tight: dict = {}
    for name, above, cut in parts:
        now = tight.get((name, above))
        tight[name, above] = cut if now is None else (max if above else min)(now, cut)
    return tuple((name, above, cut) for (name, above), cut in sorted(tight.items()))


class _Boosting:
    """Small trees on binned statistics, one after another, each on a seeded half of the rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.y = y
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])) for f in range(x.shape[1])]
        self.codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)
        self.paths: list[tuple] = []

    def run(self, trees: int, depth: int, seed: int) -> list[tuple]:
        rng, mean, every = np.random.default_rng(seed), self.y.mean(), np.arange(len(self.y))
        score = np.full(len(self.y), np.log((mean + 1e-6) / (1 - mean + 1e-6)))
        for _ in range(trees):
            chance = 1 / (1 + np.exp(-score))
            self.slope, self.curve, self.step = self.y - chance, chance * (1 - chance), np.zeros(len(score))
            self._node(np.flatnonzero(rng.random(len(score)) < 0.5), every, depth, [])
            score += 0.3 * self.step
        return list(dict.fromkeys(self.paths))

    def _node(self, learn: np.ndarray, rows: np.ndarray, depth: int, path: list) -> None:
        """Split on `learn`, or give all `rows` the Newton step of `learn`; the path of every child is a rule."""
        split = self._split(learn) if depth else None
        if split is None:
            self.step[rows] = self.slope[learn].sum() / (self.curve[learn].sum() + 1)
            return
        f, at = split
        for above in (False, True):
            side = lambda own: own[(self.codes[own, f] > at) == above]  # noqa: B023, E731
            longer = [*path, (STATISTICS[f], above, float(self.cuts[f][at]))]
            self.paths.append(_simplified(longer))
            self._node(side(learn), side(rows), depth - 1, longer)

    def _split(self, rows: np.ndarray) -> tuple[int, int] | None:
        least, best, found = max(5, int(SUPPORT * len(self.y))), 1e-9, None
        slope, curve = self.slope[rows], self.curve[rows]
        for f, edges in enumerate(self.cuts):
            below = lambda w: np.cumsum(np.bincount(self.codes[rows, f], w, len(edges) + 1))[:-1]  # noqa: B023, E731
            g, h, n = below(slope), below(curve), below(None)
            gain = g * g / (h + 1) + (slope.sum() - g) ** 2 / (curve.sum() - h + 1) - slope.sum() ** 2 / (curve.sum() + 1)
            gain = np.where((n >= least) & (len(rows) - n >= least), gain, 0)
            if len(gain) and gain.max() > best:
                best, found = gain.max(), (f, int(gain.argmax()))
        return found


def lasso(holds: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of the penalised logistic regression, by accelerated proximal steps; the intercept is free."""
    x = np.concatenate([np.ones((len(y), 1), np.float32), holds.astype(np.float32)], axis=1)
    length = np.float32(0.25) * _largest(x) / len(y)
    w = ahead = np.zeros(x.shape[1], np.float32)
    pace = 1.0
    for _ in range(rounds):
        slope = x.T @ (1 / (1 + np.exp(-(x @ ahead))) - y.astype(np.float32)) / len(y)
        new = ahead - slope / length
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - penalty / length, 0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = (new + (pace - 1) / faster * (new - w)).astype(np.float32)
        w, pace = new, faster
    return float(w[0]), w[1:]


def _largest(x: np.ndarray) -> float:
    """The largest eigenvalue of x'x, from above."""
    v = np.ones(x.shape[1], np.float32)
    for _ in range(30):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    return 1.05 * float(np.linalg.norm(x.T @ (x @ v)))


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The chance of label 1 as a column over the statistics."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + rule.column().cast("double") * F.lit(rule.weight)
        return 1 / (1 + F.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 5) -> Ensemble:
    """x: rows of STATISTICS, y: 0 or 1. Without rows every score is 0.5; with one label only, it is near that label for all."""
    if not len(y):
        return Ensemble(0.0, ())
    paths = _Boosting(x, y.astype(float)).run(trees, depth, seed)
    values = {name: x[:, f] for f, name in enumerate(STATISTICS)}
    rules = [Rule(p) for p in paths]
    held = np.stack([r.holds(values) for r in rules], axis=1) if rules else np.zeros((len(y), 0), bool)
    intercept, weights = lasso(held, y, penalty)
    return Ensemble(intercept, tuple(Rule(r.parts, float(w)) for r, w in zip(rules, weights) if w != 0))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> Ensemble:
    """Learn from labelled documents whose crc32(id as text) mod 3 is not 1.

    Null ids and labels teach nothing; of several labels of one id the mean is rounded; labels without a document and repeated documents
    do no harm.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (id_crc() % 3 != 1)).groupBy("doc_id")
        .agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(max_rows).select(F.col("doc_id").alias("_id"), "_label")
    )
    # at most max_rows ids
    found = docs.select(F.col(doc_id).alias("_own"), F.col(text).alias("_text")).join(F.broadcast(known), F.col("_own") == F.col("_id"))
    found = with_statistics(found.select("_id", "_label", F.col("_text").alias("_source")), "_source").drop("_source")
    rows = found.dropDuplicates(["_id"]).orderBy("_id").collect()
    return train(np.array([[r[n] for n in STATISTICS] for r in rows], float).reshape(-1, len(STATISTICS)), np.array([r["_label"] for r in rows], int))


def scored(docs: DataFrame, model: Ensemble, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and the statistics.

    Null and empty texts get the score of their statistics (all shares 0). held_out is false for a null id. Repeated rows are scored one by
    one; an empty table gives no rows. Other columns are not read.
    """
    held_out = F.coalesce(id_crc(doc_id) % 3 == 1, F.lit(False))
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("_source"))
    rows = with_statistics(rows, "_source").withColumn("score", model.score())
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *STATISTICS)
