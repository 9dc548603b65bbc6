"""Quality scores by a sparse rule ensemble.

Statistics of a text are column expressions. Boosted shallow trees are grown on a sample of labelled rows; every
path from a root is a rule, a conjunction of thresholds on statistics; a logistic regression with an L1 penalty
gives most rules the weight zero; those that are left are compiled, with the link, into one column expression. So
scoring is a scan with no Python in it.

Training reads at most `train_rows` labelled rows, chosen by a hash of the id: a documented bound on a classifier's
fit. Every whole text is scored.

Defined results: a null text is the empty text, and the empty text has a score (all its statistics are zero); with
no labelled rows, or labels of one kind, the score is that kind's share (0.5 for none); rows that repeat an id are
scored each; other columns don't take part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .langid import part


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; zero where a share has nothing to be a share of."""
    chars = F.length(text)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda w: w != "")

    def share(top: Column, all_: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), all_.cast("double")), F.lit(0.0))

    def of(symbols: str) -> Column:
        left = text
        for s in symbols:
            left = F.replace(left, F.lit(s), F.lit(""))
        return share(chars - F.length(left), chars)

    return {
        "log_chars": F.log1p(chars.cast("double")),
        "symbols": of("#$%&*@^~<>{}[]\\="),
        "bars": of("|"),
        "exclaims": of("!?"),
        "stops": of(".,;:"),
        "digits": of("0123456789"),
        "capitals": share(chars - F.length(F.regexp_replace(text, r"\p{Lu}+", "")), chars),
        "word_length": share(chars, F.size(words)),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "word_growth": share(F.log1p(F.size(F.array_distinct(words)).cast("double")), F.log1p(F.size(words).cast("double"))),
        "line_words": share(F.size(words), F.size(lines)),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
    }


#: A rule: (statistic, whether above, threshold), all of which must hold.
Rule = tuple[tuple[str, bool, float], ...]


def _holds(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = None
    for name, above, cut in rule:
        side = x[name] > cut if above else x[name] <= cut
        out = side if out is None else out & side
    return out


def _tree(names: list[str], x: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> tuple[np.ndarray, list[Rule]]:
    """One step of boosting: what it adds to each row, and the rules of its paths."""
    step, rules = np.zeros(len(x)), []

    def grow(at: np.ndarray, path: Rule, left: int) -> None:
        best = (1e-6, None)
        gs, hs = g[at].sum(), h[at].sum()
        if left and len(at) >= 20:
            for k in range(len(names)):
                n = len(cuts[k]) + 1
                a = np.cumsum(np.bincount(bins[at, k], g[at], n))[:-1]
                b = np.cumsum(np.bincount(bins[at, k], h[at], n))[:-1]
                if len(a):
                    gain = a * a / (b + 1) + (gs - a) ** 2 / (hs - b + 1) - gs * gs / (hs + 1)
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], (k, j))
        if best[1] is None:
            step[at] = rate * gs / (hs + 1)
            return
        k, j = best[1]
        low = bins[at, k] <= j
        for side, above in ((at[low], False), (at[~low], True)):
            rule = (*path, (names[k], above, float(cuts[k][j])))
            rules.append(rule)
            grow(side, rule, left - 1)

    grow(np.arange(len(x)), (), depth)
    return step, rules


def _simple(rule: Rule) -> Rule:
    """The tightest threshold of each statistic and side, in order."""
    best: dict[tuple[str, bool], float] = {}
    for name, above, cut in rule:
        old = best.get((name, above))
        best[name, above] = cut if old is None else (max(old, cut) if above else min(old, cut))
    return tuple((n, a, c) for (n, a), c in sorted(best.items()))


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[float, Rule]]

    def expression(self) -> Column:
        """The score, over columns named as the statistics."""
        z = F.lit(self.bias)
        for weight, rule in self.rules:
            holds = None
            for name, above, cut in rule:
                side = F.col(name) > cut if above else F.col(name) <= cut
                holds = side if holds is None else holds & side
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        z = np.full(len(next(iter(x.values()))), self.bias)
        for weight, rule in self.rules:
            z += weight * _holds(rule, x)
        return 1 / (1 + np.exp(-z))


def train(x: dict[str, np.ndarray], y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, penalty: float = 5e-4, rounds: int = 600) -> Ensemble:
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Ensemble(float(np.log(p / (1 - p))), [])
    names = list(x)
    data = np.stack([x[n] for n in names], axis=1)
    cuts = []
    for k in range(len(names)):
        q = np.unique(np.quantile(data[:, k], np.linspace(0, 1, 65)))
        cuts.append((q[1:] + q[:-1]) / 2)
    bins = np.stack([np.searchsorted(cuts[k], data[:, k]) for k in range(len(names))], axis=1)
    f, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        step, more = _tree(names, data, cuts, bins, y - p, p * (1 - p), depth, rate)
        f = f + step
        rules.update({_simple(r): None for r in more})
    kept = {}
    for r in rules:  # one rule of those that hold on the same rows
        v = _holds(r, x)
        if 0 < v.sum() < len(y):
            kept.setdefault(v.tobytes(), (r, v))
    if not kept:
        return Ensemble(float(np.log(y.mean() / (1 - y.mean()))), [])
    m = np.stack([v for _, v in kept.values()], axis=1).astype(np.float64)
    mean, scale = m.mean(axis=0), m.std(axis=0)
    m = (m - mean) / scale
    w, b, t = np.zeros(m.shape[1]), 0.0, 1.0
    z, zb = w.copy(), b
    rate = 4.0 / (np.linalg.norm(m, 2) ** 2 / len(y) + 1)
    for _ in range(rounds):  # accelerated proximal gradient steps on the L1-penalised logistic loss
        r = 1 / (1 + np.exp(-(m @ z + zb))) - y
        new = z - rate * (m.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb, nt = zb - rate * r.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    w = w / scale
    left = [(float(a), r) for a, (r, _) in zip(w, kept.values()) if abs(a) > 1e-9]
    return Ensemble(float(b - w @ mean), left)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = 20_000) -> Ensemble:
    """Learns from labels of rows whose crc32(id as text) mod 4 isn't 2, `train_rows` of them at most."""
    usable = labels.where(F.col(label_col).isNotNull() & (part(id_col, 4) != 2)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    n = usable.count()
    draw = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("double") / 2.0**32
    few = usable.where(draw < min(1.0, 0.98 * train_rows / max(n, 1))).limit(train_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(few), "id")
    stats = statistics(F.col("text"))
    got = rows.select("id", "y", *[c.alias(k) for k, c in stats.items()]).limit(2 * train_rows).collect()
    got.sort(key=tuple)  # the fit doesn't depend on the order in which rows arrive
    return train({k: np.array([r[k] for r in got], dtype=float) for k in stats}, np.array([r["y"] for r in got], dtype=float))


def score(docs: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, held_out, score, predicted of every row's whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in statistics(text).items()])
    out = out.select("id", model.expression().alias("score"))
    return out.select(F.col("id").alias(id_col), (part("id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
