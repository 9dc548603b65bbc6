"""Toxicity scores by a support vector machine on subsequences of characters, with Nystrom landmarks.

A sentence is its letters in lower case, words set off by one mark, all else left out, in pieces of SENTENCE signs at
most, which go on for the reach of a subsequence. Features are subsequences of three and of four signs that begin in the
piece, taken with gaps: one of them weighs DECAY to the power of the signs it skips, and skips GAP of them at most. So
`i.d.i.o.t`, `idxiot` and `i d i o t` share features of the word itself. The kernel of two pieces is the product of their
features over the root of both lengths. Features are hashed; the hash is part of the kernel.

Labels are of documents, and most sentences of a marked document are harmless. The machine is first trained on pieces of
the shortest marked documents, where more of them are what the document is marked for, and then, `rounds` times, on those
of each marked document that the last machine finds worst, fewer each time, against the worst and a draw of the others.
Landmarks are drawn from the same pieces, half of either kind. A piece's kernel with the landmarks, times the kernel of
landmarks to the power -1/2, is what a squared-hinge machine is fitted on by Newton's method. As the kernel is a plain
product, landmarks and weights are multiplied once into one weight a feature, and scoring is one look-up a subsequence.

A document's score is a logistic regression on its three worst pieces, the mean of its pieces' losses above the margin,
how many pieces are beyond the boundary, and of how many: one insult counts in a short text, and a chance likeness
doesn't in a long one. Its fit uses documents that the machine wasn't trained on.

Training reads about `train_docs` labelled documents of each label, of up to `train_chars` characters, chosen by a hash
of the id, from rows whose crc32(id as text) mod 4 isn't 2: documented bounds on a classifier's fit. Whole texts are
scored, about TOGETHER characters at a time; a longer text is scored by itself and needs some thirty times its size.

Defined results: a null, empty or letterless text has no sentence, and the score that the regression gives to none; with
no labelled rows, or labels of one kind, the score is that kind's share (0.5 for none), cut to 0.001 to 0.999; rows that
repeat an id are scored each, and equal texts alike; a null id is never held out; an empty table gives an empty table;
other columns don't take part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, release, table
from .langid import part

#: Signs that a subsequence may skip, what each costs, and places of the hashed features.
GAP, DECAY, BITS = 2, 0.6, 17
#: Signs that are scored together at most: a sentence of more is dealt into even pieces.
SENTENCE = 16
_MARK, _END = 1, 2
#: Places after a subsequence's first that it may take.
_REACH = 3 + GAP
#: Characters of texts that are scored together.
TOGETHER = 1 << 20
#: A sentence ends at one of these.
_STOPS = ".!?\n"


def _alphabet() -> np.ndarray:
    """A number for each code point: 0 left out, 1 between words, 2 at a sentence's end, letters from 3 on."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x30000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()[0]
            out[c] = 3 + (ord(low) - 97 if "a" <= low <= "z" else 26 + (ord(low) * 2654435761 >> 7) % 200)
        elif s.isspace():
            out[c] = _MARK
    for s in _STOPS:
        out[ord(s)] = _END
    return out


_SIGNS: list[np.ndarray] = []


def signs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signs, begin, end, text): the signs of all texts, and where each sentence begins and ends, and whose it is.

    Marks between words are one. After each text are as many marks as a subsequence reaches, which no sentence has.
    """
    if not _SIGNS:
        _SIGNS.append(_alphabet())
    sizes = np.array([len(t or "") + _REACH for t in texts], np.int64)
    whole = "".join(x for t in texts for x in (t or "", " " * _REACH))
    s = np.concatenate([_SIGNS[0][np.frombuffer(whole[lo : lo + (1 << 20)].encode("utf-32-le", "surrogatepass"), "<u4")] for lo in range(0, len(whole), 1 << 20)] or [np.zeros(0, np.uint8)])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    pad = np.arange(len(s)) >= np.repeat(np.cumsum(sizes) - _REACH, sizes)
    on = s > 0
    s, owner, pad = s[on], owner[on], pad[on]
    letter = s > _END
    # a stop that only stands within a word (as in i.d.i.o.t) isn't one
    amid = np.zeros(len(s), bool)
    amid[1:-1] = (s[1:-1] == _END) & letter[:-2] & letter[2:]
    s, owner, pad = s[~amid], owner[~amid], pad[~amid]
    letter = s > _END
    ended = np.cumsum(s == _END)
    keep = letter | pad
    keep[:-1] |= letter[1:]  # the last of some marks stands for all
    number, owner, pad = ended[keep], owner[keep], pad[keep]
    s = np.where(letter[keep], s[keep], _MARK).astype(np.uint8)
    new = np.ones(len(s), bool)
    new[1:] = (number[1:] != number[:-1]) | (owner[1:] != owner[:-1]) | pad[1:]
    begin, edges = np.flatnonzero(new & ~pad), np.append(np.flatnonzero(new), len(s))
    end = edges[np.searchsorted(edges, begin, "right")]
    cuts = -(-(end - begin) // SENTENCE)
    each = np.repeat(-(-(end - begin) // np.maximum(cuts, 1)), cuts)
    begin = np.repeat(begin, cuts) + (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * each
    return s, begin, np.minimum(begin + each, np.repeat(end, cuts)), owner[begin]


def features(s: np.ndarray, n: int):
    """(feature at each of the first n places, weight) for each pattern of skipped signs; s goes on for _REACH signs."""
    x = s.astype(np.uint32)
    shift = np.uint32(32 - BITS)
    for a in range(GAP + 1):
        two = x[:n] << np.uint32(8) | x[1 + a : n + 1 + a]
        for b in range(GAP + 1 - a):
            three = two << np.uint32(8) | x[2 + a + b : n + 2 + a + b]
            yield three * np.uint32(0x9E3779B1) >> shift, DECAY ** (a + b)
            for c in range(GAP + 1 - a - b):
                four = three << np.uint32(8) | x[3 + a + b + c : n + 3 + a + b + c]
                yield four * np.uint32(0x85EBCA6B) >> shift, DECAY ** (a + b + c)


def sentence_scores(s: np.ndarray, begin: np.ndarray, end: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each sentence, the weights of the features that begin in it over the root of its length."""
    each = np.zeros(len(s) + 1, np.float64)
    step = 1 << 15
    for lo in range(0, len(s) - _REACH, step):
        n = min(step, len(s) - _REACH - lo)
        sums = np.zeros(n, np.float32)
        for h, w in features(s[lo : lo + n + _REACH], n):
            sums += np.float32(w) * weights[h]
        each[lo + 1 : lo + n + 1] = sums
    total = np.cumsum(each)
    return (total[end] - total[begin]) / np.sqrt(end - begin)


def summaries(scores: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """What each document's score is made of: its three worst sentences, the mean loss above the margin, how many are beyond it, of how many."""
    out = np.zeros((n, 6))
    out[:, :3] = -2
    order = np.lexsort((-scores, owner))
    scores, owner = scores[order], owner[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    top = rank < 3
    out[owner[top], rank[top]] = np.clip(scores[top], -2, 4)
    many = np.bincount(owner, minlength=n)
    out[:, 3] = np.bincount(owner, np.maximum(scores + 1, 0), n) / np.maximum(many, 1)
    out[:, 4] = np.log1p(np.bincount(owner, scores > 0, n))
    out[:, 5] = np.log1p(many)
    return out


@dataclass
class Machine:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = 0.0
    slope: np.ndarray = field(default_factory=lambda: np.zeros(6))
    base: float = 0.0

    def score(self, texts: list[str | None]) -> list[float]:
        """Of each text, in slices of about TOGETHER characters."""
        out, lo = [], 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= TOGETHER):
                size, hi = size + len(texts[hi] or ""), hi + 1
            s, begin, end, owner = signs(texts[lo:hi])
            z = summaries(sentence_scores(s, begin, end, self.weights) + self.bias, owner, hi - lo) @ self.slope + self.base
            out += (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()
            lo = hi
        return out


def _rows(sentences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, feature, value) of all subsequences; a sentence goes on for _REACH signs, at which none begins."""
    sizes = np.array([len(x) for x in sentences])
    s = np.concatenate(sentences)
    place = np.arange(len(s)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = np.flatnonzero(place < np.repeat(sizes - _REACH, sizes))
    owner = np.repeat(np.arange(len(sizes)), sizes)[own]
    scale = (1 / np.sqrt(sizes - _REACH))[owner]
    s = np.append(s, np.zeros(_REACH, np.uint8))
    found = [(owner, h[own].astype(np.int64), w * scale) for h, w in features(s, len(s) - _REACH)]
    return tuple(np.concatenate(x) for x in zip(*found))


def _dense(sentences: list[np.ndarray], bins: np.ndarray) -> np.ndarray:
    """Features at the given places, a row for each sentence."""
    at = np.full(1 << BITS, -1, np.int32)
    at[bins] = np.arange(len(bins))
    row, h, v = _rows(sentences)
    k = at[h]
    ok = k >= 0
    return np.bincount(row[ok].astype(np.int64) * len(bins) + k[ok], v[ok], len(sentences) * len(bins)).reshape(len(sentences), len(bins)).astype(np.float32)


def _squared_hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias of the least |w|^2 / 2 + sum of c max(0, 1 - y f)^2, by Newton's method with step halving."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, ridge = np.zeros(x.shape[1]), np.ones(x.shape[1])
    ridge[-1] = 1e-6
    loss = lambda w: 0.5 * (ridge * w) @ w + (c * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    now = loss(w)
    for _ in range(steps):
        margin = 1 - y * (x @ w)
        a = margin > 0
        grad = ridge * w - 2 * x[a].T @ (c[a] * y[a] * margin[a])
        move = np.linalg.solve(np.diag(ridge) + 2 * x[a].T @ (c[a, None] * x[a]), grad)
        step = 1.0
        while step > 1e-4 and loss(w - step * move) > now - 1e-9:
            step /= 2
        w = w - step * move
        before, now = now, loss(w)
        if before - now < 1e-6 * max(now, 1):
            break
    return w[:-1], float(w[-1])


def kernel_machine(sentences: list[np.ndarray], y: np.ndarray, c: np.ndarray, landmarks: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """(a weight for each feature, bias), fitted through the sentences' kernel with the landmarks."""
    bins = np.unique(_rows(landmarks)[1])
    base = _dense(landmarks, bins)
    kernel = np.concatenate([_dense(sentences[i : i + 128], bins) @ base.T for i in range(0, len(sentences), 128)]).astype(np.float64)
    value, vector = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = value > 1e-5 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    w, bias = _squared_hinge(kernel @ root, y, c)
    weights = np.zeros(1 << BITS, np.float32)
    weights[bins] = base.T.astype(np.float64) @ (root @ w)
    return weights, bias


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, r = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    r[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + r * w
        move = np.linalg.solve(x.T @ ((p * (1 - p) + 1e-9)[:, None] * x) + np.diag(r), grad)
        move *= min(1.0, 5 / max(np.abs(move).max(), 1e-9))
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(texts: list[str], labels: list[int], landmarks: int = 600, rounds: int = 3, per_doc: int = 3, negatives: int = 6000, seed: int = 1) -> Machine:
    """Fits on texts in the given order; landmarks: at most; per_doc: sentences of a marked document that a round takes at most."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Machine(base=float(np.log(p / (1 - p))))
    s, begin, end, owner = signs(texts)
    fold = np.zeros(len(y), int)
    for v in (0, 1):  # every fourth document of either label is kept for the regression
        fold[np.flatnonzero(y == v)] = np.arange((y == v).sum()) % 4
    if any((y[(fold > 0) == k] == v).sum() == 0 for k in (False, True) for v in (0, 1)):
        fold[:] = 1
    rng = np.random.default_rng(seed)
    usable = np.flatnonzero((fold[owner] > 0) & (end - begin >= 4))
    bad, good = usable[y[owner[usable]] == 1], usable[y[owner[usable]] == 0]
    if not len(bad) or not len(good):
        p = float(y.mean())
        return Machine(base=float(np.log(p / (1 - p))))
    piece = lambda k: s[begin[k] : end[k] + _REACH]
    draw = lambda xs, n: np.sort(xs[rng.permutation(len(xs))[:n]])
    scores, weights, bias = None, None, 0.0
    for step in range(rounds + 1):
        if scores is None:
            # in a short marked document more of the pieces are what it is marked for
            many = np.bincount(owner, minlength=len(y))
            plus, minus = bad[np.argsort(many[owner[bad]], kind="stable")][: negatives // 2], draw(good, negatives // 2)
            marks = [*draw(plus, landmarks // 2), *draw(minus, landmarks // 2)]
        else:
            order = bad[np.lexsort((-scores[bad], owner[bad]))]
            rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
            plus = order[(rank == 0) | (rank < per_doc * (rounds + 1 - step)) & (scores[order] > -0.5)]
            ranked = good[np.argsort(-scores[good], kind="stable")]
            hard = ranked[: negatives // 2]
            minus = np.concatenate([hard, draw(ranked[negatives // 2 :], negatives // 2)])
            marks = [*draw(plus, landmarks // 2), *draw(hard[: negatives // 4], landmarks // 4), *draw(minus, landmarks // 4)]
        target = np.repeat([1.0, -1.0], [len(plus), len(minus)])
        cost = np.where(target > 0, 4.0 * max(1.0, len(minus) / len(plus)) ** 0.5, 4.0)
        weights, bias = kernel_machine([piece(k) for k in (*plus, *minus)], target, cost, [piece(k) for k in marks])
        scores = sentence_scores(s, begin, end, weights) + bias
    held = fold == 0 if (fold == 0).any() else np.ones(len(y), bool)
    slope, base = _logistic(summaries(scores, owner, len(y))[held], y[held])
    return Machine(weights, bias, slope, base)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = 1500, train_chars: int = 20_000) -> Machine:
    """Learns from labels of rows whose crc32(id as text) mod 4 isn't 2, about `train_docs` of each label."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (part(id_col, 4) != 2)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return train([], [])
    draw = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("double") / 2.0**32
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, train_docs / n))).otherwise(share)
    few = usable.where(draw < share).limit(2 * train_docs * len(counts))
    rows = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= train_chars)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id")
    got = sorted(rows.select("id", "y", "text").limit(2 * train_docs * len(counts)).collect())
    machine = train([r["text"] for r in got], [r["y"] for r in got])
    release()
    return machine


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, held_out, score, predicted of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(F.col(id_col).alias("id"), (part(id_col, 4) == 2).alias("held"), F.col(text_col).alias("text"))

    def run(cols: dict) -> list:
        found = shared.value.score(cols["text"])
        return [cols["id"], cols["held"], found, [int(x >= threshold) for x in found]]

    return map_rows(rows, run, f"`{id_col}` {dict(rows.dtypes)['id']}, held_out boolean, score double, predicted int")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
