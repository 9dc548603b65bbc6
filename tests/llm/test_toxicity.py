"""Toxicity: the kernel against plain loops, held-out accuracy, gapped insults, odd tables."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tidemark.llm import toxicity as tox

_SYLLABLES = ["ba", "do", "ne", "ri", "tu", "sha", "len", "mor", "vi", "pel"]


def prose(rng, n):
    words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    for i in range(7, n, 9):
        words[i] += "."
    return words


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(500):
        words = prose(rng, rng.randint(20, 80))
        if i % 3 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zwickel", "fubbish"]))
        rows.append((" ".join(words), int(i % 3 == 0)))
    return rows


@pytest.fixture(scope="module")
def machine(corpus):
    return tox.train([t for t, _ in corpus[:350]], [y for _, y in corpus[:350]], landmarks=200, negatives=1500)


def test_the_kernel_is_that_of_gapped_subsequences():
    s, begin, end, _ = tox.signs(["an apple a day", "a plain ape"])
    pieces = [s[b : e + tox._REACH] for b, e in zip(begin, end)]
    dense = tox._dense(pieces, np.arange(1 << tox.BITS))

    def plain(x):
        out, n = {}, len(x) - tox._REACH
        for order in (3, 4):
            for at in range(n):
                for rest in itertools.combinations(range(at + 1, at + tox._REACH + 1), order - 1):
                    skipped = rest[-1] - at - (order - 1)
                    if skipped <= tox.GAP:
                        key = tuple(int(x[k]) for k in (at, *rest))
                        out[key] = out.get(key, 0) + tox.DECAY**skipped / n**0.5
        return out

    p = [plain(x) for x in pieces]
    for a, b in itertools.product(range(len(p)), repeat=2):
        want = sum(v * p[b].get(k, 0) for k, v in p[a].items())
        assert float(dense[a] @ dense[b]) == pytest.approx(want, rel=0.02)  # but for features that share a hash


def test_weights_by_feature_are_the_machine_on_landmarks():
    rng = np.random.default_rng(0)
    s, begin, end, _ = tox.signs([" ".join(prose(random.Random(i), 30)) for i in range(12)])
    pieces = [s[b : e + tox._REACH] for b, e in zip(begin, end)][:40]
    y = np.where(rng.random(40) < 0.5, 1.0, -1.0)
    weights, bias = tox.kernel_machine(pieces, y, np.ones(40), pieces[:10])
    every = tox._dense(pieces, np.arange(1 << tox.BITS)).astype(float)
    kernel = every @ every[:10].T
    value, vector = np.linalg.eigh(kernel[:10])
    keep = value > 1e-5 * value.max()
    x = kernel @ (vector[:, keep] / np.sqrt(value[keep]))
    w, b = tox._squared_hinge(x, y, np.ones(40))
    assert np.allclose(every @ weights + bias, x @ w + b, atol=1e-3)


def test_held_out_documents(corpus, machine):
    scores = np.array(machine.score([t for t, _ in corpus[350:]]))
    y = np.array([y for _, y in corpus[350:]])
    assert ((scores >= 0.3) == y).mean() > 0.95


def test_gaps_and_inserted_characters(machine):
    clean = " ".join(prose(random.Random(9), 12))
    plain = machine.score([clean])[0]
    for word in ("zwickel", "z.w.i.c.k.e.l", "zw-ick-el", "zwixckel", "fub*bish", "fu bbish", "FUBBISH"):
        text = clean + f" {word} " + clean + f" {word} {word}."
        assert machine.score([text])[0] > plain + 0.2, word


def test_a_score_does_not_depend_on_its_batch(corpus, machine, monkeypatch):
    texts = [t for t, _ in corpus[:40]] + [None, "", "123 !!", "a" * 5000]
    together = machine.score(texts)
    assert np.allclose(together, [machine.score([t])[0] for t in texts])
    monkeypatch.setattr(tox, "TOGETHER", 100)
    assert np.allclose(together, machine.score(texts))
    assert together[40] == together[41] == together[42]


def test_fit_and_score_on_tables(spark, corpus):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(corpus)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(corpus)], "doc_id long, toxic int")
    got = tox.score(docs, tox.fit(docs, labels)).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(corpus) and len(held) > 60
    assert sum(r["predicted"] == corpus[r["doc_id"]][1] for r in held) > 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_odd_tables(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 0), (7, 0), (None, 1)], "doc_id long, toxic int")
    both = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (7, 1), (8, 0), (5, None)], "doc_id long, toxic int")
    assert tox.score(nothing, tox.fit(nothing, none)).collect() == []
    assert {r["score"] for r in tox.score(odd, tox.fit(odd, none)).collect()} == {0.5}
    assert {r["predicted"] for r in tox.score(odd, tox.fit(odd, one)).collect()} == {0}
    got = tox.score(odd, tox.fit(odd, both)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 9, 10)}) == 1
