"""Queries over whole tables, where a query checked by SQL takes part of its table or alters it."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.ml.feature import StopWordsRemover

from tidemark.operators import canary
from tidemark.plans import registry


def test_tfidf_whole_texts(spark, tmp_path):
    texts = ["The market, the MARKET. Café naïve 2020, q-1!", "Market of the café: naïve 2020; don't", "Straße und market (of) 2020", "a b c", "", None, "Don't, the. straße"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    stop = set(StopWordsRemover.loadDefaultStopWords("english"))
    count, docs = Counter(), Counter()
    for t in texts:
        words = [w for w in re.findall(r"\b\w\w+\b", (t or "").lower()) if w not in stop]
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        count.update(terms)
        docs.update(set(terms))
    want = {t: (n, math.log((1 + len(texts)) / (1 + n)) + 1) for t, n in docs.items() if n >= 2}
    got = {r.term: (r.df, r.idf) for r in registry.queries()["tfidf_whole_texts"](spark, str(tmp_path)).collect()}
    assert {"market", "café", "naïve", "straße", "2020", "café naïve"} <= set(want) and got.keys() == want.keys()
    assert all(got[t][0] == n and got[t][1] == pytest.approx(idf, abs=1e-6) for t, (n, idf) in want.items())


@pytest.mark.parametrize("often", [20_000, 12])
def test_pairs_of_rare_words_change_nothing(spark, monkeypatch, often):
    """The best terms by brute force, with pairs left out by their words and, where too many words tie, without."""
    monkeypatch.setattr(canary, "OFTEN", often)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["red", "blue", "green", "x1", "x2", *(f"w{k}" for k in range(30))][: rng.choice((5, 35))]) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    count, docs = Counter(), Counter()
    for t in texts:
        w = t.split()
        terms = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        count.update(terms)
        docs.update(set(terms))
    best = sorted((t for t in docs if docs[t] >= 2), key=lambda t: (-count[t], t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n in (8, 40, 5000):
        got = {r.term: r.df for r in canary.term_weights(df, max_features=n, stop_words=[]).collect()}
        assert got == {t: docs[t] for t in best[:n]}


def test_tfidf_features(spark):
    """Unit vectors of tf * idf by hand, with the vocabulary and idf of the training rows alone."""
    train = ["market falls market", "market rises", "falls and rises", None, "unseen once"]
    other = ["market unseen", "nothing known", None]
    rows = [spark.createDataFrame(list(enumerate(t)), "doc_id long, text string") for t in (train, other)]
    vocabulary, idf = canary.fit_tfidf(rows[0])
    assert vocabulary == ["market", "falls", "rises"] and idf == pytest.approx([math.log(6 / 3) + 1] * 3)
    got = [{r.doc_id: r.features.toArray().tolist() for r in d.collect()} for d in canary.tfidf(*rows)]
    assert got[0][0] == pytest.approx([2 / 5**0.5, 1 / 5**0.5, 0]) and got[0][3] == got[0][4] == [0, 0, 0]
    assert got[1] == {0: [1, 0, 0], 1: [0, 0, 0], 2: [0, 0, 0]}
    totals = {r.term: (r.df, r.weight) for r in canary.feature_totals(canary.with_tfidf(rows[0], vocabulary, idf), vocabulary).collect()}
    assert {t: n for t, (n, _) in totals.items()} == {"market": 2, "falls": 2, "rises": 2} and totals["falls"][1] == pytest.approx(1 / 5**0.5 + 1 / 2**0.5)
    assert [r.features.toArray().tolist() for r in canary.tfidf(rows[1].limit(0), rows[1])[1].collect()] == [[0.0]] * 3


def test_calendar_densify(spark, tmp_path):
    """Orders of every priority count, on Monday to Friday; days without orders are zero."""
    rows = [(date(2024, 1, 4), "1-URGENT", 1.5), (date(2024, 1, 4), "5-LOW", 2.0), (date(2024, 1, 6), "5-LOW", 9.0), (date(2024, 1, 9), "3-MEDIUM", 4.0)]
    rows = [(datetime(d.year, d.month, d.day), p, v) for d, p, v in rows]
    spark.createDataFrame(rows, "o_orderdate timestamp, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.day.day: r.v for r in registry.queries()["calendar_densify"](spark, str(tmp_path)).collect()}
    assert got == {4: 3.5, 5: 0.0, 8: 0.0, 9: 4.0}
