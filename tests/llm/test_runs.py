"""Periodic runs against brute force over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import runs


def brute(w, min_length=24, min_exponent=3):
    found = {}
    for q in range(1, len(w) // min_exponent + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)]
        i = 0
        while i < len(same):
            j = i
            while j < len(same) and same[j]:
                j += 1
            if j > i and j + q - i >= max(min_length, min_exponent * q):
                found.setdefault((i, j + q), q)  # the smallest period comes first
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda x: (x[0], x[2]))


def told(words):
    """n_runs, start, length, period, exponent_milli and both digests of one document."""
    found = brute(words)
    best = max(found, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
    drop = {i for s, e, q in found for i in range(s + q, e)}
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (len(found), *top, sha(listed), sha(kept))


@pytest.mark.parametrize(("length", "exponent"), [(24, 3), (6, 2), (10, 2), (9, 3), (24, 4)])
def test_runs_of_many_documents_together(length, exponent):
    rng = random.Random(length * exponent)
    for _ in range(60):
        docs = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(0, 140))]
            for _ in range(rng.randint(0, 4)):
                base = [rng.randrange(6) for _ in range(rng.randint(1, 20))]
                at = rng.randrange(len(w) + 1)
                w[at : at + 80] = [base[i % len(base)] for i in range(min(rng.randint(0, 80), len(w) - at))]
            docs.append(w)
        sizes = np.array([len(w) for w in docs])
        got = runs.find_runs(np.array([x for w in docs for x in w], np.int64), sizes, length, exponent)
        offset = np.cumsum(sizes) - sizes
        want = [(s + o, e + o, q) for w, o in zip(docs, offset.tolist()) for s, e, q in brute(w, length, exponent)]
        assert list(zip(*(x.tolist() for x in got))) == want


def test_words_outside_repeated_grams_are_left_out():
    assert runs.overlap(24, 3) == 16
    w = np.array([*range(100), *([7, 8, 9] * 10), *range(200, 300)])
    low, high = runs.surviving(w, np.array([len(w)]), 16)
    assert (low.tolist(), high.tolist()) == ([100], [130])


def test_a_long_text_of_one_word_is_one_run(spark):
    df = spark.createDataFrame([(1, "ha " * 200_000)], "doc_id long, text string")
    r = runs.periodic_runs(df).collect()[0]
    assert [tuple(x) for x in r["runs"]] == [(0, 200_000, 1)] and r["collapsed"] == "ha"


def test_the_query_against_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in runs.op13_runs(spark, sf).collect()}
    assert set(got) == set(docs)
    some = 0
    for i, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if n > 2000:
            continue
        if h % 10 == 0 and n:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        want = told(words)
        some += want[0]
        assert got[i] == want, i
    assert some


def test_odd_tables(spark, odd, nothing):
    assert runs.periodic_runs(nothing).collect() == []
    got = {(r["doc_id"], r["collapsed"], len(r["runs"])) for r in runs.periodic_runs(odd).collect()}
    assert (3, "", 0) in got and (4, "", 0) in got and (10, "\xa0", 0) in got and (6, "word", 1) in got
    assert runs.periodic_runs(odd).count() == odd.count()
    nulls = spark.createDataFrame([(None, "a b " * 20), (None, None)], "doc_id long, text string")
    assert sorted(r["collapsed"] for r in runs.periodic_runs(nulls).collect()) == ["", "a b"]
    with pytest.raises(ValueError):
        runs.periodic_runs(odd, min_exponent=1)
