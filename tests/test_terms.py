"""The canary's terms, counted by batches, against Spark's own regular expressions and plain loops."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from tidemark.operators import canary, terms

ODD = ["", None, "Σίσυφος ΟΔΟΣ ΑΣ.Β ΣΑΣ", "İstanbul DIŞ", "l’été «mot» — naïve…ÉCOLE", "a b", "x‍y z‌w", "Ⓐⓑ 🅰b ½x²y", "snake_case __ _ 12 1", "नमस्ते दुनिया", "été É", "中文 字", "tab\tand\nnew\r\nline no em", "don't I'll", "THE Market the MARKET"]


def test_places_are_those_of_a_regular_expression(spark):
    """Words of odd texts are the ones that Java's (?U)\\w\\w+ finds in their lower case, without stop words, in order."""
    rng = random.Random(3)
    texts = [*ODD, *("".join(rng.choice("aZéÉßΣσİı_’— .,‍́Ⓐ9²") for _ in range(rng.randint(0, 40))) for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = df.select("i", F.expr(r"regexp_extract_all(lower(coalesce(t, '')), '(?U)\\w\\w+', 0)").alias("w")).collect()
    stop = StopWordsRemover.loadDefaultStopWords("english")
    want = {r.i: [w for w in r.w if w not in stop] for r in found}
    # a slice, as a batch may be one
    words, codes, docs = terms.places(pa.array(["before", *texts], pa.string()).slice(1), pa.array(stop))
    got = {i: [] for i in range(len(texts))}
    for c, d in zip(codes, docs):
        got[int(d)].append(words[int(c)].as_py())
    assert got == want and np.all(np.diff(docs) >= 0)


def test_nothing_is_kept_and_rows_go_by_batches(spark):
    """The terms' plan has no rows of single words and keeps no words of texts."""
    df = spark.createDataFrame([(i, f"red blue w{i % 7} red é{i % 3}") for i in range(50)], "i int, text string")
    before = set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    vocabulary, idf = canary.fit_tfidf(df)
    assert vocabulary[:3] == ["red", "blue", "red blue"] and "w1 red" in vocabulary
    out = canary.with_tfidf(df, vocabulary, idf, keep=["i"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "UDF" not in plan.replace("python_udf", "") and out.columns == ["i", "features"]
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) == before
