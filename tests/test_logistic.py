"""Regressions fitted together against Spark's own, one by one; the canary's work in passes, not in fits."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.operators import canary, logistic


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    out = []
    for i in range(700):
        at = sorted(rng.sample(range(30), rng.randint(0, 6)))
        y = int(rng.random() < (0.8 if 3 in at else 0.4))
        out.append((i % 3, y, int(rng.random() < 0.3), Vectors.sparse(31, at, [rng.random() for _ in at])))
    schema = StructType([StructField(n, IntegerType()) for n in ("fold", "a", "b")] + [StructField("features", VectorUDT())])
    return spark.createDataFrame(out, schema).repartition(3).cache()


def test_fits_are_those_of_spark(rows):
    """Weak and strong penalties, folds left out and none, two labels; feature 30 is zero in every row."""
    models = []
    for j, name in enumerate("ab"):
        for c in (1e-2, 1.0, 1e4):
            for k in (-1, 1):
                part = rows.where(F.col("fold") != k)
                n, ones = part.count(), part.where(f"{name} = 1").count()
                models.append(logistic.Model(j, k, 1 / (c * n), n, ones / n))
    passes = logistic.fit(rows, models)
    assert passes < 60
    for m in models:
        part = rows.where(F.col("fold") != m.without)
        want = LogisticRegression(labelCol="ab"[m.label], regParam=m.penalty, standardization=False, maxIter=1000, tol=1e-12).fit(part)
        assert m.w == pytest.approx(want.coefficients.toArray(), abs=2e-3, rel=2e-3) and m.b == pytest.approx(want.intercept, abs=2e-3)
    own = logistic.scored(rows, models[:2], own=True).collect()
    assert {r.model for r in own} == {1} and len(own) == rows.where("fold = 1").count()


def test_targets_share_what_they_can(spark, monkeypatch):
    """Both targets are of one vocabulary and one joint fit; a target of one class has no AUC, the other keeps its own."""
    rng = random.Random(2)
    data = [(i, i // 3, " ".join(rng.choice(("up", "gain")) if i % 2 else rng.choice(("down", "loss")) for _ in range(5)) + f" w{rng.randint(0, 9)}", 0.1 if i % 2 else -0.1, rng.random() - 0.5, 1.0) for i in range(240)]
    events = spark.createDataFrame(data, "event_id long, at long, body_text string, car_0_1 double, car_minus1_0 double, one double").withColumn("ts", F.timestamp_seconds(F.col("at") * 86400))
    calls = []
    for name in ("fit_tfidf", "with_tfidf"):
        monkeypatch.setattr(canary, name, lambda *a, f=getattr(canary, name), n=name, **k: calls.append(n) or f(*a, **k))
    monkeypatch.setattr(logistic, "fit", lambda *a, f=logistic.fit: calls.append("fit") or f(*a))
    got = canary.run_canary(events, ts="ts").first()
    assert calls == ["fit_tfidf", "with_tfidf", "fit"]
    assert got.n_events == 240 and got.auc_forward == 1.0 and 0.2 < got.auc_canary < 0.8
    assert canary.holdout_aucs(events, ["one", "car_0_1"], "body_text", "ts", "event_id") == [None, 1.0]
    assert canary.holdout_aucs(events.limit(11), ["car_0_1"], "body_text", "ts", "event_id") == [None]
