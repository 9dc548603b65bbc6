"""Leakage canary: text must not predict returns from before its publication."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence
from statistics import fmean

from pyspark import StorageLevel
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import importable
from . import logistic, terms
from .metrics import rank_auc
from .splits import time_holdout

MAX_FEATURES, MIN_DOCS = 2000, 2
#: Words that the driver holds, and that pairs are told by.
OFTEN = 20_000
#: ALL: no fold's number, so the fold left out by a fit on all rows.
ALL, FOLDS, C_GRID = -1, 3, tuple(10.0 ** (8 * i / 4 - 4) for i in range(5))


def verdict(n: Column, auc: Column) -> Column:
    """By the canary's AUC, if there is one and there are rows enough to trust it."""
    return (
        F.when(auc.isNull(), F.lit("INSUFFICIENT_DATA"))
        .when(n < 200, F.lit("INCONCLUSIVE"))
        .when(auc > 0.62, F.lit("FAIL"))
        .when(auc > 0.56, F.lit("WARN"))
        .otherwise(F.lit("PASS"))
    )


def _stops(stop_words: Sequence[str] | None) -> list[str]:
    """By default English stop words."""
    return sorted({w.lower() for w in (StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words)})


def _counted(rows: DataFrame, counts: Callable, kind: str, min_docs: int) -> DataFrame:
    found = rows.mapInArrow(counts, f"term {kind}, df long, c long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("c").alias("c"))
    return found.where(F.col("df") >= min_docs)


def term_weights(df: DataFrame, text: str = "text", max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS, stop_words: Sequence[str] | None = None) -> DataFrame:
    """(term, df, idf) of the terms with the highest counts in at least `min_docs` texts; ties by the term.

    Terms are words of two letters or more, in lower case, without stop words, and pairs of neighbours among them.
    idf is smoothed: ln((1 + n) / (1 + df)) + 1. A pair occurs at most as often as each of its words, so pairs of words
    that are rarer than the last word that could be among the best are left out before they are counted; where more
    than OFTEN words (or max_features) tie there, none is.
    """
    spark, bound, stop = df.sparkSession, max(OFTEN, max_features), _stops(stop_words)
    importable(spark)
    rows = df.select(text)
    single = _counted(rows, terms.words_counted(stop), "string", min_docs).persist(StorageLevel.MEMORY_AND_DISK)
    # the count of the last word that could be among the best, from how many words have each count
    least, left = 0, max_features
    for r in single.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).limit(max_features).collect():
        least, left = r["c"], left - r["n"]
        if left <= 0:
            break
    least = least if left <= 0 else 0
    known = single.where(F.col("c") >= least).limit(bound + 1).collect()
    if len(known) <= bound:
        often = [r["term"] for r in known]
        pairs = _counted(rows, terms.pairs_counted(stop, often), "long", min_docs).where(F.col("c") >= least)
        names, size = spark.createDataFrame(list(enumerate(often)), "i long, word string"), max(1, len(often))
        for i, name in ((F.floor(F.col("term") / size), "a"), (F.col("term") % size, "b")):
            pairs = pairs.join(F.broadcast(names.withColumnRenamed("word", name)), i == F.col("i")).drop("i")
        pairs = pairs.select(F.concat_ws(" ", "a", "b").alias("term"), "df", "c")
    else:
        pairs = _counted(rows, terms.pairs_counted(stop), "string", min_docs).where(F.col("c") >= least)
        known = single.orderBy(F.desc("c"), "term").limit(max_features).collect()
    single.unpersist()
    best = spark.createDataFrame([tuple(r) for r in known], "term string, df long, c long").unionByName(pairs)
    top = best.orderBy(F.desc("c"), "term").limit(max_features).collect()  # the feature itself is a bounded vocabulary
    n = df.count()
    out = spark.createDataFrame([tuple(r) for r in top], "term string, df long, c long")
    return out.select("term", "df", (F.log((F.lit(1.0) + F.lit(n)) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))


def fit_tfidf(df: DataFrame, text: str = "text", stop_words: Sequence[str] | None = None) -> tuple[list[str], list[float]]:
    """The vocabulary, MAX_FEATURES terms at most, and the idf of each."""
    rows = term_weights(df, text=text, stop_words=stop_words).collect()
    return [r["term"] for r in rows], [r["idf"] for r in rows]


def with_tfidf(df: DataFrame, vocabulary: Sequence[str], idf: Sequence[float], text: str = "text", stop_words: Sequence[str] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds `features`, sparse unit vectors of tf * idf, to the columns `keep` (all); zero where a text has no term of the vocabulary."""
    importable(df.sparkSession)
    kept = df.select(*(df.columns if keep is None else keep))
    weights = terms.weights(list(vocabulary) or [""], list(idf) or [0.0], _stops(stop_words))
    return df.select(*kept.columns, F.col(text).alias("__text")).mapInArrow(weights, StructType([*kept.schema.fields, StructField("features", VectorUDT())]))


def tfidf(train: DataFrame, *others: DataFrame, text: str = "text") -> list[DataFrame]:
    """Adds `features`, unit vectors of tf * idf, to train and others; vocabulary and idf are of train alone."""
    vocabulary, idf = fit_tfidf(train, text)
    return [with_tfidf(d, vocabulary, idf, text) for d in (train, *others)]


def feature_totals(rows: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """(term, df, weight): in how many rows each term's feature isn't zero, and its sum; one pass over sparse vectors."""
    summary = rows.select(Summarizer.metrics("numNonZeros", "sum").summary(F.col("features")).alias("s"))
    pairs = F.arrays_zip(F.array(*map(F.lit, vocabulary)).alias("term"), vector_to_array("s.numNonZeros").alias("df"), vector_to_array("s.sum").alias("weight"))
    return summary.select(F.inline(pairs)).select("term", F.col("df").cast("long").alias("df"), "weight") if vocabulary else summary.select(F.lit("").alias("term"), F.lit(0).cast("long").alias("df"), F.lit(0.0).alias("weight")).limit(0)


def logreg_cv(train: DataFrame, sizes: dict[tuple, int], labels: int = 1, grid: tuple[float, ...] = C_GRID, folds: int = FOLDS) -> list[logistic.Model | None]:
    """For each label the logistic regression with the inverse penalty of the best mean AUC over folds, fitted on all rows.

    train: (fold, labels, features), cached. sizes: its rows by fold and labels. All regressions are fitted together;
    None for a label of one class.
    """

    def model(j: int, c: float, k: int) -> logistic.Model | None:
        n, ones = (sum(m for (f, *y), m in sizes.items() if f != k and y[j] >= least) for least in (0, 1))
        return logistic.Model(j, k, 1 / (c * n), n, ones / n) if 0 < ones < n else None

    jobs = {(j, c, k): model(j, c, k) for j in range(labels) for c in grid for k in (ALL, *range(folds))}
    jobs = {k: m for k, m in jobs.items() if m}
    logistic.fit(train, list(jobs.values()))
    tried = {k: m for k, m in jobs.items() if k[2] != ALL}
    aucs = rank_auc(logistic.scored(train, list(tried.values()), own=True), "y", "p", ["model"]).collect() if tried else []
    names, found = list(tried), defaultdict(list)
    for r in aucs:
        if r["auc"] is not None:
            found[names[r["model"]][:2]].append(r["auc"])
    best = [max(grid, key=lambda c: (fmean(found[j, c]) if found[j, c] else -1.0, -c)) for j in range(labels)]
    return [jobs.get((j, c, ALL)) for j, c in enumerate(best)]


def holdout_aucs(events: DataFrame, targets: Sequence[str], text: str, ts: str, key: str) -> list[float | None]:
    """For each target the AUC of text against `target` > 0 on the last part of the rows by time; null under 12 rows or one class.

    The targets share the split, the vocabulary and the features, which are made once and kept without the texts.
    """
    spark, ys = events.sparkSession, [f"__y{i}" for i in range(len(targets))]
    fold = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS)), F.lit(FOLDS)).cast("int")
    # texts stay where they are: the last row of the training part is found among times and keys
    last = time_holdout(events.select(ts, key), ts, key).where("part = 'train'").agg(F.max(F.struct(ts, key)).alias("__last"))
    last = F.broadcast(spark.createDataFrame(last.collect(), last.schema))
    rows = events.select(text, ts, key, fold.alias("fold"), *[(F.col(t) > 0).cast("int").alias(y) for t, y in zip(targets, ys)]).crossJoin(last)
    rows = rows.withColumn("train", F.coalesce(F.struct(ts, key) <= F.col("__last"), F.lit(False))).drop(ts, key, "__last")
    sizes = {tuple(r[:-1]): r[-1] for r in rows.groupBy("train", "fold", *ys).agg(F.count(F.lit(1)).alias("n")).collect()}
    fit = [i for i in range(len(ys)) if len({(k[0], k[2 + i]) for k in sizes}) == 4]
    if sum(sizes.values()) < 12 or not fit:
        return [None] * len(ys)
    vocabulary, idf = fit_tfidf(rows.where("train"), text)
    parts = max(2, 2 * spark.sparkContext.defaultParallelism)
    made = with_tfidf(rows, vocabulary, idf, text, keep=["train", "fold", *ys]).coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)
    sides = {side: made.where(F.col("train") == side).select("fold", *ys, "features") for side in (True, False)}
    models = logreg_cv(sides[True], {k[1:]: n for k, n in sizes.items() if k[0]}, len(ys))
    use = [i for i in fit if models[i]]
    auc = {use[r["model"]]: r["auc"] for r in rank_auc(logistic.scored(sides[False], [models[i] for i in use], own=False), "y", "p", ["model"]).collect()}
    made.unpersist()
    return [auc.get(i) for i in range(len(ys))]


def run_canary(events: DataFrame, text: str = "body_text", ts: str = "acceptanceDateTime", key: str = "event_id", forward: str = "car_0_1", before: str = "car_minus1_0") -> DataFrame:
    """n_events, auc_forward, auc_canary, verdict."""
    rows = events.na.drop(subset=[forward, before])
    n = rows.count()
    aucs = holdout_aucs(rows, (forward, before), text, ts, key)
    one = events.sparkSession.createDataFrame([(n, *aucs)], "n_events long, auc_forward double, auc_canary double")
    return one.withColumn("verdict", verdict(F.col("n_events"), F.col("auc_canary")))
