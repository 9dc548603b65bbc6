"""Language identification by a string kernel.

A text is what n-grams of one to three characters occur in it (presence, not counts); the blended-spectrum kernel of
two texts is the mean over n of the share of common n-grams, |A & B| / sqrt(|A| |B|). Nystrom landmarks, the same
number from each language, turn the kernel into features, and one ridge regression per language (one versus rest) is
fitted on them. A text's kernel with the landmarks, times the fitted matrix, is one product per batch; as the
kernel is linear in presence, landmarks and weights are multiplied once into a matrix of n-grams by languages.

Letters (of Unicode's letter categories; a number sign isn't one) count in lower case; all else is a space. N-grams are hashed into 2**16 bins for each n. Training uses
a sample of `per_lang` texts of each language, of up to `train_chars` characters, chosen by a hash of the id:
documented bounds on a classifier's fit, and on what the driver holds. A language is learned from its texts of that
length or not at all; over `max_langs` languages are refused.
Texts that are scored are read whole.

Defined results: a null, empty or letterless text is `und` with score 0; ties go to the language first in order;
with no labelled rows every text is `und`; rows that repeat an id are scored each; other columns don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, release, table, tidy

_OTHER = regex.compile(r"[^\p{L}]+")
BITS, ORDERS = 16, (1, 2, 3)
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def presence(text: str | None) -> np.ndarray | None:
    """Which bins of hashed n-grams occur, for each n in a row; None without letters."""
    line = _OTHER.sub(" ", (text or "").lower()).strip()
    if not line:
        return None
    c = np.frombuffer(f" {line} ".encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros((len(ORDERS), 1 << BITS), bool)
    for row, n in zip(out, ORDERS):
        if len(c) >= n:
            h = c[: len(c) - n + 1] * _MIX[0]
            for k in range(1, n):
                h = (h ^ (h >> np.uint32(15))) * _MIX[k] + c[k : len(c) - n + 1 + k] * _MIX[0]
            row[(h ^ (h >> np.uint32(13))) * _MIX[1] >> np.uint32(32 - BITS)] = True
    return out


def has_letters(text: str | None) -> bool:
    return bool(_OTHER.sub("", text or ""))


def _scaled(present: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Presence at the given bins, so that a product of two of these is the kernel."""
    size = np.maximum(present.sum(axis=1), 1)
    return present.reshape(-1)[bins].astype(np.float32) * np.repeat(1 / np.sqrt(len(ORDERS) * size), 1 << BITS)[bins].astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    bins: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        found = [(i, p) for i, t in enumerate(texts) if (p := presence(t)) is not None] if self.langs else []
        for lo in range(0, len(found), 128):
            some = found[lo : lo + 128]
            f = np.stack([_scaled(p, self.bins) for _, p in some]) @ self.weights + self.bias
            best = f.argmax(axis=1)
            for (i, _), b, row in zip(some, best, f):
                langs[i], scores[i] = self.langs[b], float(np.clip((row[b] + 1) / 2, 0, 1))
        return langs, scores


def train(rows: list[tuple[str, str]], landmarks: int = 48, ridge: float = 1e-3) -> Model:
    """rows: (text, language). landmarks: of each language.

    Presence of a text is made when it is used: kept for all rows it would be the driver's largest array.
    """
    rows = [(text, lang) for text, lang in rows if has_letters(text)]
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    marks = [presence(t) for lang in langs for t in [t for t, x in rows if x == lang][:landmarks]]
    bins = np.flatnonzero(np.logical_or.reduce(marks).reshape(-1))
    base = np.stack([_scaled(p, bins) for p in marks])
    del marks
    kernel = np.concatenate([np.stack([_scaled(presence(t), bins) for t, _ in rows[i : i + 64]]) @ base.T for i in range(0, len(rows), 64)]).astype(np.float64)
    value, vector = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])  # kernel of landmarks to the power -1/2
    x = kernel @ root
    y = np.array([[1.0 if lang == k else -1.0 for k in langs] for _, lang in rows])
    w = np.array([1 / sum(lang == k for _, k in rows) for _, lang in rows])  # each language weighs the same
    w /= w.sum()
    mx, my = w @ x, w @ y
    xc, yc = x - mx, y - my
    beta = np.linalg.solve(xc.T @ (w[:, None] * xc) + ridge * np.eye(x.shape[1]), xc.T @ (w[:, None] * yc))
    return Model(langs, bins, (base.T.astype(np.float64) @ root @ beta).astype(np.float32), (my - mx @ beta).astype(np.float32))


def part(id_col: str, parts: int) -> Column:
    """The remainder of the id's CRC, -1 for a null id, which is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts, F.lit(-1))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 500, max_langs: int = 500, train_chars: int = 20_000) -> Model:
    """Learns from rows whose crc32(id as text) mod 5 isn't 0, from about `per_lang` of each language."""
    rows = df.where(F.col(lang_col).isNotNull() & (F.length(text_col) <= train_chars) & (part(id_col, 5) != 0)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not counts:
        return train([])
    draw = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("double") / 2.0**32
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))).otherwise(share)
    sample = rows.where(draw < share).limit(2 * per_lang * len(counts)).collect()
    model = train([(r["text"], r["lang"]) for r in sorted(sample, key=lambda r: (r["id"] is None, r["id"]))])
    release()
    return model


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score of every row's whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).alias("id"), (part(id_col, 5) == 0).alias("held"), F.col(text_col).alias("text"))

    def run(cols: dict) -> list:
        return [cols["id"], cols["held"], *shared.value.score(cols["text"])]

    return map_rows(rows, run, f"`{id_col}` {dict(rows.dtypes)['id']}, held_out boolean, lang_pred string, score double")


def keep_languages(df: DataFrame, model: Model, text_col: str = "text", langs: set[str] | None = None, min_score: float = 0.0) -> DataFrame:
    """The rows whose predicted language is wanted (any learned one, by default), with all their columns."""
    shared, at, schema = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                found, score = shared.value.score(some.column(at).to_pylist())
                yield some.filter(pa.array([x != "und" and s >= min_score and (langs is None or x in langs) for x, s in zip(found, score)], pa.bool_()))

    return df.mapInArrow(tidy(run), schema)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
