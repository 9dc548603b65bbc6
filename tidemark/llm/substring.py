"""Repeated word windows across documents, behind a count-min prefilter.

First pass: every bucket of documents writes the anchors of its 13-word windows (the lowest hash of seven
neighbouring words in each) into a count-min sketch. An anchor counts at least as often as each of its windows, so
the merged sketch overestimates how often a window occurs, and never misses a repeated one. Second pass: windows that
it estimates repeated, and only those, are grouped exactly, by their words (`repeats`), and a window that also starts
in a document with a smaller id is removed.

Defined results: a null or empty text has no words; texts of under 13 words lose nothing; rows that repeat an id
(with the same or another text) don't remove from each other, as neither id is smaller; a row without an id loses
nothing and takes nothing from others, as no id is smaller or larger; an empty table gives an empty table; other
columns don't take part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats, sketch
from .common import table
from .suffix import removed

ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
firsts AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts ON firsts.k = win.k WHERE win.doc_id > f)),
words AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) AS t FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id),
n AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_A = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass"))


def runs(texts: Sequence[list[bytes]], width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of neighbouring windows with one anchor: the anchor's hash, the text, the first window, the number of windows."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    w = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(texts)), np.uint64, int(sizes.sum()))
    n = max(len(w) - k + 1, 0)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _A + w[i : i + n]
    low, start, count = repeats.anchored(sketch.mix(h), width - k + 1, repeats.inside(sizes, width))
    return low, *repeats.placed(start, sizes), count


def _spans(row: int, off: list[bool]) -> Iterator[tuple[int, int, int]]:
    lo = 0
    while lo < len(off):
        hi = lo + 1
        while hi < len(off) and off[hi] == off[lo]:
            hi += 1
        if off[lo]:
            yield row, lo, hi - lo
        lo = hi


def judge(rows: repeats.Stretches, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, first windows in them and numbers of windows that also start in a document with a smaller id."""
    order = np.argsort(rows.h, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(rows.h[order]) != 0, True])
    found: list[tuple[int, int, int]] = []
    ids, count = rows.ids.tolist(), rows.count.tolist()
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if hi - lo < 2:
            continue
        classes: dict[bytes, list[int]] = {}
        for i in order[lo:hi].tolist():
            classes.setdefault(rows.text[i], []).append(i)
        if len(classes) == 1:
            some = order[lo:hi].tolist()
            low = min(ids[i] for i in some)
            found += [(i, 0, count[i]) for i in some if ids[i] > low]
            continue
        seen: dict[bytes, int] = {}
        windows = []
        for text, some in classes.items():
            words, low = text.split(b" "), min(ids[i] for i in some)
            windows.append([b" ".join(words[j : j + width]) for j in range(count[some[0]])])
            for w in windows[-1]:
                if seen.get(w, low) >= low:
                    seen[w] = low
        for own, some in zip(windows, classes.values()):
            low_of = [seen[w] for w in own]
            for i in some:
                found += _spans(i, [x < ids[i] for x in low_of])
    yield tuple(np.array(found, np.int64).reshape(-1, 3).T)


class Words(repeats.Kind):
    schema = "n_words long, n_removed long, kept binary"
    within = False

    def __init__(self, width: int, anchor: int):
        self.width, self.anchor = width, anchor

    def cut(self, text: str | None) -> list[bytes]:
        return words_of(text)

    def runs(self, cuts: Sequence[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return runs(cuts, self.width, self.anchor)

    def stretch(self, cut: list[bytes], start: int, count: int) -> bytes:
        return b" ".join(cut[start : start + count + self.width - 1])

    def judge(self, rows: repeats.Stretches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return judge(rows, self.width)

    def report(self, cut: list[bytes], start: np.ndarray, count: np.ndarray) -> tuple[int, int, bytes]:
        if not len(start):
            return len(cut), 0, b" ".join(cut)
        gone = removed(start, count, len(cut), self.width)
        return len(cut), int(gone.sum()), b" ".join([w for w, x in zip(cut, gone.tolist()) if not x])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, anchor: int = 7) -> DataFrame:
    """id, n_words, n_removed, kept (the words that stay, joined by a space; bytes of UTF-8) of every document."""
    if not 0 < anchor <= width <= 254 + anchor:
        raise ValueError("the anchor must fit in the width, and a run's windows in a byte")
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    words = size / 6
    return repeats.remove(df, Words(width, anchor), id_col, text_col, F.col(id_col).cast("long"), size, 2 * words / (width - anchor + 2))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
