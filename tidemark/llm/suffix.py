"""Repeated byte strings across documents by longest-previous-factor arrays.

A string of `length` bytes is removed where it also starts earlier. Windows are dealt by anchors (`repeats`), so that
one group sees all occurrences of its windows, wherever they are. In a group, windows are put in suffix order; the
previous and the next smaller position in that order give the longest previous factor of each, and a window whose
factor has `length` bytes also starts earlier. Equal stretches of text are looked at once, the earliest for all.

Defined results: a null or empty text has no bytes; texts shorter than `length` lose nothing; rows that repeat an id
and a text are one document and lose the same bytes; different texts under one id count as one after the other by
position; rows without an id count as having the largest one, 2^63 - 1, so they come after all others; an empty table
gives an empty table; other columns don't take part. A byte that goes on for megabytes is a few equal stretches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats, sketch
from .common import table

ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), s AS (SELECT doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n FROM d),
win AS (SELECT doc_id, i, md5_number(substring(x, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM s WHERE n >= 100)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
isle AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS before FROM hit)),
span AS (SELECT doc_id, g, min(i) AS lo, max(i) + 100 AS hi FROM isle GROUP BY doc_id, g),
tot AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS removed, CAST(count(*) AS BIGINT) AS spans FROM span GROUP BY doc_id),
gap AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM span UNION ALL SELECT doc_id, max(hi), NULL FROM span GROUP BY doc_id),
kept AS (SELECT gap.doc_id, string_agg(substring(x, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS y FROM gap JOIN s ON s.doc_id = gap.doc_id GROUP BY gap.doc_id)
SELECT s.doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN removed IS NULL THEN x ELSE y END)) AS kept_sha256
FROM s LEFT JOIN tot ON tot.doc_id = s.doc_id LEFT JOIN kept ON kept.doc_id = s.doc_id
"""
#: Stands for a null id.
_LAST = (1 << 63) - 1
_P = 0x9E3779B97F4A7C15
#: Bytes of a text hashed at a time, and windows that are sorted at a time.
_SPAN, _SORT = 1 << 20, 1 << 16


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_P, -1, 1 << 64)
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate([one, np.cumprod(np.full(n, x, np.uint64))]) for x in (_P, inverse))


def runs(texts: Sequence[bytes], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of neighbouring windows with one anchor: the anchor's hash, the text, the first window, the number of windows."""
    whole, sizes = b"".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
    valid = repeats.inside(sizes, length)
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for base in range(0, max(len(whole) - length + 1, 0), _SPAN):
        raw = np.frombuffer(whole, np.uint8)[base : base + _SPAN + length - 1]
        up, down = _powers(1 << max(12, (len(raw) - 1).bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
        h = sketch.mix((total[k:] - total[:-k]) * down[: len(raw) - k + 1])
        low, start, count = repeats.anchored(h, length - k + 1, valid[base : base + len(raw) - length + 1])
        parts.append((low, start + base, count))
    low, start, count = (np.concatenate([p[i] for p in parts]) for i in range(3))
    return low, *repeats.placed(start, sizes), count


def _nearest_smaller(pos: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each, -1 where there is none, by following links until all fit."""
    link = np.arange(-1, len(pos) - 1)
    bad = np.flatnonzero(link >= 0)
    bad = bad[pos[link[bad]] > pos[bad]]
    while len(bad):
        link[bad] = link[link[bad]]
        bad = bad[link[bad] >= 0]
        bad = bad[pos[link[bad]] > pos[bad]]
    return link


def _common(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a and b."""
    out = np.zeros(len(a), np.int64)
    for lo in range(0, len(a), 1 << 14):
        differ = rows[a[lo : lo + (1 << 14)]] != rows[b[lo : lo + (1 << 14)]]
        out[lo : lo + (1 << 14)] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def previous_factors(rows: np.ndarray) -> np.ndarray:
    """Longest previous factor, up to the rows' width, of suffixes given by their first bytes in text order."""
    n, width = rows.shape
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").reshape(-1), kind="stable")
    out = np.zeros(n, np.int64)
    for way in (order, order[::-1]):  # previous smaller positions, then next smaller ones
        near = _nearest_smaller(way)
        some = np.flatnonzero(near >= 0)
        out[way[some]] = np.maximum(out[way[some]], _common(rows, way[some], way[near[some]]))
    return out


def _equal_before(windows: np.ndarray, length: int) -> np.ndarray:
    """The windows that also start earlier, of windows in text order."""
    if len(windows) <= 2 * _SORT:
        return np.flatnonzero(previous_factors(windows) >= length)
    # one very common anchor: windows that begin and end alike are looked at apart from the rest
    ends = [np.ascontiguousarray(x).view(np.uint64).reshape(-1) for x in (windows[:, :8], windows[:, -8:])] if length >= 8 else [windows[:, 0].astype(np.uint64)] * 2
    part = sketch.mix(ends[0] ^ sketch.mix(ends[1])) % np.uint64(-(-len(windows) // _SORT))
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True])
    some = [order[lo:hi] for lo, hi in zip(cut[:-1], cut[1:])]
    return np.sort(np.concatenate([p[previous_factors(windows[p]) >= length] for p in some]))


def judge(rows: repeats.Stretches, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, first windows in them and numbers of windows that also start earlier, by id, position and text hash.

    Rows of one place, of equal documents in several buckets, are judged once.
    """
    order = np.lexsort((rows.keys, rows.start, rows.ids, rows.h))
    h, ids, start, keys = (x[order] for x in (rows.h, rows.ids, rows.start, rows.keys))
    first = np.r_[True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1]) | (start[1:] != start[:-1]) | (keys[1:] != keys[:-1])]
    if first.all():
        yield from _judged(rows, order, length)
        return
    edge = np.r_[np.flatnonzero(first), len(order)]
    place = np.cumsum(first) - 1
    nth = np.empty(len(order), np.int64)
    nth[order] = place
    for row, lo, n in _judged(rows, order[first], length):
        copies = np.diff(edge)[nth[row]]
        at = np.repeat(edge[nth[row]], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        yield order[at], np.repeat(lo, copies), np.repeat(n, copies)


def _judged(rows: repeats.Stretches, order: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    h = rows.h[order]
    group = np.cumsum(np.r_[False, h[1:] != h[:-1]])
    order = order[np.bincount(group, minlength=1)[group] > 1]  # an anchor of one stretch has nothing to compare with
    if not len(order):
        return
    h, count, text = rows.h[order], rows.count[order], [rows.text[i] for i in order.tolist()]
    # equal stretches: the earliest stands for all; bytes are compared, not just their digests
    digest = np.array([xxhash.xxh3_64_intdigest(t) for t in text], np.uint64)
    by = np.lexsort((np.arange(len(h)), digest, h))
    new = np.r_[True, (h[by][1:] != h[by][:-1]) | (digest[by][1:] != digest[by][:-1])]
    first = np.empty(len(h), np.int64)
    first[by] = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    copy = np.array([i != j and text[i] == text[j] for i, j in enumerate(first.tolist())])
    yield order[copy], np.zeros(copy.sum(), np.int64), count[copy]
    # what is left, group by group in text order, for the groups that have two stretches or more
    left = np.flatnonzero(~copy)
    group = np.cumsum(np.r_[False, h[left][1:] != h[left][:-1]])
    left = left[np.bincount(group)[group] > 1]
    if not len(left):
        return
    edge = np.flatnonzero(np.r_[True, h[left][1:] != h[left][:-1], True])
    windows = np.r_[0, np.cumsum(count[left])]
    lo = 0
    while lo < len(edge) - 1:  # whole groups, about _SORT windows at a time
        hi = max(lo + 1, int(np.searchsorted(windows[edge], windows[edge[lo]] + _SORT, "right")) - 1)
        some = left[edge[lo] : edge[hi]]
        size = np.array([len(text[i]) for i in some.tolist()])
        c = count[some]
        who = np.repeat(np.arange(len(some)), c)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(c) - c, c)
        raw = np.frombuffer(b"".join([text[i] for i in some.tolist()]), np.uint8)
        gone = _equal_before(np.lib.stride_tricks.sliding_window_view(raw, length)[(np.cumsum(size) - size)[who] + nth], length)
        if len(gone):
            cut = np.flatnonzero(np.r_[True, (who[gone][1:] != who[gone][:-1]) | (np.diff(gone) != 1), True])
            head = gone[cut[:-1]]
            yield order[some[who[head]]], nth[head], np.diff(cut)
        lo = hi


def removed(start: np.ndarray, count: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which of `size` units the given runs of windows cover."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + count - 1 + length, -1)
    return np.cumsum(edge)[:-1] > 0


class Bytes(repeats.Kind):
    schema = "n_bytes long, n_removed long, n_spans long, kept binary"
    within = True

    def __init__(self, length: int, anchor: int):
        self.length, self.anchor = length, anchor

    def cut(self, text: str | None) -> bytes:
        return (text or "").encode("utf-8", "surrogatepass")

    def runs(self, cuts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return runs(cuts, self.length, self.anchor)

    def stretch(self, cut: bytes, start: int, count: int) -> bytes:
        return cut[start : start + count + self.length - 1]

    def judge(self, rows: repeats.Stretches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return judge(rows, self.length)

    def report(self, cut: bytes, start: np.ndarray, count: np.ndarray) -> tuple[int, int, int, bytes]:
        if not len(start):
            return len(cut), 0, 0, cut
        gone = removed(start, count, len(cut), self.length)
        return len(cut), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), np.frombuffer(cut, np.uint8)[~gone].tobytes()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, anchor: int = 40) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (the bytes that stay) of every document."""
    if not 0 < anchor <= length <= 254 + anchor:
        raise ValueError("the anchor must fit in the length, and a run's windows in a byte")
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    return repeats.remove(df, Bytes(length, anchor), id_col, text_col, number, size, 2 * size / (length - anchor + 2))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
