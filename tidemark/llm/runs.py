"""Periodic runs of words, found by Main and Lorentz's division on what repeated k-grams leave, and collapsed.

A run is a stretch of consecutive words with smallest period q, of `min_length` words or more and of `min_exponent`
periods or more, that no word beside it extends. Its words i and i + q are the same, so its overlap with itself has at
least k = min over q of max(min_length, min_exponent * q) - q words (16 for 24 and 3). Every word of a run therefore lies
in a k-gram that its document repeats: words outside such k-grams join no run, and stretches that are left are all that
is searched. K-grams are told by hashes, which may keep a word too much and never lose one.

Each stretch is divided in halves. At a node with middle m, a run that crosses m holds a whole period right or left of
it; for every period up to the node's share the words are extended both ways from (m, m + q) and (m - q, m). A run is met
where the first middle divides it, and lies within that node. Extensions are exact: words 2**j long have names (equal
words, equal names), and an extension is read off the names from the longest down. All nodes of a level, of all stretches
of many documents, are one array. Names take 4 bytes a word and level of what is left of a document, levels being the
logarithm of its longest stretch; tasks take documents by bytes, at least one at a time.

Defined results: a null text has no words; an empty text collapses to the empty text; a null id is carried; rows that
repeat an id or a text are searched each; an empty table gives an empty table; other columns don't take part. Runs that
overlap each drop their own words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

MIN_LENGTH, MIN_EXPONENT = 24, 3
#: Bytes of text that are searched together; a longer document is searched by itself.
TOGETHER = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def overlap(min_length: int, min_exponent: int) -> int:
    """Words of a run that recur one period later, at least."""
    return min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on, where there are k; equal words have equal hashes."""
    block, width, power = _mixed(words.astype(np.uint64) + _ODD), 1, _ODD
    out, done = None, 0
    while True:
        if k & width:
            out = block if out is None else out[: len(words) - done - width + 1] * power + block[done:]
            done += width
        if done == k:
            return out
        block, power, width = block[:-width] * power + block[width:], power * power, 2 * width


def surviving(words: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the stretches of words in k-grams that their document repeats; sizes: words of each document."""
    none = np.zeros(0, np.int64)
    if len(words) < k + 1:
        return none, none
    ends = np.cumsum(sizes)
    document = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(np.arange(len(words)) + k <= ends[document])
    if not len(at):
        return none, none
    with np.errstate(over="ignore"):
        key = _grams(words, k)[at] ^ _mixed(document[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    first = at[again]
    if not len(first):
        return none, none
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, first + k, -1)
    inside = np.cumsum(change[:-1]) > 0
    edge = np.zeros(len(words) + 1, bool)
    edge[0] = edge[-1] = True
    edge[ends[ends < len(words)]] = True
    edge[1:-1] |= inside[1:] != inside[:-1]
    cuts = np.flatnonzero(edge)
    low, high = cuts[:-1], cuts[1:]
    keep = inside[low] & (high > low)
    return low[keep], high[keep]


class _Names:
    """Names of all words 2**j long, for extensions of two places to the right and left."""

    def __init__(self, words: np.ndarray, longest: int):
        self.levels = [np.unique(words, return_inverse=True)[1].astype(np.int32)]
        width = 1
        while 2 * width <= longest:
            last = self.levels[-1]
            pairs = last[:-width].astype(np.int64) << 32 | last[width:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
            width *= 2

    def equal(self, j: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words 2**j long from a and from b on are the same; a < b."""
        names = self.levels[j]
        ok = (a >= 0) & (b < len(names))
        out = np.zeros(len(a), bool)
        out[ok] = names[a[ok]] == names[b[ok]]
        return out

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            got += self.equal(j, a + got, b + got).astype(np.int64) << j
        return got

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words up to and with a and b are the same."""
        got = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            step = got + (1 << j) - 1
            got += self.equal(j, a - step, b - step).astype(np.int64) << j
        return got


def main_lorentz(words: np.ndarray, low: np.ndarray, high: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs within each stretch, by start and period.

    words: numbers, and where a stretch ends before another begins, one that is nowhere else.
    """
    names = _Names(words, int((high - low).max()))
    half = min((overlap(min_length, min_exponent) + 1) // 2, len(words)).bit_length() - 1
    half = min(half, len(names.levels) - 1)
    found = []
    while len(low):
        middle = (low + high) // 2
        many = (high - low) // min_exponent
        q = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1
        m, lo, hi = (np.repeat(x, many) for x in (middle, low, high))
        for a, ok in ((m, m + q <= hi), (m - q, m - q >= lo)):
            # an overlap of k words has half of them on one side of a
            a, p = a[ok], q[ok]
            near = names.equal(half, a, a + p) | names.equal(half, a - (1 << half), a + p - (1 << half))
            a, p = a[near], p[near]
            start, end = a - names.left(a - 1, a + p - 1), a + p + names.right(a, a + p)
            run = end - start >= np.maximum(min_length, min_exponent * p)
            found.append(np.stack([start[run], end[run], p[run]]))
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        whole = high - low >= min_length
        low, high = low[whole], high[whole]
    start, end, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # a stretch that is met with several periods has the smallest, of which the others are multiples
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def find_runs(words: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs; words: numbers of the words of documents of the given sizes, end to end."""
    low, high = surviving(words, sizes, overlap(min_length, min_exponent))
    some = high - low >= min_length
    low, high = low[some], high[some]
    if not len(low):
        return (np.zeros(0, np.int64),) * 3
    sizes = high - low
    offset = np.cumsum(sizes + 1) - sizes - 1  # a word of its own after each stretch
    stretch = np.repeat(np.arange(len(low)), sizes)
    to = np.arange(sizes.sum()) + stretch
    packed = np.empty(int(sizes.sum()) + len(low), np.int64)
    packed[to] = words[to - (offset - low)[stretch]]
    packed[offset + sizes] = -1 - np.arange(len(low))
    start, end, period = main_lorentz(packed, offset, offset + sizes, min_length, min_exponent)
    shift = (low - offset)[np.searchsorted(offset, start, "right") - 1]
    return start + shift, end + shift, period


def _searched(texts: pa.Array, min_length: int, min_exponent: int) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of each text."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, owner = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    full = pc.not_equal(pc.binary_length(flat), 0)
    owner = owner[full.to_numpy(zero_copy_only=False)]
    flat = flat.filter(full)
    sizes = np.bincount(owner, minlength=len(texts))
    offset = np.cumsum(sizes) - sizes
    numbers = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start, end, period = find_runs(numbers, sizes, min_length, min_exponent)
    document = np.searchsorted(offset + sizes, start, "right")
    drop = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, end, -1)
    stay = np.cumsum(drop[:-1]) == 0
    kept = np.concatenate([[0], np.cumsum(np.bincount(owner[stay], minlength=len(texts)))])
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), flat.filter(pa.array(stay, pa.bool_()))), " ")
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - offset[document] if len(start) else start, end - start, period)], ["start", "length", "period"])
    bounds = np.concatenate([[0], np.cumsum(np.bincount(document, minlength=len(texts)))])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), collapsed


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """id, runs (start, length, period; by start, then period), collapsed: the text's words outside repeats, joined by a space.

    A word is dropped where a run holds it after the run's first period. min_exponent is 2 or more.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, TOGETHER + (size[lo - 1] if lo else 0), "right")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *_searched(text.slice(lo, hi - lo), min_length, min_exponent)], names=[id_col, "runs", "collapsed"])
                lo = hi

    return rows.mapInArrow(tidy(run), f"`{id_col}` {dict(rows.dtypes)['id']}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, as exact fractions; of equal ones the first. Null without runs."""
    more = lambda best, x: x["length"] * best["period"] > best["length"] * x["period"]
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)), lambda best, x: F.when(more(best, x), x).otherwise(best))


def planted(text: Column, doc_id: Column) -> Column:
    """The text in which, of one document in ten by its id's CRC, the words from a place on repeat with a period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = F.floor((n - a) / (3 + g % 8)).cast("int") + 1
    rest = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), 1, n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, 1, a), rest), " ")).otherwise(text)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    line = lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
