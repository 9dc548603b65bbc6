"""Windows of documents that are repeated elsewhere: what `suffix` (bytes) and `substring` (words) share.

A window's anchor is the lowest hash of the k-grams in it, so all occurrences of a window have the same anchor,
wherever they are; neighbouring windows of one anchor form a run, and what covers a run is its stretch of text.
Documents are dealt into buckets by a hash of their id and text, and a bucket speaks for its documents:

1. each bucket writes its anchors into a count-min sketch, which is merged and answered chunk by chunk (`sketch`);
2. of anchors that may be repeated, a bucket sends each distinct stretch once, with its first place in the bucket,
   to the shard of its anchor, however often the bucket has it;
3. a shard compares the stretches of an anchor by their contents, and tells each bucket which windows of a stretch
   are repeats at that first place;
4. the bucket decides for all places: those after the first of an equal stretch repeat it.

So a passage that very many documents share is a row for each bucket, not for each document, and a text of low
entropy, whose stretches are equal, is small. Rows that repeat an id and a text are dealt by their input partition
too, into SALTS buckets at most; a shard then has a place more than once, and answers all with the same. Nothing is broadcast or collected; each step is keyed by what rows
contain and the input's partitions, so a lost task gives the same rows again. The documents are shuffled once and read
from there in steps 1, 2 and 4.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import partitions, release

#: Bytes of text in a bucket, and of an input in a shard of anchors; buckets that equal rows are dealt over.
BUCKET, SHARD, SALTS = 8_000_000, 16_000_000, 1000
#: Bytes of input after which a worker gives memory back.
REST = 16_000_000


class Kind:
    """What a window is. cut: a text's units; runs: of cuts, each run's anchor, the number of its cut, its first window
    and number of windows (a byte's worth); stretch: the bytes that cover a run; judge: see `_shard`; report: output columns of a document."""

    schema: str
    #: Whether equal windows of rows that share an id are repeats, too.
    within: bool

    def cut(self, text: str | None) -> Any: ...

    def runs(self, cuts: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]: ...

    def stretch(self, cut: Any, start: int, count: int) -> bytes: ...

    def judge(self, rows: Stretches) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]: ...

    def report(self, cut: Any, start: np.ndarray, count: np.ndarray) -> tuple: ...


class Stretches(NamedTuple):
    """Rows of a shard: anchor, id and text hash of the document, the run's first window and number of windows, bytes."""

    h: np.ndarray
    ids: np.ndarray
    keys: np.ndarray
    start: np.ndarray
    count: np.ndarray
    text: list[bytes]


#: Hashes looked at together; a position among them fits in the low 24 bits beside a hash.
_SPAN = 1 << 20
_LOW = np.uint64((1 << 24) - 1)


def inside(sizes: np.ndarray, width: int) -> np.ndarray:
    """For each unit of documents that stand one after the other, whether a window that starts there is of one document."""
    end = np.cumsum(sizes)
    edge = np.zeros(int(sizes.sum()) + 1, np.int32)
    np.add.at(edge, np.maximum(end - width + 1, end - sizes), 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) == 0


def placed(start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document that each unit is of, and its place there."""
    end = np.cumsum(sizes)
    doc = np.searchsorted(end, start, "right")
    return doc, start - (end - sizes)[doc]


def anchored(h: np.ndarray, positions: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of valid windows by the lowest, leftmost of equal ones, of each window's `positions` hashes: that hash, the
    first window, the number of windows. Equal windows have theirs at the same distance, so no run has a window twice."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for base in range(0, max(len(h) - positions + 1, 0), _SPAN):
        some = h[base : base + _SPAN + positions - 1]
        low, step = (some & ~_LOW) | np.arange(len(some), dtype=np.uint64), 1
        while 2 * step <= positions:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < positions:
            low = np.minimum(low[: len(low) - (positions - step)], low[positions - step :])
        at, ok = (low & _LOW).astype(np.int64), valid[base : base + len(low)]
        start = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])])
        size, keep = np.diff(np.r_[start, len(at)]), ok[start]
        parts.append((some[at[start[keep]]], start[keep] + base, size[keep]))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


class _Bucket:
    """A bucket's distinct documents in order of id, text hash and text, and the runs of each."""

    def __init__(self, kind: Kind, table: pa.Table):
        self.kind = kind
        ids, keys, texts = (table[c].to_pylist() for c in ("num", "key", "text"))
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, keys[i], texts[i] or ""))
        self.of = np.zeros(len(ids), np.int64)  # the document of each row
        self.ids, self.keys, self.cuts, searched = [], [], [], []
        last: Any = ()
        for i in order:
            now = (ids[i], keys[i], texts[i] or "")
            if now != last:
                cut = kind.cut(texts[i])
                searched.append(cut if ids[i] is not None else cut[:0])
                self.ids.append(ids[i])
                self.keys.append(keys[i])
                self.cuts.append(cut)
                last = now
            self.of[i] = len(self.ids) - 1
        self.h, self.doc, self.start, self.count = kind.runs(searched)

    def ranked(self, runs: np.ndarray) -> np.ndarray:
        """By id, first window and document."""
        ids = np.array([i or 0 for i in self.ids], np.int64)
        return runs[np.lexsort((self.doc[runs], self.start[runs], ids[self.doc[runs]]))]

    def classes(self, runs: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
        """Of runs in order of `ranked`: the class of each, the first run of each class, and its bytes."""
        number: dict[tuple[int, bytes], int] = {}
        of, first, stretch, cuts = [], [], self.kind.stretch, self.cuts
        for r, h, d, s, c in zip(runs.tolist(), self.h[runs].tolist(), self.doc[runs].tolist(), self.start[runs].tolist(), self.count[runs].tolist()):
            key = (h, stretch(cuts[d], s, c))
            n = number.setdefault(key, len(first))
            if n == len(first):
                first.append(r)
            of.append(n)
        return of, first, [t for _, t in number]


def _batch(schema: pa.Schema, columns: Sequence) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns or [[]] * len(schema), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


_seen = 0


def _rest(table: pa.Table) -> None:
    """Gives memory back after every so many bytes of input; giving it back costs as much as a small bucket."""
    global _seen
    _seen += table.nbytes
    if _seen > REST:
        _seen = 0
        release()


_TOUCHED = "chunk int, bucket int, once binary, twice binary"
_ANSWERED = "bucket int, chunk int, bits binary"
_SENT = "shard int, bucket int, h binary, docs binary, ids binary, keys binary, start binary, count binary, size binary, text binary"
_JUDGED = "bucket int, docs binary, start binary, first binary, n binary"


def _touch(kind: Kind, form: sketch.Shape):
    out = _arrow(_TOUCHED)

    def run(table: pa.Table) -> pa.Table:
        found = list(sketch.touched(_Bucket(kind, table).h, form))
        bucket = table["bucket"][0].as_py()
        _rest(table)
        return _batch(out, [[f[0] for f in found], [bucket] * len(found), [f[1] for f in found], [f[2] for f in found]])

    return run


def _answer(form: sketch.Shape):
    out = _arrow(_ANSWERED)

    def run(table: pa.Table) -> pa.Table:
        packs = list(zip(table["once"].to_pylist(), table["twice"].to_pylist()))
        return _batch(out, [table["bucket"].combine_chunks(), table["chunk"].combine_chunks(), list(sketch.merged(packs, form))])

    return run


def _send(kind: Kind, form: sketch.Shape, shards: int):
    out = _arrow(_SENT)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _batch(out, [])
        b, bucket = _Bucket(kind, docs), docs["bucket"][0].as_py()
        bits = dict(zip(answers["chunk"].to_pylist(), answers["bits"].to_pylist()))
        _, first, text = b.classes(b.ranked(np.flatnonzero(sketch.maybe_repeated(b.h, bits, form))))
        shard = (b.h[first] % np.uint64(shards)).astype(np.int64) if first else np.zeros(0, np.int64)
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True]) if first else np.zeros(1, np.int64)
        run_of, ids, keys = np.array(first, np.int64), np.array([i or 0 for i in b.ids], np.int64), np.array(b.keys, np.int64)
        rows = []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            some = order[lo:hi]
            runs, parts = run_of[some], [text[i] for i in some.tolist()]
            docs_, mine = np.unique(b.doc[runs], return_inverse=True)
            rows.append((
                int(shard[some[0]]), bucket, b.h[runs].tobytes(), sketch.pack(mine.astype(np.uint32)), sketch.pack(np.stack([docs_, ids[docs_]])), keys[docs_].tobytes(), sketch.pack(b.start[runs]), sketch.pack(b.count[runs].astype(np.uint8)),
                sketch.pack(np.array([len(p) for p in parts], np.uint32)), sketch.pack(np.frombuffer(b"".join(parts), np.uint8)),
            ))
        _rest(docs)
        return _batch(out, list(zip(*rows)))

    return run


def _shard(kind: Kind):
    """Judges a shard's stretches: for rows and windows in them (from the first, how many), which are repeats."""

    out = _arrow(_JUDGED)

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for row in table.select(["h", "docs", "ids", "keys", "start", "count", "size", "text"]).to_pylist():
            mine, (docs, ids) = sketch.unpack(row["docs"], np.uint32), sketch.unpack(row["ids"], np.int64).reshape(2, -1)
            whole, end = sketch.unpack(row["text"], np.uint8).tobytes(), np.cumsum(sketch.unpack(row["size"], np.uint32), dtype=np.int64).tolist()
            text = [whole[a:z] for a, z in zip([0, *end[:-1]], end)]
            parts.append((np.frombuffer(row["h"], np.uint64), ids[mine], np.frombuffer(row["keys"], np.int64)[mine], sketch.unpack(row["start"], np.int64), sketch.unpack(row["count"], np.uint8).astype(np.int64), text, docs[mine]))
        h, ids, keys, start, count, docs = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 3, 4, 6))
        bucket = np.repeat(table["bucket"].to_numpy(), [len(p[0]) for p in parts])
        found = list(kind.judge(Stretches(h, ids, keys, start, count, [t for p in parts for t in p[5]])))
        row, first, n = (np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in range(3))
        order = np.lexsort((row, bucket[row]))
        row, first, n = row[order], first[order], n[order]
        cut = np.flatnonzero(np.r_[True, np.diff(bucket[row]) != 0, True]) if len(row) else np.zeros(1, np.int64)
        rows = [(int(bucket[row[a]]), *(sketch.pack(x[a:z]) for x in (docs[row], start[row], first, n))) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())]
        _rest(table)
        return _batch(out, list(zip(*rows)))

    return run


def _decide(kind: Kind, schema: str):
    out = _arrow(schema)

    def run(docs: pa.Table, judged: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _batch(out, [])
        b = _Bucket(kind, docs)
        empty = np.zeros(0, np.int64)
        doc, start, first, n = (np.concatenate([empty, *[sketch.unpack(x, np.int64) for x in judged[c].to_pylist()]]) for c in ("docs", "start", "first", "n"))
        # runs that a shard has spoken about, by document and first window, and those whose anchor the bucket repeats
        told: dict[int, list[tuple[int, int]]] = {}
        if len(doc):
            place = b.doc * (1 << 40) + b.start
            for r, f, c in zip(np.searchsorted(place, doc * (1 << 40) + start).tolist(), first.tolist(), n.tolist()):
                told.setdefault(r, []).append((f, c))
        _, inverse, times = np.unique(b.h, return_inverse=True, return_counts=True)
        wanted = times[inverse] > 1 if len(b.h) else np.zeros(0, bool)
        wanted[list(told)] = True
        runs = b.ranked(np.flatnonzero(wanted))
        of, lead, _ = b.classes(runs)
        gone: dict[int, list[tuple[int, int]]] = {}
        for r, d, s, c, k in zip(runs.tolist(), b.doc[runs].tolist(), b.start[runs].tolist(), b.count[runs].tolist(), of):
            if r != lead[k] and (kind.within or b.ids[d] != b.ids[b.doc[lead[k]]]):
                gone.setdefault(d, []).append((s, c))
            elif lead[k] in told:
                gone.setdefault(d, []).extend((s + f, m) for f, m in told[lead[k]])
        reports = [kind.report(cut, *np.array(gone.get(d, empty), np.int64).reshape(-1, 2).T) for d, cut in enumerate(b.cuts)]
        columns = list(zip(*reports))
        _rest(docs)
        return _batch(out, [docs["id"].combine_chunks(), *([c[d] for d in b.of.tolist()] for c in columns)])

    return run


def remove(df: DataFrame, kind: Kind, id_col: str, text_col: str, number: Column, size: int, anchors: float) -> DataFrame:
    """id and kind.schema of every row. number: the order of documents, a long; rows where it is null aren't searched.

    size: bytes of the input; anchors: about how many it has.
    """
    spark = df.sparkSession
    parts = partitions(spark, size)
    buckets, shards, form = max(4 * parts, size // BUCKET), max(4 * parts, size // SHARD), sketch.shape(anchors)
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(F.col(id_col).alias("id"), number.alias("num"), key.alias("key"), F.col(text_col).alias("text"))
    docs = rows.withColumn("bucket", F.pmod(F.xxhash64("num", "key", F.pmod(F.spark_partition_id(), F.lit(SALTS))), F.lit(buckets)).cast("int")).repartition(parts, "bucket")
    told = docs.groupBy("bucket").applyInArrow(_touch(kind, form), _TOUCHED).repartition(parts, "chunk")
    told = told.groupBy("chunk").applyInArrow(_answer(form), _ANSWERED).repartition(parts, "bucket")
    sent = docs.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_send(kind, form, shards), _SENT).repartition(parts, "shard")
    judged = sent.groupBy("shard").applyInArrow(_shard(kind), _JUDGED).repartition(parts, "bucket")
    schema = f"`{id_col}` {dict(rows.dtypes)['id']}, {kind.schema}"
    return docs.groupBy("bucket").cogroup(judged.groupBy("bucket")).applyInArrow(_decide(kind, schema), schema)
