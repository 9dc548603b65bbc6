"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at three or fewer differing bits meet at a point between them: each emits the points of a
ball around it, and equal points make candidates. Two facts shrink the balls without losing a pair. Fingerprints at
an odd distance differ in parity, so only those of even parity need the ball's second shell; and of three bits, two
lie in the same half of the word, so the second shell needs only the pairs of bits within a half (992 of 2016). An
odd fingerprint then emits its 64 neighbours, an even one itself, 64 neighbours and 992 points.

Points travel as packed arrays, one per task and shard of the point space, not as rows. At a point x the emitters
are x ^ mask with distinct masks of at most two bits, so a shard never holds more than 1057 emitters at a point,
and which of them link follows from the masks: a mask of under two bits links with all, two masks of two bits link
if they share a bit. A shard gives back a spanning forest of its links, never all pairs.

Defined results: a null or empty text has no words and fingerprint zero, which links like any other; ties of bits
count as 0 (over half is asked for); rows that repeat an id are listed as often as they come, and of those that
repeat an id and a text one stays, the one with the largest hash of all its columns (maps left out); a null id comes
after all others; an empty table gives an empty table; other columns, whatever their names, don't take part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, checkpoint, map_rows, partitions, table, tidy, together
from .graph import connected_components

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles hashed at a time, which bounds the memory that a very long text takes.
_STEP = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a whole text over shingles of `width` words, repeats included."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    line, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, k = ends - size, min(width, len(words))
    lo, hi = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(lo), _STEP):
        h = np.array([digest(line[a:b], 42) for a, b in zip(lo[i : i + _STEP], hi[i : i + _STEP])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(lo), bitorder="little")
    return int(bits.view("<u8")[0])


def _text_hash(text_col: str) -> Column:
    """Tells rows apart that share an id or have none."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, fp): h is a hash of the text, fp holds the 64 bits as a signed long."""
    rows = df.select(F.col(id_col).alias("id"), _text_hash(text_col).alias("h"), F.col(text_col).alias("text"))

    def run(cols: dict) -> list:
        fp = np.array([fingerprint(t) for t in cols["text"]], dtype=np.uint64)
        return [cols["id"], cols["h"], fp.view(np.int64)]

    return map_rows(rows, run, f"id {dict(rows.dtypes)['id']}, h long, fp long")


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """All masks, itself first, then single bits, then pairs within a half; and the bits that each has."""
    bits = [()] + [(i,) for i in range(64)] + [(i, j) for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]
    return np.array([sum(1 << i for i in b) for b in bits], dtype=np.uint64), np.array([(b + (-1, -1))[:2] for b in bits], dtype=np.int16)


def _parity(x: np.ndarray) -> np.ndarray:
    for s in (32, 16, 8, 4, 2, 1):
        x = x ^ (x >> np.uint64(s))
    return (x & np.uint64(1)).astype(bool)


def _spread(x: np.ndarray, shards: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def _emit(shards: int, rows: int = 4096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, _ = _masks()
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(every), rows):
                fp = every[lo : lo + rows]
                odd = _parity(fp)
                points, which = [], []
                for part, use in ((fp[odd], np.arange(1, 65)), (fp[~odd], np.arange(len(masks)))):
                    points.append((part[:, None] ^ masks[use][None, :]).ravel())
                    which.append(np.tile(use.astype(np.uint16), len(part)))
                x, m = np.concatenate(points), np.concatenate(which)
                shard = _spread(x, shards)
                order = np.argsort(shard, kind="stable")
                x, m = x[order], m[order]
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                some = [s for s in range(shards) if cuts[s + 1] > cuts[s]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([x[cuts[s] : cuts[s + 1]].tobytes() for s in some], pa.binary()), pa.array([m[cuts[s] : cuts[s + 1]].tobytes() for s in some], pa.binary())],
                    names=["shard", "points", "masks"],
                )

    return run


def _forest(x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the linked fingerprints among the emitters m of the points x of one shard."""
    masks, bits = _masks()
    order = np.lexsort((m, x))  # at a point, masks of fewer bits come first
    x, m = x[order], m[order]
    new = np.r_[True, x[1:] != x[:-1]]
    head = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    fp, top = x ^ masks[m], m[head]
    star = ~new & (top <= 64)  # the first has under two bits: it links with all at its point
    a, b = [fp[star]], [fp[head[star]]]
    rest = top > 64  # all have two bits: those that share one link
    alone = new & np.r_[new[1:], True]
    i = np.flatnonzero(rest & ~alone)
    if len(i):
        pt, ends, who = np.repeat(head[i], 2), bits[m[i]].ravel().astype(np.int64), np.repeat(i, 2)
        order = np.lexsort((who, ends, pt))
        pt, ends, who = pt[order], ends[order], who[order]
        same = (pt[1:] == pt[:-1]) & (ends[1:] == ends[:-1])
        a.append(fp[who[1:][same]])
        b.append(fp[who[:-1][same]])
    return np.concatenate(a), np.concatenate(b)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; a shard is held at a time."""
    at, xs, ms = None, [], []

    def done():
        a, b = _forest(np.concatenate(xs), np.concatenate(ms))
        distance = np.unpackbits((a ^ b).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)
        keep = distance <= 3  # the exact check
        a, b = a[keep].view(np.int64), b[keep].view(np.int64)
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        for s, p, m in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if s != at and xs:
                yield done()
                xs, ms = [], []
            at = s
            xs.append(np.frombuffer(p.as_buffer(), np.uint64))
            ms.append(np.frombuffer(m.as_buffer(), np.uint16))
    if xs:
        yield done()


def fingerprint_components(fps: DataFrame, shard_rows: int = 8192, fine_rows: int = 512) -> DataFrame:
    """(fp) -> (fp, component): component is the smallest fp, as a signed long, reachable by links.

    A shard holds the points of `shard_rows` fingerprints at most (about 560 each, ten bytes a point); as long as
    that needs few shards there are more of them, of `fine_rows`, so that tasks are even.
    """
    distinct = checkpoint(fps.select("fp").distinct())
    n = distinct.count()
    shards = max(1, -(-n // shard_rows), min(-(-n // fine_rows), 16 * int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = partitions(fps.sparkSession, shards, 1)
    # fingerprints are small and what they emit isn't: dealt out by number, not by their own size
    balls = distinct.repartition(partitions(fps.sparkSession, n, 2048), "fp").select("fp").mapInArrow(tidy(_emit(shards)), "shard int, points binary, masks binary")
    edges = balls.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(tidy(_meet), "a long, b long")
    found = connected_components(edges).withColumnsRenamed({"node": "fp"})
    return distinct.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def _grouped(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, fp, low): low is the first row (by id, then h) of the row's group."""
    docs = checkpoint(fingerprints(df, id_col, text_col))
    classes = docs.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("low"))
    named = classes.join(fingerprint_components(docs), "fp")
    lowest = named.groupBy("component").agg(F.min("low").alias("low"))
    return docs.join(named.select("fp", "component").join(lowest, "component").select("fp", "low"), "fp")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (hex), component_id (smallest id reachable by links)."""
    out = _grouped(df, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low.id").alias("component_id"))


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: the one with the smallest id of each group."""
    first = _grouped(df, id_col, text_col).select(F.col("low.id").alias("stay"), F.col("low.h").alias("h")).distinct()
    rows = apart(df, id_col, text_col).withColumn("h", _text_hash("text"))
    stay = rows.join(first, rows["id"].eqNullSafe(first["stay"]) & (rows["h"] == first["h"]), "left_semi")
    return together(stay.groupBy("id", "text").agg(F.max_by("row", "rank").alias("row")), df, text_col)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
