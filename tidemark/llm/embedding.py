"""Embedding near-duplicates by a subspace pigeonhole join.

Two unit vectors of cosine c are sqrt(2 - 2c) apart. Vectors are turned by one random rotation, so that no block of
coordinates is poorer than another, and split into blocks; a pair within the squared distance D has a block in which
its squared distance is at most that block's share of D (proportional to its width), else the blocks' sum would be
over D. So each block is range-joined over all its coordinates, and the union of what the blocks find, and nothing
else, is verified by the cosine in double precision.

A label's vectors are dealt into chunks of `chunk_rows`, and a task takes a pair of chunks with all blocks, so every
pair of vectors is met in one task, is decided by one formula, and can't be counted twice. In a task, rows are put in
an order in which near ones stand together, and cut into tiles; a block leaves out the tile pairs whose bounding boxes
are farther apart than its share, and joins the rest by one product of matrices in single precision with room for
rounding. On vectors without any structure boxes prune nothing, since eight coordinates of like spread are only some
shares wide: the range join then is n^2 / 2 products of eight numbers for each block. What it leaves to verify is
0.2 % of the pairs at 64 dimensions. Vectors travel once for each chunk of their label.

Equal vectors of a label are one class from the start, and classes go by a number, not by an id of theirs. A task
gives back numbers of links by vector and a spanning forest of its links, not the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a null
label, link with nothing and are kept as their own component; vectors of unlike lengths don't link; rows without an
id are compared and counted like others, but don't name a component: one that has no other rows has a null
component_id and is kept; rows that repeat an id count as one vector in component_id, also where their vectors
differ, and one by one in n_links; an empty table gives an empty table; other columns don't take part. A threshold
that isn't over -1 and below 1 is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, partitions, table, tidy
from .graph import connected_components

ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a, count(*) AS c FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(c, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM v LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
#: Rows of a tile, and pairs verified at a time.
_TILE, _PAIRS = 256, 1 << 14
#: Room for rounding in single precision, of half squared distances between parts of unit vectors.
_SLACK = 4e-6
#: Copies of a label's row that its vectors are joined with, so that a hot label is spread.
_SALTS = 16


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random rotation, the same on every executor."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def split(dim: int, width: int = 8) -> list[tuple[int, int]]:
    edges = [*range(0, dim, width), dim]
    return list(zip(edges[:-1], edges[1:]))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of doubles, scaled to length one without overflow."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _ordered(x: np.ndarray) -> list[np.ndarray]:
    """Row numbers in tiles, halved along the widest coordinate."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= _TILE:
            done.append(rows)
            continue
        axis = int(np.argmax(np.ptp(x[rows], axis=0)))
        rows = rows[np.argpartition(x[rows, axis], len(rows) // 2)]
        todo += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
    return done


def candidates(left: np.ndarray, right: np.ndarray | None, threshold: float, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (of `left` and `right`, or of `left` alone) that some block's range join finds; each pair once.

    Rows are turned unit vectors.
    """
    dim = left.shape[1]
    parts = split(dim, width)
    share = [(2 - 2 * threshold) * (q - p) / dim for p, q in parts]

    def sides(x: np.ndarray, first: bool) -> list[np.ndarray]:
        """So that a product is half of what a block's share has left over the squared distance."""
        out = []
        for (p, q), d in zip(parts, share):
            half = (x[:, p:q] ** 2).sum(axis=1, keepdims=True) / 2
            one = np.ones_like(half)
            out.append(np.hstack([x[:, p:q], d / 2 - half, one] if first else [x[:, p:q], one, -half]).astype(np.float32))
        return out

    a, b, same = sides(left, True), sides(left if right is None else right, False), right is None
    tiles, tiles2 = _ordered(left), _ordered(left) if same else _ordered(right)
    box = [np.array([f(left[t], axis=0) for t in tiles]) for f in (np.min, np.max)]
    box2 = [np.array([f((left if same else right)[t], axis=0) for t in tiles2]) for f in (np.min, np.max)]
    for n, i in enumerate(tiles):
        gap = np.maximum(0, np.maximum(box[0][n] - box2[1], box2[0] - box[1][n])) ** 2
        reach = np.array([gap[:, p:q].sum(axis=1) <= d + 2 * _SLACK for (p, q), d in zip(parts, share)])
        for m in range(n if same else 0, len(tiles2)):
            j, near = tiles2[m], None
            for k in np.flatnonzero(reach[:, m]).tolist():
                ok = a[k][i] @ b[k][j].T >= -_SLACK
                near = ok if near is None else np.logical_or(near, ok, out=near)
            if near is None:
                continue
            if same and n == m:
                near &= np.triu(np.ones(near.shape, bool), 1)
            x, y = np.nonzero(near)
            for lo in range(0, len(x), _PAIRS):
                yield i[x[lo : lo + _PAIRS]], j[y[lo : lo + _PAIRS]]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest index reachable from each of n by the links a-b."""
    low = np.arange(n)
    while True:
        old = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if (low == old).all():
            return low


def _compare(raw: np.ndarray, weight: np.ndarray, side: np.ndarray, threshold: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows: by row, the weight of its partners; and the lowest row it reaches.

    side: 0 or 1, the chunk that a row is of; all rows are compared if all are 0, else rows of 0 with rows of 1.
    """
    v = units(raw)
    turned = v @ rotation(raw.shape[1])
    links, low = np.zeros(len(v)), np.arange(len(v))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)
    for a, b in candidates(turned[left], None if alone else turned[right], threshold, width):
        a, b = left[a], (left if alone else right)[b]
        keep = np.einsum("ij,ij->i", v[a], v[b]) >= threshold
        a, b = a[keep], b[keep]
        if len(a):
            links += np.bincount(a, weight[b], len(v)) + np.bincount(b, weight[a], len(v))
            low = np.minimum(low, _forest(len(v), np.r_[a, np.arange(len(v))], np.r_[b, low]))
    return links, low


def _join(threshold: float, width: int):
    """Rows come sorted by label, length and chunk pair; one such task's rows are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> pa.RecordBatch | None:
            part = pa.Table.from_batches(held).combine_chunks()
            side = part["side"].to_numpy()
            if len(side) < 2 or at[2] != at[3] and not 0 < side.sum() < len(side):
                return None
            rep, weight = part["rep"].to_numpy(), part["weight"].to_numpy().astype(np.float64)
            raw = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(side), at[1])
            links, low = _compare(raw, weight, side, threshold, width)
            some = np.flatnonzero(links > 0)
            return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(np.rint(links[some]).astype(np.int64)), pa.array(rep[low[some]])], names=["a", "n", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cut = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]).tolist() + [batch.num_rows]
            for p, q in zip(cut[:-1], cut[1:]):
                key = tuple(int(k[p]) for k in keys)
                if key != at and held:
                    if (out := done()) is not None:
                        yield out
                    held = []
                at = key
                held.append(batch.slice(p, q - p))
        if held and (out := done()) is not None:
            yield out

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, width: int = 8, chunk_rows: int = 2048) -> DataFrame:
    """One row per vector: id, n_links (others linked directly), component_id, kept (it has its component's smallest id)."""
    if not -1 < threshold < 1:
        raise ValueError("the threshold must be over -1 and below 1")
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fine = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # zeros of either sign are one, so that equal vectors are equal keys
    good = rows.where(fine).withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast("float") if "float" in dict(rows.dtypes)["v"] else F.when(x == 0, F.lit(0.0)).otherwise(x)))
    named = checkpoint(good.select("id", "label", "v", F.xxhash64("label", "v").alias("h")))
    counted = named.groupBy("label", "h", "v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("weight"))
    classes = checkpoint(counted.withColumn("rep", F.monotonically_increasing_id()))
    members = checkpoint(named.join(classes.select("label", "h", "v", "rep"), ["label", "h", "v"]).select("id", "rep"))
    # into how many chunks a label's vectors of one length are dealt
    dealt = classes.select("rep", "label", F.size("v").alias("dim"), "weight", "v")
    chunks = dealt.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    put = dealt.withColumn("salt", F.pmod("rep", F.lit(_SALTS)).cast("int")).join(chunks, ["label", "dim", "salt"]).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    put = put.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = ["label", "dim", "i", "j"]
    tasks = put.select("label", "dim", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("c") > F.col("o")).cast("int").alias("side"), "rep", "weight", "v")
    parts = partitions(spark, classes.count(), 500)
    found = checkpoint(tasks.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(tidy(_join(threshold, width)), "a long, n long, b long"))
    partners = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    # classes that share an id are of one component
    same = members.where("id IS NOT NULL").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("id", "a")
    same = members.join(same, "id").where("a <> rep").select("a", F.col("rep").alias("b"))
    groups = checkpoint(connected_components(found.select("a", "b").unionByName(same)).withColumnsRenamed({"node": "rep"}))
    lowest = groups.join(classes.select("rep", "first"), "rep").groupBy("component").agg(F.min("first").alias("low"))
    known = classes.select("rep", "weight", "first").join(partners, "rep", "left").join(groups, "rep", "left").join(lowest, "component", "left")
    known = known.select("rep", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("low", "first").alias("component_id"))
    linked = members.join(known, "rep").select("id", "n_links", "component_id")
    alone = rows.where(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
