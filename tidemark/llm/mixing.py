"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

A source's documents form blocks. Weights are exact fractions: those given (a float counts as the decimal it is written
as), or whole shares of `slots` in proportion to count ** temperature. Over their common denominator Q, source s has
q_s of a frame's Q slots, w = q_s / Q; its j-th block
is released at floor((j - 1) / w) and due at ceil(j / w), and of the released blocks the one due first takes the
next slot. On one processor this keeps every source within less than one block of its target, w * slot, at every
slot, and a frame ends with each source having had exactly q_s slots. So one frame holds the whole schedule, and no
more of it is made than the documents need; a schedule of over `max_slots` slots is refused, not rounded: block b of a source goes to frame (b - 1) div q_s, at that source's ((b - 1) mod q_s + 1)-th
place of the frame. Positions of documents need no global order and no sequential pass over them.

Ranks within a source come from counts over hash buckets, so a source that holds a third of all rows is spread over
as many buckets as its rows need, not put in one task.

Every document is placed exactly once. As long as all sources last (in_horizon) the targets are met; later frames
hold only those that are left, in proportion to their weights.

Defined results: null is a source of its own; a weight that is missing, zero or negative is refused, and weights of
sources without documents don't count; ties of deadlines go to the larger weight, then the lower name; rows
that repeat an id, or have none, are placed one after the other (where whole rows are placed, by a hash of them); an
empty table gives an empty table; null and empty texts are placed like others; other columns don't take part.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


ORACLE_SQL = """
WITH RECURSIVE cnt AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
sh AS (SELECT source, n, greatest(1, CAST(round(greatest(1000, (SELECT count(*) FROM cnt)) * sqrt(n) / sum(sqrt(n)) OVER ()) AS BIGINT)) AS q FROM cnt),
src AS (SELECT list(source ORDER BY source NULLS FIRST) AS names, list(q ORDER BY source NULLS FIRST) AS qs, CAST(sum(q) AS BIGINT) AS size FROM sh),
run(t, served, pick) AS (
 SELECT CAST(0 AS BIGINT), [CAST(0 AS BIGINT) FOR q IN qs], CAST(0 AS BIGINT) FROM src
 UNION ALL
 SELECT t + 1, list_transform(served, lambda k, i: CASE WHEN i = best THEN k + 1 ELSE k END), best FROM (
  SELECT t, served, list_sort(list_filter(list_transform(served, lambda k, i: {'late': CASE WHEN k < qs[i] AND k * size // qs[i] <= t THEN ((k + 1) * size + qs[i] - 1) // qs[i] END, 'less': -qs[i], 'i': CAST(i AS BIGINT)}), lambda c: c.late IS NOT NULL))[1].i AS best
  FROM run, src WHERE t < size)),
fr AS (SELECT names[pick] AS source, served[pick] AS nth, t - 1 AS pos FROM run, src WHERE t > 0),
rk AS (SELECT doc_id, documents.source, row_number() OVER (PARTITION BY documents.source ORDER BY md5(CAST(doc_id AS VARCHAR) || ':0'), doc_id) AS rank FROM documents),
bl AS (SELECT *, (rank - 1) // 8 + 1 AS block FROM rk),
pl AS (SELECT bl.*, q, (block - 1) // q AS f, (block - 1) % q + 1 AS nth FROM bl JOIN sh ON sh.source IS NOT DISTINCT FROM bl.source),
hz AS (SELECT min(((n + 7) // 8 // q) * size + pos) AS last FROM sh JOIN fr ON fr.source IS NOT DISTINCT FROM sh.source AND fr.nth = ((n + 7) // 8) % q + 1, src)
SELECT doc_id, pl.source, rank, block, f * size + pos AS slot, f * size + (pl.nth - 1) * size // q AS release, f * size + (pl.nth * size + q - 1) // q AS deadline, f * size + pos < last AS in_horizon
FROM pl JOIN fr ON fr.source IS NOT DISTINCT FROM pl.source AND fr.nth = pl.nth, src, hz
"""


def shares(counts: Mapping[str | None, int], weights: Mapping[str | None, float | int | str | Fraction] | None = None, temperature: float = 0.5, slots: int = 1000) -> dict[str | None, int]:
    """Whole slots of a frame for each source: its given weight exactly, or count ** temperature to the nearest 1 / slots, 1 at least."""
    if weights is None:
        raw = {s: n**temperature for s, n in counts.items()}
        total = sum(raw.values()) or 1.0
        return {s: max(1, round(slots * x / total)) for s, x in raw.items()}
    if none := [s for s in counts if not Fraction(str(weights.get(s, 0))) > 0]:
        raise ValueError(f"a weight above zero is needed for each source: {none}")
    given = {s: Fraction(str(weights[s])) for s in counts}
    total = sum(given.values())
    size = math.lcm(*[(w / total).denominator for w in given.values()])
    return {s: int(w / total * size) for s, w in given.items()}


def frame(share: Mapping[str | None, int], most: int | None = None) -> list[tuple[str | None, int, int, int, int]]:
    """(source, place, slot, release, deadline) of each slot of one frame, or its first ones, by earliest deadline among the released."""
    size, out = sum(share.values()), []
    name = {s: (s is not None, s or "") for s in share}
    entry = lambda s, j: (-(-j * size // share[s]), Fraction(-share[s], size), name[s], s, j)
    release = lambda s, j: (j - 1) * size // share[s]
    wait = [(0, name[s], s, 1) for s in share]
    heapq.heapify(wait)
    due: list = []
    for slot in range(size if most is None else min(size, most)):
        while wait and wait[0][0] <= slot:
            _, _, s, j = heapq.heappop(wait)
            heapq.heappush(due, entry(s, j))
        deadline, _, _, s, j = heapq.heappop(due)
        out.append((s, j, slot, release(s, j), deadline))
        if j < share[s]:
            heapq.heappush(wait, (release(s, j + 1), name[s], s, j + 1))
    return out


def _literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table inside the plan."""
    names = [c.split()[0] for c in schema.split(",")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' string', ': string').replace(' long', ': bigint')}>>")))


def _placed(
    df: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: Mapping[str | None, float | int | str | Fraction] | None = None, temperature: float = 0.5,
    slots: int = 1000, block: int = 8, seed: int = 0, bucket_rows: int = 1_000, max_sources: int = 10_000, max_slots: int = 100_000, whole: bool = False,
) -> DataFrame:
    """id, source and place of every row; whole: also row, a struct of all its columns, and ties of ids go by its hash."""
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if whole else []
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), *row)
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()}
    if len(counts) > max_sources:
        raise ValueError(f"more than {max_sources} sources: group them before mixing")
    spark = df.sparkSession
    share = shares(counts, weights, temperature, max(slots, len(counts)))
    size = sum(share.values())
    blocks = {s: -(-n // block) for s, n in counts.items()}
    # by then all blocks are due, and one more of the source that is done first
    need = min(size, max((-(-blocks[s] * size // share[s]) for s in share), default=0) + 1)
    if need > max_slots:
        raise ValueError(f"{need} slots are over {max_slots}: give weights of fewer digits, or larger blocks")
    slots_of = frame(share, need)
    at = {(s, j): slot for s, j, slot, _, _ in slots_of}
    # the first slot at which some source has no block left
    last = min(((blocks[s] // share[s]) * size + at.get((s, blocks[s] % share[s] + 1), need) for s in share), default=0)
    quota = _literal(spark, [(s, share[s], max(1, -(-n // bucket_rows))) for s, n in counts.items()], "s1 string, quota long, buckets long")
    key = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))))
    rows = rows.join(F.broadcast(quota), F.col("source").eqNullSafe(F.col("s1"))).withColumn("key", key)
    # the key's share of its range, in as many buckets as the source's rows need
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * F.col("buckets") / F.lit(16**7)))
    sizes = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ties = [F.xxhash64(*[F.col(f"row.`{c}`") for c, t in df.dtypes if "map<" not in t])] if whole else []
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("key", "id", *ties)))
    ranked = ranked.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("rank", F.col("offset") + F.col("place"))
    plan = _literal(spark, slots_of, "s2 string, j long, at long, rel long, due long")
    placed = ranked.withColumn("block", F.expr(f"(rank - 1) div {block} + 1"))
    placed = placed.withColumn("frame", F.expr("(block - 1) div quota")).withColumn("nth", F.expr("(block - 1) % quota + 1"))
    placed = placed.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s2")) & (F.col("nth") == F.col("j")))
    base = F.col("frame") * size
    return placed.select(
        "id", "source", "rank", "block", (base + F.col("at")).alias("slot"), (base + F.col("rel")).alias("release"),
        (base + F.col("due")).alias("deadline"), (base + F.col("at") < last).alias("in_horizon"), *(["row"] if whole else []),
    )


def mix(
    df: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: Mapping[str | None, float | int | str | Fraction] | None = None, temperature: float = 0.5,
    slots: int = 1000, block: int = 8, seed: int = 0, bucket_rows: int = 1_000, max_sources: int = 10_000, max_slots: int = 100_000,
) -> DataFrame:
    """One row per row of df: id, source, rank (in its source, from 1), block, slot, release, deadline, in_horizon.

    weights: by source, above zero for each, kept exactly; or count ** temperature in whole shares of `slots`. block:
    documents in a block. The counts by source are read to the driver, max_sources at most; more are refused, not cut,
    as are weights whose schedule is longer than max_slots.
    """
    placed = _placed(df, source_col, id_col, weights, temperature, slots, block, seed, bucket_rows, max_sources, max_slots)
    return placed.withColumnsRenamed({"id": id_col, "source": source_col})


def mix_rows(df: DataFrame, source_col: str = "source", id_col: str = "doc_id", **how) -> DataFrame:
    """slot, rank and row, a struct of all columns, of every row of df; nothing is joined by id."""
    return _placed(df, source_col, id_col, whole=True, **how).select("slot", "rank", "row")


def mixed(df: DataFrame, source_col: str = "source", id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of df with all their columns, in the order of the schedule."""
    return mix_rows(df, source_col, id_col, **how).orderBy("slot", "rank", f"row.`{id_col}`").select(*[F.col(f"row.`{c}`") for c in df.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
