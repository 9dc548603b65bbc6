"""Exact duplicates by skew-safe combining, with DataFrame functions only.

Rows are grouped by digest, text and salt. The salt is 0, but for hot digests, those of more than one row in HOT,
whose rows are dealt over `salts` groups by a hash of their id; there are fewer than HOT of these at any size, so
they are what is broadcast. Spark combines where rows lie before anything moves, so a task sends one row for each text
and salt, with the largest id and a count; salt groups merge those; and the winners of a hot digest's salts, HOT times
`salts` at most, are combined globally. Text itself is part of every grouping key, so contents are compared in full at
each stage; the digest in front of it only makes comparisons cheap, and a weak digest changes no result.

Winners go back to the rows by digest and salt, copied to each salt of a hot digest. A digest for which all stages
have found one text needs no text for that; where texts share a digest, they are compared once more. No list of ids
is made anywhere.

Defined results: a null text equals the empty text; rows that repeat one id and text are copies of each other and
count one by one in group_size; a null id never wins over an id, and where a text's rows have none, keep_id is null
and no row is marked as kept, though exact_dedup keeps one; of rows that are equal in id and text, the one that
stays is the one with the largest hash of all its columns (maps left out); an empty table gives an empty table; other
columns, whatever their names, don't take part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, checkpoint, table, together

ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


#: A digest of more than one in so many rows is hot.
HOT = 1000


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _salted(rows: DataFrame, salts: int, hot: int) -> DataFrame:
    """rows (digest, id, ...), whether the digest is hot, and salt: 0, but for hot digests a number below `salts`, by the id."""
    total = rows.count()
    counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    found = checkpoint(counts.where((F.col("n") > 1) & (F.col("n") * hot > total)).select(F.col("digest").alias("found")))  # fewer than `hot` rows
    dealt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    out = rows.join(F.broadcast(found), F.col("digest") == F.col("found"), "left").withColumn("hot", F.col("found").isNotNull())
    return out.withColumn("salt", F.when(F.col("hot"), dealt).otherwise(0)).drop("found")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, hot: int = HOT, digest: Callable[[Column], Column] = _sha) -> DataFrame:
    """One row per input row: id, keep_id (largest id of the equal texts), group_size, kept, text_sha256 (the digest)."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _salted(rows.select(F.unhex(digest(F.col("text"))).alias("digest"), "text", "id"), salts, hot)
    size = [F.max("id").alias("top"), F.count(F.lit(1)).alias("n")]
    merged = rows.groupBy("digest", "text", "salt", "hot").agg(*size)
    merged = checkpoint(merged.select("digest", "salt", "hot", "top", "n", F.when(F.col("hot"), F.col("text")).alias("text")))
    won = merged.where("hot").groupBy("digest", "text").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    won = won.select("digest", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "top", "n").unionByName(merged.where("NOT hot").select("digest", "salt", "top", "n"))
    by = won.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("texts"), F.max("top").alias("keep_id"), F.max("n").alias("group_size"))
    columns = ["id", "keep_id", "group_size", "digest"]
    out = rows.select("digest", "salt", "id").join(by.where("texts = 1"), ["digest", "salt"]).select(columns)
    shared = by.where("texts > 1").select("digest", "salt")
    if not shared.isEmpty():  # texts that share a digest are told apart by themselves
        some = rows.join(shared, ["digest", "salt"])
        best = some.groupBy("digest", "text", "salt").agg(*size).groupBy("digest", "text").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
        out = out.unionByName(some.join(best, ["digest", "text"]).select(columns))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, hot: int = HOT, digest: Callable[[Column], Column] = _sha) -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with the largest id, and just one of it."""
    rows = apart(df, id_col, text_col).withColumn("digest", F.unhex(digest(F.col("text"))))
    best = [F.max("rank").alias("rank"), F.max_by("row", "rank").alias("row")]
    merged = _salted(rows, salts, hot).groupBy("digest", "text", "salt", "hot").agg(*best)
    won = merged.where("hot").groupBy("digest", "text").agg(*best).unionByName(merged.where("NOT hot").select("digest", "text", "rank", "row"))
    return together(won, df, text_col)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))
