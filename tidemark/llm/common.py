"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable, table

__all__ = ["apart", "checkpoint", "delete", "importable", "map_rows", "partitions", "release", "shared_folder", "table", "tidy", "together"]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, a folder of our own is set on a local master, as in tests, and removed at its end; on a
    cluster, whose executors can't see it, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, folder: str) -> None:
    """Removes a folder of ours from whatever store it is in."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def apart(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, text, id, rank) of df's rows, so that a row can be carried beside its text as a key, whatever its columns are.

    row holds all columns, but of the text only whether it was null; text is empty where it was. rank orders rows of one
    text: by id, none being the lowest, then by a hash of all columns but maps.
    """
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    ties = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t])
    rows = df.select(whole.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id"), ties.alias("ties"))
    lean = F.struct(*[F.col(f"row.c{i}").isNull().alias(f"c{i}") if c == text_col else F.col(f"row.c{i}") for i, c in enumerate(df.columns)])
    return rows.select(lean.alias("row"), "text", "id", F.struct(F.col("id").isNotNull().alias("some"), "id", "ties").alias("rank"))


def together(rows: DataFrame, df: DataFrame, text_col: str) -> DataFrame:
    """df's columns again, from row and text."""
    return rows.select(*[F.when(~F.col(f"row.c{i}"), F.col("text")).alias(c) if c == text_col else F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)])


def partitions(spark: SparkSession, size: int, each: int = 2_000_000) -> int:
    """As many partitions as the session asks for, but no more than `size` units in parts of `each` need."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each)))


def release() -> None:
    """Gives memory that arrays have left back to the system; allocators keep it else, and workers live on."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and memory given back at the end of its task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def map_rows(df: DataFrame, fn: Callable[[dict], list], schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow over slices of a batch: fn gets the columns as lists and returns columns in schema's order.

    Slices bound what Python holds at a time, whatever the batch size is.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out_schema = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out_schema)
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                cols = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(tidy(run), schema)
