"""Risk factors from sectioned CSV files: a preamble, a block of daily rows, a footer."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.returns import join_factors


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of small text files, each whole."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return raw


def read_zip_lines(spark: SparkSession, path: str, encoding: str = "latin-1") -> DataFrame:
    """(file, line_no, line) of the first CSV in each zip file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    member = next(n for n in z.namelist() if n.lower().endswith(".csv"))
                    lines = z.read(member).decode(encoding).splitlines()
                yield pd.DataFrame({"file": name, "line_no": range(len(lines)), "line": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, line_no int, line string")


def sectioned_csv(lines: DataFrame, names: list[str], file: str = "file", missing: float | None = None) -> DataFrame:
    """(file, date, names...) of each file's first unbroken run of lines that begin with eight digits.

    Values are percentages and become fractions; `missing` is a value that stands for none.
    """
    fields = F.split("line", ",")
    daily = lines.where(F.trim(F.get(fields, F.lit(0))).rlike(r"^\d{8}$"))
    run = F.col("line_no") - F.row_number().over(Window.partitionBy(file).orderBy("line_no"))
    # a file's runs have growing numbers, so the first run has the least
    first = daily.withColumn("run", run).withColumn("least", F.min("run").over(Window.partitionBy(file))).where("run = least")

    def value(i: int):
        x = F.expr(f"try_cast(trim(get(split(line, ','), {i})) AS double)")
        return F.when(F.lit(missing is None) | (x != F.lit(missing)), x) / 100 if missing is not None else x / 100

    return first.select(file, F.to_date(F.trim(F.get(fields, F.lit(0))), "yyyyMMdd").alias("date"), *[value(i + 1).alias(n) for i, n in enumerate(names)])


def load_factors(spark: SparkSession, market: str, momentum: str) -> DataFrame:
    """(date, MKT_RF, SMB, HML, RF, MOM) of two zip files, cached: a row a day."""
    three = sectioned_csv(read_zip_lines(spark, market), ["MKT_RF", "SMB", "HML", "RF"]).drop("file")
    mom = sectioned_csv(read_zip_lines(spark, momentum), ["MOM"]).drop("file")
    return join_factors(three, mom).cache()
