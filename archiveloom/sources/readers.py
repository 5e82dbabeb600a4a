"""Sources and sinks: whole text files of a tree, wiki lines, Parquet tables partitioned by how they were made."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archiveloom.session import ship


def text_files(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """Rows (name, text): every file of a tree that fits, whole."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, folder: str, glob: str, extract: Callable[[bytes], str | None]) -> DataFrame:
    """Rows (name, text): files of another format through an extractor (one that fails gives null)."""
    ship(spark)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for content in pdf["content"]:
                try:
                    texts.append(extract(bytes(content)))
                except Exception:  # noqa: BLE001 - any reader's failure is that file's, not the job's
                    texts.append(None)
            yield pd.DataFrame({"name": [p.rsplit("/", 1)[-1] for p in pdf["path"]], "text": texts})

    return rows.select("path", "content").mapInPandas(run, "name string, text string")


def wiki_lines(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Rows (file, line_no, line): the lines of each file in order, each with its line end."""
    whole = text_files(spark, folder, glob)
    lines = F.regexp_extract_all("text", F.lit("([^\n]*\n|[^\n]+$)"), F.lit(1))
    return whole.select(F.col("name").alias("file"), F.posexplode(lines).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))


def write_table(df: DataFrame, path: str, **made: str) -> None:
    """A table as Parquet, partitioned by how it was made (``dataset='a', strategy='semantic'``)."""
    for name, value in made.items():
        df = df.withColumn(name, F.lit(value))
    (df.write.partitionBy(*made) if made else df.write).mode("append").parquet(path)


def read_table(spark: SparkSession, path: str, **made: str) -> DataFrame:
    """A table written by :func:`write_table`, of those partitions only."""
    df = spark.read.parquet(path)
    for name, value in made.items():
        df = df.where(F.col(name) == value)
    return df


def once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built and written only where it isn't there yet (summaries, answers and the like, by run). A build that
    broke off left no mark of success and is made anew."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = files.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(files, "_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_edges(df: DataFrame, path: str) -> None:
    """A graph's edges as CSV, for tools outside."""
    df.write.mode("overwrite").option("header", True).csv(path)
