"""Text files and generated vectors as tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import title_of
from ..functions.vectors import splitmix64


def text_files(spark: SparkSession, folder: str, glob: str = "*.{md,markdown,txt}") -> DataFrame:
    """``(file_name, title, text)`` of a folder's files; a missing folder gives no rows."""
    from .storage import Files

    if not Files(spark).exists(folder):
        return spark.createDataFrame([], "file_name string, title string, text string")
    rows = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", glob).load(folder)
    return rows.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")).select("file_name", title_of("file_name").alias("title"), "text").orderBy("file_name")


def seed_documents(corpus, folder: str) -> int:
    """Add a folder's files if the corpus is empty; how many were added."""
    if corpus.state["version"] and not corpus.chunks().isEmpty():
        return 0
    rows = text_files(corpus.spark, folder)
    n = rows.count()
    if n:
        corpus.add(rows.select("title", "text"))
    return n


def generated_vectors(spark: SparkSession, n: int, dim: int, seed: int = 42, clusters: int = 0) -> DataFrame:
    """``(vec_id, embedding)``: uniform in [-1, 1), or around cluster centres with the sum of four small uniforms."""

    def uniform(index, s):
        return (splitmix64(index, s) >> np.uint64(11)).astype(np.float64) / 2.0**53

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            at = ids[:, None] * dim + np.arange(dim)
            if clusters:
                own = (splitmix64(ids, seed + 1) % np.uint64(clusters)).astype(np.int64)
                x = 2 * uniform(own[:, None] * dim + np.arange(dim), seed + 2) - 1
                for k in range(4):
                    x = x + 0.1 * (uniform(at, seed + 3 + k) - 0.5)
            else:
                x = 2 * uniform(at, seed) - 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], ["vec_id", "embedding"])

    return spark.range(n).withColumnRenamed("id", "vec_id").mapInArrow(run, "vec_id long, embedding array<float>")
