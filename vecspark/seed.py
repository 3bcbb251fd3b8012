"""Fill an empty collection from a folder of text files: ``python -m vecspark.seed FOLDER COLLECTION``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """How many documents were added; none if the collection holds any."""
    from .functions.embed import get_embedder
    from .operators.corpus import Corpus
    from .sources.text_files import seed_documents

    parser = argparse.ArgumentParser(prog="vecspark.seed", description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("collection")
    parser.add_argument("--embedder", default="auto")
    parser.add_argument("--dim", type=int, default=384)
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    n = seed_documents(Corpus(spark, given.collection, get_embedder(given.embedder, given.dim)), given.folder)
    print(f"{n} documents added")
    return n


if __name__ == "__main__":
    main()
