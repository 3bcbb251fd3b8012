"""Dense ids in a stated order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written


def dense_ids(df: DataFrame, order: list[str], out: str, base: int = 0, dealt: bool = False) -> DataFrame:
    """``df`` with ids from ``base`` without gaps in the given order: ranges are sorted apart and offset by their counts.

    With ``dealt`` the partitions of ``df`` are ranges of the order already, one after the other."""
    parts = (df if dealt else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    parts = written(parts.withColumn("__vs_part", F.spark_partition_id()).withColumn("__vs_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranges")
    counts = sorted((r[0], r[1]) for r in parts.groupBy("__vs_part").count().collect())  # one row a partition
    start, rows = base, []
    for p, n in counts:
        rows.append((p, start))
        start += n
    first = F.create_map(*[F.lit(x) for pair in rows for x in pair]) if rows else F.expr("cast(map() as map<int,bigint>)")
    return parts.withColumn(out, F.element_at(first.cast("map<int,bigint>"), F.col("__vs_part")) + F.col("__vs_at")).drop("__vs_part", "__vs_at")
