"""Rows dealt over tasks before work that costs far more than reading them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows whose Python values a task holds at once.
ROWS = 500
#: Rows that one task of a shuffle should get.
TASK_ROWS = 400_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Tasks over which so many rows are dealt: as many more as there are more rows, so none holds more of a larger table."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over tasks by its keys: a table of few bytes is read by one task, however long its rows then take."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ROWS rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)
