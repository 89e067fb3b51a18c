"""Results as text, JSON and lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.recursion import cut


def lines(rows: DataFrame, how: str = "text", limit: int | None = None) -> DataFrame:
    """Rows in order as (value): tab-separated text or lines of JSON; the limit applies after the order."""
    ordered = rows.orderBy(*rows.columns)
    ordered = ordered if limit is None else ordered.limit(limit)
    if how == "ndjson":
        return ordered.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    return ordered.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("value"))


def json_array(rows: DataFrame) -> DataFrame:
    """S19. All rows as one JSON array (value), one line for each: brackets stand on lines of their own.

    The rows are lines in order, so no task holds them all.
    """
    spark = rows.sparkSession
    body = cut(lines(rows, "ndjson").withColumn("k", F.monotonically_increasing_id()))  # numbered once, for the last one too
    last = body.agg(F.max("k").alias("last"))
    body = body.crossJoin(last).select(F.col("k"), F.concat("value", F.when(F.col("k") < F.col("last"), ",").otherwise("")).alias("value"))
    ends = spark.createDataFrame([(-1, "["), ((1 << 62), "]")], "k long, value string")
    return body.union(ends).orderBy("k").select("value")


def write(rows: DataFrame, path: str, how: str = "text") -> None:
    """Write to a folder, as text, lines of JSON or Parquet."""
    if how == "parquet":
        rows.write.mode("overwrite").parquet(path)
    else:
        lines(rows, how).write.mode("overwrite").text(path)


def lsp(diagnostics: DataFrame) -> DataFrame:
    """S20. Diagnostics as JSON with ranges that count from zero.

    Where a diagnostic has the text of its file and its bytes (source, start, end), the range is theirs, in code
    units of UTF-16; otherwise it is the beginning of its line.
    """
    line = F.coalesce(F.col("line") - 1, F.lit(0))
    own = {"source", "start", "end"} <= set(diagnostics.columns)

    def point(byte: str):
        plain = F.struct(line.alias("line"), F.lit(0).cast("long").alias("character"))
        if not own:
            return plain
        at = text.position(F.col("source"), F.col(byte))
        return F.when(at.isNotNull(), F.struct(at["line"].alias("line"), at["utf16"].alias("character"))).otherwise(plain)

    return diagnostics.select(F.to_json(F.struct("severity", "code", "path", "line", "message", F.struct(point("start").alias("start"), point("end").alias("end")).alias("range"))).alias("value"))
