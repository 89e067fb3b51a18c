"""Content hashes of nodes, edges and whole graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def typed_hash(domain: str, *fields: Column) -> Column:
    """SHA-256 of a domain and fields, each with its length before it, a null apart from an empty one."""
    parts = [F.lit(f"{len(domain)}:{domain}")]
    for f in fields:
        text = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat_ws("|", *parts), 256)


def root_hash(hashes: DataFrame, column: str = "hash") -> DataFrame:
    """One row, root: a tree of hashes in order, by their first six and then three digits, so no task gathers all.

    Equal graphs have equal roots, whatever the order and the partitioning of their rows. Repeated hashes count.
    """
    leaf = hashes.select(F.col(column).alias("h"))
    low = leaf.groupBy(F.substring("h", 1, 6).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    mid = low.groupBy(F.substring("p", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return mid.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("root"))
