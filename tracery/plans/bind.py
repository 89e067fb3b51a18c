"""Graph frames made of the star-schema tables: parts are symbols, orders call them, suppliers govern and cite them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.spread import parts_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Tasks over which the rows of a table are dealt."""
    return parts_for(spark, table(spark, sf_dir, name).count())


def named(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts: brand is the file, name and brand the symbol's name."""
    return table(spark, sf_dir, "part").select(
        named("part", "p_partkey").alias("id"), F.col("p_brand").alias("path"), F.concat_ws(" ", "p_name", "p_brand").alias("name"),
        F.lower("p_type").alias("kind"), (F.col("p_size") >= 25).alias("exported"), (F.col("p_size") % 5 == 0).alias("top_level"), F.col("p_partkey").alias("seq"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: an order calls a part; large parts are not resolved, returned items are captures."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    return (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").distinct().join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(named("order", "l_orderkey").alias("caller"), F.when(F.col("p_size") <= 45, named("part", "p_partkey")).alias("target"), "text", F.when(F.col("l_returnflag") == "R", "capture").otherwise("call").alias("kind"))
        .distinct()
    )


def governed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers govern the parts of which they ship fifty at once."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select("l_suppkey", "l_partkey").distinct()
    return lines.select(named("supplier", "l_suppkey").alias("decision"), named("part", "l_partkey").alias("path"))


def note_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' links: every tenth supplier's to the brand of a smallest part, all others to the part."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select("l_suppkey", "l_partkey").distinct().join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(named("supplier", "l_suppkey").alias("note"), F.when((F.col("l_suppkey") % 10 == 0) & (F.col("p_size") == 1), F.col("p_brand")).otherwise(named("part", "l_partkey")).alias("target")).distinct()


def user_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's event links to the user of the event before it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    before = e.select((F.col("event_id") + 1).alias("event_id"), F.col("user_id").alias("target"))
    return e.join(before, "event_id").select(F.col("user_id").alias("note"), "target")


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' URLs without scheme, host, query and fragment."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^[a-z]+://[^/]*/|[?#].*$", "").alias("path"))


def supersessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(decisions, edges): a customer's orders by date and key, each superseding the one before; status F is accepted."""
    orders = table(spark, sf_dir, "orders")
    decisions = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("draft").alias("status"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    edges = orders.select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey").over(w).alias("dst")).where("dst is not null")
    return decisions, edges


def shipments(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    """Edges from suppliers to parts shipped before, or since, June 1998."""
    cut = F.lit("1998-06-01").cast("timestamp")
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.where(F.col("l_shipdate") >= cut) if late else lines.where(F.col("l_shipdate") < cut)
    lines = lines.select("l_suppkey", "l_partkey").repartition(parts(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey").distinct()
    return lines.select(named("supplier", "l_suppkey").alias("src"), F.lit("ships").alias("kind"), named("part", "l_partkey").alias("dst"))


def edited_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(before, after): documents as files (path, hash, text); by doc_id % 5 moved and cut, moved and begun anew, moved and cut short, gone, kept."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", (F.col("doc_id") % 5).alias("k"))
    path = lambda folder: F.concat(F.lit(f"{folder}/"), F.col("doc_id").cast("string"))
    lines = F.split("text", "\n")
    head = lambda part: F.array_join(F.slice(lines, F.lit(1), F.ceil(F.size(lines) * part).cast("int")), "\n")
    begun = F.concat(F.lit("begun "), F.col("doc_id").cast("string"), F.regexp_extract("text", r"(?s)^[^\n]*(.*)$", 1))
    later = F.when(F.col("k") == 0, head(0.75)).when(F.col("k") == 1, begun).when(F.col("k") == 2, head(0.25)).when(F.col("doc_id") % 10 == 9, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text"))
    before = docs.select(F.when(F.col("k") == 4, path("kept")).otherwise(path("old")).alias("path"), "text")
    after = docs.where("k <> 3").select(F.when(F.col("k") == 4, path("kept")).otherwise(path("new")).alias("path"), later.alias("text"))
    return tuple(d.select("path", F.sha2("text", 256).alias("hash"), "text") for d in (before, after))


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits (commit, status, path, previous_path): a customer's k-th order moves its file to the path of k % 3; with status P there is no file.

    Customers with an even key have a file before their first order.
    """
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), "o_custkey", F.row_number().over(w).alias("k"), (F.col("o_orderstatus") != "P").alias("there"))
    o = o.withColumn("was", F.coalesce(F.lag("there").over(Window.partitionBy("o_custkey").orderBy("commit")), F.col("o_custkey") % 2 == 0)).where("was or there")
    place = lambda k: F.concat_ws("/", F.col("o_custkey").cast("string"), (k % 3).cast("string"))
    here, gone = place(F.col("k")), place(F.col("k") - 1)
    status = F.when(F.col("was") & F.col("there"), "renamed").when(F.col("there"), "added").otherwise("deleted")
    return o.select("commit", status.alias("status"), F.when(F.col("there"), here).otherwise(gone).alias("path"), F.when(F.col("was") & F.col("there"), gone).alias("previous_path"))


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))
