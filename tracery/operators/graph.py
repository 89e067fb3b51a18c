"""Queries over a typed graph: callers and callees, citations, governance, coverage, listings.

Frames: symbols (id, path, name, kind, exported, top_level), calls (caller, target, text, kind) with a null
target where a call is not resolved, links (note, target), governed (decision, path), sources (path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import parent_dir
from .recursion import kept

# Relationship kinds that run code.
EXECUTABLE = ["call", "delegate"]
#: Rows of each side of a name that meet at once, and rows that one task of such meetings should give.
BLOCK, MET = 1 << 10, 1 << 22


def executable(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("kind").isin(EXECUTABLE))


def _reached(direct: DataFrame, asked: DataFrame, named: DataFrame) -> DataFrame:
    """(symbol, by), distinct: the rows of direct (symbol, by), and those of asked (by, key) with all that have the key in named (symbol, key).

    A key that many ask for and many have gives as many rows as both multiplied. So rows are made distinct before they
    meet, and behind it only those of symbols with several keys; what direct repeats is left out of direct. They meet in
    blocks of BLOCK by BLOCK rows, over as many tasks as the rows that they give ask for.
    """
    spark = direct.sparkSession
    named = named.where("key is not null").distinct()
    asked = kept(asked.distinct().join(named.select("key").distinct(), "key", "left_semi").select("by", "key"))
    own = direct.join(named.select("symbol", "key"), "symbol", "left").withColumnRenamed("by", "_by")
    again = asked.select(F.col("by"), F.col("key").alias("_key"), F.lit(True).alias("_again"))
    own = own.join(again, F.col("_by").eqNullSafe(F.col("by")) & (F.col("key") == F.col("_key")), "left")
    own = own.groupBy("symbol", "_by").agg(F.count("_again").alias("_again")).where("_again = 0").select("symbol", F.col("_by").alias("by"))
    keyed = kept(named.withColumn("_keys", F.count("*").over(Window.partitionBy("symbol"))))
    sizes = asked.groupBy("key").agg(F.count("*").alias("_l")).join(keyed.groupBy("key").agg(F.count("*").alias("_r")), "key")
    rows = sizes.agg(F.sum(F.col("_l") * F.col("_r"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, -(-rows // MET))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    block = lambda of, n: F.pmod(F.xxhash64(of), blocks(n)).cast("int").alias(f"_at{n}")
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1)).alias(f"_at{n}")
    at = ["key", "_at_l", "_at_r"]
    left = asked.join(sizes, "key").select("by", "key", block("by", "_l"), each("_r")).repartition(tasks, *at)
    right = keyed.join(sizes, "key").select("symbol", "_keys", "key", each("_l"), block("symbol", "_r")).repartition(tasks, *at)
    met = lambda which: left.join(right.where(which), at).select("symbol", "by")
    return own.union(met("_keys = 1")).union(met("_keys > 1").distinct())


def callers(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(symbol, caller), distinct: executable edges to the symbol, and unresolved calls by its name."""
    edges = executable(calls).withColumnRenamed("caller", "by")
    by_id = edges.join(symbols.select(F.col("id").alias("target")).distinct(), "target").select(F.col("target").alias("symbol"), "by")
    by_name = edges.where("target is null").select("by", F.col("text").alias("key"))
    return _reached(by_id, by_name, symbols.select(F.col("id").alias("symbol"), F.col("name").alias("key"))).withColumnRenamed("by", "caller")


def callees(calls: DataFrame) -> DataFrame:
    """(caller, callee), distinct: an edge's target, or the text of a call that is not resolved."""
    return executable(calls).select("caller", F.coalesce("target", "text").alias("callee")).distinct()


def attack_surface(symbols: DataFrame, calls: DataFrame, entry: Column) -> DataFrame:
    """Symbols that are exported, entry points, or at top level and never called."""
    called = executable(calls).where("target is not null").select(F.col("target").alias("id")).distinct()
    open_ = symbols.where(F.coalesce("exported", F.lit(False)) | F.coalesce(entry, F.lit(False)))
    rest = symbols.where(~(F.coalesce("exported", F.lit(False)) | F.coalesce(entry, F.lit(False))) & F.col("top_level"))
    return open_.select("id").union(rest.select("id").join(called, "id", "left_anti"))


def references(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """(symbol, note), distinct: notes whose links name the symbol itself or the whole of its path."""
    links = links.select(F.col("note").alias("by"), F.col("target").alias("key"))
    exact = links.join(symbols.select(F.col("id").alias("key")).distinct(), "key").select(F.col("key").alias("symbol"), "by")
    return _reached(exact, links, symbols.select(F.col("id").alias("symbol"), F.col("path").alias("key"))).withColumnRenamed("by", "note")


def undocumented(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """Symbols that no note refers to, by two anti joins."""
    targets = links.select("target").distinct()
    rest = symbols.join(targets, symbols.id == F.col("target"), "left_anti")
    return rest.join(targets, rest.path == F.col("target"), "left_anti")


def cites(links: DataFrame) -> DataFrame:
    """(note, target), distinct; a note may cite itself."""
    return links.where("target is not null").select("note", "target").distinct()


def cited_by(links: DataFrame) -> DataFrame:
    """(target, note), distinct, without notes that cite themselves."""
    return cites(links).where("note <> target").select("target", "note")


def citation_index(notes: DataFrame, links: DataFrame) -> DataFrame:
    """A11. (note, citing, has_outgoing) of notes (note): how many other notes cite it, and whether it cites any, itself included."""
    into = cited_by(links).groupBy(F.col("target").alias("note")).agg(F.count("*").alias("citing"))
    out = cites(links).select("note").distinct().withColumn("_out", F.lit(True))
    return notes.join(into, "note", "left").join(out, "note", "left").select("note", F.coalesce("citing", F.lit(0)).alias("citing"), F.coalesce("_out", F.lit(False)).alias("has_outgoing"))


def targets(declared: DataFrame, links: DataFrame, patterns: DataFrame) -> DataFrame:
    """J7. (note, target), distinct: what a note's frontmatter declares (note, target), where its links lead, and its patterns (note, pattern)."""
    return declared.select("note", "target").union(cites(links)).union(patterns.select("note", F.concat(F.lit("match:"), "pattern"))).distinct()


def orphans(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Notes without an outgoing link (one to itself counts) and without one from another note."""
    return notes.join(links.select("note").distinct(), "note", "left_anti").join(
        links.where("note <> target").select(F.col("target").alias("note")).distinct(), "note", "left_anti"
    )


def governs(governed: DataFrame) -> DataFrame:
    return governed.select("decision", "path").distinct()


def governing(governed: DataFrame, paths: DataFrame) -> DataFrame:
    """J11. (path, decision), distinct: decisions of any status that govern a path; paths may be files (path, file)."""
    return governed.join(paths.select("path", "file"), "path").select(F.col("file").alias("path"), "decision").distinct()


def coverage_total(sources: DataFrame, governed: DataFrame) -> DataFrame:
    """source_files, governed_files, ungoverned_files; all decisions count, whatever their status."""
    n = sources.agg(F.count("*").alias("source_files"))
    g = governed.agg(F.countDistinct("path").alias("governed_files"))
    return n.crossJoin(g).select("source_files", "governed_files", F.greatest(F.col("source_files") - F.col("governed_files"), F.lit(0)).alias("ungoverned_files"))


def coverage_by_module(sources: DataFrame, governed: DataFrame, module: Column | None = None) -> DataFrame:
    """Per directory (or another module of a path): total, governed, ungoverned files."""
    marked = sources.withColumn("module", parent_dir(F.col("path")) if module is None else module)
    marked = marked.join(governed.select("path").distinct().withColumn("_hit", F.lit(1)), "path", "left")
    return marked.groupBy("module").agg(F.count("*").alias("total"), F.count("_hit").alias("governed"), (F.count("*") - F.count("_hit")).alias("ungoverned"))


def coverage_by_owner(decisions: DataFrame, governed: DataFrame) -> DataFrame:
    """Per decision the number of distinct governed files; decisions with none stay."""
    counted = governed.groupBy("decision").agg(F.countDistinct("path").alias("files"))
    return decisions.join(counted, "decision", "left").select("decision", F.coalesce("files", F.lit(0)).alias("files"))


def nodes(sources: DataFrame, notes: DataFrame, symbols: DataFrame, kind: str | None = None) -> DataFrame:
    """Ids by kind: doc and decision list notes, code lists symbols, another kind symbols of it; none lists paths and notes."""
    if kind in ("doc", "decision"):
        return notes.where(F.col("kind") == kind).select("id")
    if kind == "code":
        return symbols.select("id")
    if kind:
        return symbols.where(F.col("kind") == kind).select("id")
    return sources.select(F.col("path").alias("id")).union(notes.select("id"))


def summary(**tables: DataFrame) -> DataFrame:
    """One row of counts, a column for each table."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out
