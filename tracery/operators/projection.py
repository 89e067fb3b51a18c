"""Projection of source and note rows to the nodes and edges of a published graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from .hashing import typed_hash
from .ordered import first_wins

# Edge kinds by relationship kind.
EDGE_KINDS = {"call": "calls", "capture": "captures", "delegate": "delegates", "implementation": "implements-for", "protocol": "implements-protocol"}


def symbol_index(symbols: DataFrame) -> DataFrame:
    """(alias, id) of all names that a symbol answers to."""
    return symbols.select(F.explode(F.array_union(F.array("name", "selector"), "aliases")).alias("alias"), "id").distinct()


def edge_kind(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in EDGE_KINDS.items() for x in pair])[kind]


def source_nodes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Nodes of files (path) and symbols (path, selector, kind, name, owner, arity, start_line)."""
    label = F.when(F.col("arity").isNotNull(), F.concat_ws("/", F.concat_ws(".", "owner", "name"), F.col("arity").cast("string"))).otherwise(F.col("name"))
    code = files.select(F.lit(0).alias("phase"), F.lit(0).cast("long").alias("seq"), ids.node_id("code", F.col("path")).alias("id"), F.lit("code").alias("kind"), F.col("path").alias("label"), "path")
    own = symbols.select(
        F.lit(1), F.coalesce(F.col("start_line"), F.lit(0)).cast("long"), ids.node_id("symbol", F.concat_ws("#", "path", "selector")), "kind", label, F.concat("path", F.lit("#L"), F.col("start_line").cast("string"))
    )
    return code.union(own)


def source_edges(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """contains edges, and an edge for each call (path, selector, kind, target, text): an external node where it has no target."""
    owner = F.when(F.col("parent_selector").isNotNull(), ids.node_id("symbol", F.concat_ws("#", "path", "parent_selector"))).otherwise(ids.node_id("code", F.col("path")))
    contains = symbols.select(owner.alias("src"), ids.node_id("symbol", F.concat_ws("#", "path", "selector")).alias("dst"), F.lit("contains").alias("kind"))
    to = F.coalesce(ids.node_id("symbol", F.col("target")), ids.node_id("external-call", F.col("text")))
    return contains.union(calls.select(ids.node_id("symbol", F.concat_ws("#", "path", "selector")), to, edge_kind(F.col("kind"))))


def external_nodes(calls: DataFrame) -> DataFrame:
    """A node for each distinct call text without a target."""
    text = calls.where("target is null").select("text").distinct()
    return text.select(F.lit(2).alias("phase"), F.lit(0).cast("long").alias("seq"), ids.node_id("external-call", F.col("text")).alias("id"), F.lit("external-call").alias("kind"), F.col("text").alias("label"), F.lit(None).cast("string").alias("path"))


def note_nodes(notes: DataFrame) -> DataFrame:
    """Nodes of notes (id, kind, title, path, headings: level, text, line) and their headings; an unknown kind is a doc."""
    kind = F.when(F.col("kind") == "decision", "decision").otherwise("doc")
    own = notes.select(F.lit(3).alias("phase"), F.lit(0).cast("long").alias("seq"), ids.node_id("note", F.col("id")).alias("id"), kind.alias("kind"), F.coalesce("title", "id").alias("label"), "path")
    heads = notes.select("id", "path", F.explode("headings").alias("h"))
    return own.union(heads.select(F.lit(4), F.col("h.line"), ids.heading_id(F.col("id"), F.col("h.text")), F.lit("doc-heading"), "h.text", F.concat("path", F.lit("#L"), F.col("h.line").cast("string"), F.lit(":H"), F.col("h.level").cast("string"))))


def note_edges(notes: DataFrame, resolved: DataFrame, governed: DataFrame) -> DataFrame:
    """Edges of notes: cites and references by resolved links (note, kind, target), governs (decision, path), supersedes, contains.

    A supersedes edge may lead to a decision that does not exist.
    """
    note = lambda c: ids.node_id("note", F.col(c))
    cites = resolved.where("kind = 'note'").select(note("note").alias("src"), note("target").alias("dst"), F.lit("cites").alias("kind"))
    sources = resolved.where("kind = 'source'").select(note("note"), F.when(F.contains("target", F.lit("#")), ids.node_id("symbol", F.col("target"))).otherwise(ids.node_id("code", F.col("target"))), F.lit("references"))
    patterns = resolved.where("kind = 'pattern'").select(note("note"), ids.node_id("pattern", F.col("target")), F.lit("references"))
    governs = governed.select(note("decision"), ids.node_id("code", F.col("path")), F.lit("governs"))
    supersedes = notes.select("id", F.explode("supersedes").alias("old")).select(note("id"), note("old"), F.lit("supersedes"))
    contains = notes.select("id", F.explode("headings").alias("h")).select(note("id"), ids.heading_id(F.col("id"), F.col("h.text")), F.lit("contains"))
    return cites.union(sources).union(patterns).union(governs).union(supersedes).union(contains)


def graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with hashes; the first node of an id stays, by phase, path and sequence, and each edge once."""
    first = first_wins(nodes, ["id"], ["phase", "path", "seq"]).select("id", "kind", "label", "path")
    first = first.withColumn("hash", typed_hash("node", F.col("id"), F.col("kind"), F.col("label"), F.col("path")))
    once = edges.select("src", "dst", "kind").distinct()
    return first, once.withColumn("hash", typed_hash("edge", F.col("src"), F.col("dst"), F.col("kind")))
