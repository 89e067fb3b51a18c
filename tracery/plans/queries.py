"""Every graph operator bound to the tables; plans/oracle.py has the same rows in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import graph, hashing, hashtree, ordered, policy, recursion, renames, resolve, rules, scopes, sets
from ..sources import notes, snapshots
from . import bind
from .bind import micros, named, table
from .validation import QUERIES as VALIDATION

# Fixed values of the bindings: globs of decisions, import rules, the query of suggestions.
GLOBS = [("d1", "fr/*"), ("d2", "**/2*"), ("d3", "en/[1-3]??"), ("d4", "{de,es}/*5"), ("d5", "zz/*"), ("d6", "825"), ("d7", "en/30?")]
RULES = [("r1", "economy"), ("r2", "small::red"), ("r3", "*/blue/*")]
SCOPES = [("r1", "Brand#1*"), ("r2", "*"), ("r3", "Brand#?")]
ASKED = "25"


def callers(spark: SparkSession, sf: str) -> DataFrame:
    return graph.callers(bind.symbols(spark, sf), bind.calls(spark, sf))


def callees(spark: SparkSession, sf: str) -> DataFrame:
    return graph.callees(bind.calls(spark, sf))


def attack_surface(spark: SparkSession, sf: str) -> DataFrame:
    return graph.attack_surface(bind.symbols(spark, sf), bind.calls(spark, sf), F.col("name").startswith("red "))


def call_resolution(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    asked = table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    asked = asked.select(F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string")).alias("path"), "text").distinct()
    return resolve.calls_to_symbols(asked, bind.symbols(spark, sf)).select("path", "text", "target")


def references(spark: SparkSession, sf: str) -> DataFrame:
    return graph.references(bind.symbols(spark, sf), bind.note_links(spark, sf))


def undocumented(spark: SparkSession, sf: str) -> DataFrame:
    return graph.undocumented(bind.symbols(spark, sf), bind.note_links(spark, sf)).select("id")


def cites(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cites(bind.user_links(spark, sf))


def cited_by(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cited_by(bind.user_links(spark, sf))


def orphans(spark: SparkSession, sf: str) -> DataFrame:
    notes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("note"))
    out = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("note"), F.lit(-1).cast("long").alias("target"))
    into = table(spark, sf, "labels").select(F.lit(-1).cast("long").alias("note"), F.col("doc_id").alias("target"))
    return graph.orphans(notes, out.union(into))


def governs(spark: SparkSession, sf: str) -> DataFrame:
    return graph.governs(bind.governed(spark, sf))


def governing(spark: SparkSession, sf: str) -> DataFrame:
    return graph.governing(bind.governed(spark, sf), bind.symbols(spark, sf).select(F.col("id").alias("path"), F.col("path").alias("file")))


def glob_scope(spark: SparkSession, sf: str) -> DataFrame:
    return policy.governed(policy.with_regex(spark, GLOBS), bind.url_paths(spark, sf).select("path"))


def suffix_resolution(spark: SparkSession, sf: str) -> DataFrame:
    paths = bind.url_paths(spark, sf).select("path").distinct()
    return resolve.partial_paths(paths.select(ids.file_name(F.col("path")).alias("query")).distinct(), paths)


def coverage_total(spark: SparkSession, sf: str) -> DataFrame:
    return graph.coverage_total(bind.symbols(spark, sf).select(F.col("id").alias("path")), bind.governed(spark, sf))


def coverage_by_module(spark: SparkSession, sf: str) -> DataFrame:
    sources = bind.symbols(spark, sf).select(F.col("id").alias("path"), F.col("path").alias("brand"))
    return graph.coverage_by_module(sources, bind.governed(spark, sf), F.col("brand"))


def coverage_by_owner(spark: SparkSession, sf: str) -> DataFrame:
    return graph.coverage_by_owner(table(spark, sf, "supplier").select(named("supplier", "s_suppkey").alias("decision")), bind.governed(spark, sf))


def nodes_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    sources = bind.symbols(spark, sf).select("path").distinct()
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("id"), F.when(F.col("n_regionkey") == 0, "decision").otherwise("doc").alias("kind"))
    out = None
    for kind in (None, "doc", "decision", "code", "economy"):
        rows = graph.nodes(sources, nations, bind.symbols(spark, sf), kind).select(F.lit(kind or "all").alias("asked"), "id")
        out = rows if out is None else out.union(rows)
    return out


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    a, b = bind.shipments(spark, sf, False), bind.shipments(spark, sf, True)
    ends = lambda e: e.select(F.col("src").alias("id")).union(e.select("dst"))
    return sets.snapshot_diff(ends(a), a, ends(b), b, bind.parts(spark, sf, "lineitem"))


def symmetric_difference(spark: SparkSession, sf: str) -> DataFrame:
    return sets.symmetric_difference(bind.shipments(spark, sf, False), bind.shipments(spark, sf, True), ["src", "dst"])


def equal_sets(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"))
    return sets.equal_sets(used, table(spark, sf, "part").select(F.col("p_partkey").alias("key")), ["key"])


def changed_policy_paths(spark: SparkSession, sf: str) -> DataFrame:
    changed = bind.shipments(spark, sf, True).select(F.col("dst").alias("path"))
    return sets.intersection(changed, bind.governed(spark, sf), ["path"])


def retention(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.keep_latest(table(spark, sf, "orders"), F.struct("o_orderdate", "o_orderkey"), 20).select("o_orderkey")


def budget_cut(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return ordered.budget_cut(docs, F.col("doc_id"), [F.col("doc_id")], F.col("n_chars"), 1_000_000).select("doc_id")


def first_wins(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return ordered.first_wins(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return sets.duplicates(docs, "digest").select("doc_id", "copies")


def duplicate_patterns(spark: SparkSession, sf: str) -> DataFrame:
    declared = table(spark, sf, "part").select(F.concat_ws("/", "p_name", "p_type").alias("pattern"), F.col("p_brand").alias("note"), F.col("p_partkey").alias("seq"))
    return sets.duplicate_patterns(declared)


def supersession_effective(spark: SparkSession, sf: str) -> DataFrame:
    return recursion.effective(*bind.supersessions(spark, sf))


def supersession_historical(spark: SparkSession, sf: str) -> DataFrame:
    return recursion.historical(*bind.supersessions(spark, sf))


def rename_chain(spark: SparkSession, sf: str) -> DataFrame:
    _, edges = bind.supersessions(spark, sf)
    return recursion.chain_ends(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("start", F.col("end").alias("last"), "steps")


def asof_alias(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    sites = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    aliases = e.where("event_type = 'signup'").select("event_id", "user_id", "ts", F.col("event_id").alias("alias"))
    return ordered.asof_latest(sites, aliases, "user_id", ["ts", "event_id"], "alias", F.to_date("ts")).select("event_id", "alias")


def scope_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases in the three days after a sign-up of the same user; blocks are hours."""
    e = table(spark, sf, "events").select("event_id", F.lit("").alias("path"), F.col("user_id").cast("string").alias("owner"), "event_type", micros("ts").alias("line"))
    hour = 3_600_000_000
    sites = e.where("event_type = 'purchase'").select("event_id", "path", "owner", "line", F.lit(0).alias("site"))
    signed = e.where("event_type = 'signup'").select("path", "owner", F.col("line").alias("d_line"), F.lit(-1).alias("d_site"), F.col("line").alias("scope_start"), (F.col("line") + 72 * hour).alias("scope_end"), F.col("event_id").alias("directive"))
    return scopes.active(sites, signed, hour).select("event_id", "directive")


def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    """A page's links, its addresses written as links of a note."""
    text_ = F.regexp_replace("html", r'href="([^"\[\]\n]+)"', "\n[[$1]]\n")
    found = notes.notes(table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), text_.alias("text")))
    return found.select(F.col("path").cast("long").alias("page_id"), F.explode("links.link").alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


def link_resolve(spark: SparkSession, sf: str) -> DataFrame:
    paths = bind.url_paths(spark, sf)
    tail = ids.file_name(F.col("path"))
    kind = F.col("page_id") % 4
    link = (
        F.when(kind == 0, F.concat(F.lit("source:"), tail)).when(kind == 1, tail)
        .when(kind == 2, F.concat(F.lit("match:P"), (F.col("page_id") % 7).cast("string")))
        .otherwise(F.concat(F.lit("nation_"), (F.col("page_id") % 30).cast("string"), F.lit(" | other")))
    )
    notes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("seq"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("notes/"), "n_name", F.lit(".md")).alias("path"), F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("headings"))
    patterns = table(spark, sf, "region").select(F.concat(F.lit("P"), F.col("r_regionkey").cast("string")).alias("id"))
    none = spark.createDataFrame([], "path string, selector string")
    raw = paths.select("page_id", link.alias("link"))
    return resolve.links(raw, notes, paths.select("path").distinct(), none, patterns).select("page_id", "kind", "target", "ambiguous")


def slug(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", ids.slug(F.col("url")).alias("slug"))


def safe_path(spark: SparkSession, sf: str) -> DataFrame:
    p, k = bind.url_paths(spark, sf), F.col("page_id") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit("/"), "path")).when(k == 1, F.concat(F.lit("../"), "path")).when(k == 2, F.concat(F.lit("C:"), "path"))
        .when(k == 3, F.concat(F.lit(" ./a\\b//"), "path", F.lit(" "))).when(k == 4, F.lit(" . ")).otherwise(F.col("path"))
    )
    return p.select("page_id", ids.safe_path(raw).alias("safe"))


def id_parse(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "orders").select("o_orderkey", F.concat_ws(":", F.lit("symbol"), "o_orderpriority", "o_orderstatus").alias("id"))
    return x.select("o_orderkey", ids.node_prefix(F.col("id")).alias("prefix"), ids.node_body(F.col("id")).alias("body"))


def decision_ids(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    made = (
        F.when(k % 4 == 0, F.concat(F.lit("ADR-"), k.cast("string")))
        .when(k % 4 == 1, F.concat(F.lit("ADR-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), F.lower("o_orderstatus")))
        .when(k % 4 == 2, F.concat(F.lit("ADR-"), F.date_format("o_orderdate", "yyyyMM"), (k % 90 + 10).cast("string"), F.lit("-x")))
        .otherwise(F.concat(F.lit("adr-"), k.cast("string")))
    )
    return table(spark, sf, "orders").select("o_orderkey", ids.is_decision_id(made).alias("valid"))


def suggest_topk(spark: SparkSession, sf: str) -> DataFrame:
    scored = bind.url_paths(spark, sf).select("path").distinct().select("path", text.source_match_score(F.lit(ASKED), F.col("path")).alias("score"))
    return scored.where("score is not null").orderBy(F.desc("score"), "path").limit(20)


def node_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return bind.symbols(spark, sf).select("id", hashing.typed_hash("node", F.col("id"), F.col("kind"), F.col("name"), F.col("path")).alias("hash"))


def graph_root_hash(spark: SparkSession, sf: str) -> DataFrame:
    nodes = node_hashes(spark, sf).select("hash")
    edges = bind.shipments(spark, sf, True).select(hashing.typed_hash("edge", F.col("src"), F.col("kind"), F.col("dst")).alias("hash"))
    return hashing.root_hash(nodes.union(edges))


def hash_tree_update(spark: SparkSession, sf: str) -> DataFrame:
    """The root after edges came and went, of a stored tree of which only the changed branches are read."""
    early, late = bind.shipments(spark, sf, False), bind.shipments(spark, sf, True)
    both = recursion.kept(sets.compared(early, late, ["src", "kind", "dst"], parts := bind.parts(spark, sf, "lineitem")))
    edge = lambda which: both.where(which).select(hashing.typed_hash("edge", F.col("src"), F.col("kind"), F.col("dst")).alias("hash"))
    folder = f"{recursion.shared_folder(spark)}/tracery-tree-{uuid.uuid4().hex}"
    hashtree.store(hashtree.build(node_hashes(spark, sf).select("hash").union(edge("_a")), parts=parts), folder)
    tree, _ = hashtree.updated(hashtree.load(spark, folder), edge("_b and not _a"), edge("_a and not _b"), parts=parts)
    return tree.root()


def stored_diff(spark: SparkSession, sf: str) -> DataFrame:
    """What changed between two snapshots that are stored in buckets."""
    folder, roots = f"{recursion.shared_folder(spark)}/tracery-snapshots-{uuid.uuid4().hex}", []
    buckets = snapshots.buckets_for(table(spark, sf, "lineitem").count())
    for late in (False, True):
        edges = bind.shipments(spark, sf, late).withColumn("hash", F.sha2(F.concat_ws(" ", "src", "dst"), 256))
        nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("hash", F.sha2("id", 256))
        roots.append(snapshots.publish(spark, folder, {"nodes": nodes, "edges": edges}, buckets=buckets))
    return snapshots.stored_diff(spark, folder, *roots)


def policy_scan(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("pattern"), "text")
    return policy.literal_matches(table(spark, sf, "documents").select("doc_id", "text"), items, "doc_id")


def deny_imports(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("path"), F.concat_ws("::", F.lower("p_type"), F.replace("p_name", F.lit(" "), F.lit("::"))).alias("module")).distinct()
    rules = policy.with_regex(spark, RULES).select(F.col("decision").alias("rule"), F.col("glob").alias("deny"), F.col("regex").alias("deny_regex"))
    scopes = policy.governed(policy.with_regex(spark, SCOPES), parts.select("path")).select(F.col("decision").alias("rule"), "path")
    return policy.denied_imports(parts, rules, scopes)


def debounce_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "ts")
    return ordered.gap_sessions(e, micros("ts"), [F.col("_at"), F.col("event_id")], 250_000).select("event_id", "session")


def state_summary(spark: SparkSession, sf: str) -> DataFrame:
    return graph.summary(nodes=bind.symbols(spark, sf), edges=bind.shipments(spark, sf, True), sources=bind.symbols(spark, sf).select("path").distinct(), patterns=table(spark, sf, "benchmark"))


def failure_categories(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "P", "error").otherwise("warning").alias("severity"), F.lower("o_orderpriority").alias("code"))
    return rules.report(rows, {f"{k}-{name.upper()}": [f"{k}-{name}"] for k, name in enumerate(("urgent", "high", "medium"), 1)})


def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rules.severity_counts(table(spark, sf, "events").select(F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warning").alias("severity")))


def affected_paths(spark: SparkSession, sf: str) -> DataFrame:
    changes = table(spark, sf, "lineitem").select(named("part", "l_partkey").alias("path"), F.when(F.col("l_returnflag") == "R", named("supplier", "l_suppkey")).alias("previous_path"))
    return sets.affected_paths(changes)


def changes(spark: SparkSession, sf: str) -> DataFrame:
    def listing(late: bool) -> DataFrame:
        return bind.shipments(spark, sf, late).groupBy(F.col("dst").alias("path")).agg(F.concat_ws("/", F.min("src"), F.max("src"), F.count("*").cast("string")).alias("hash"))

    return sets.changes_between(listing(False), listing(True))


def changes_similar(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files, moved with a third of their lines lost, with a new first line or with most lines lost, gone, kept or changed."""
    return renames.similar_changes(*bind.edited_documents(spark, sf))


def rename_history(spark: SparkSession, sf: str) -> DataFrame:
    """R3 over time: each order of a customer is a commit that moves the customer's file, or deletes it."""
    return renames.followed(bind.order_history(spark, sf))


def selector_resolution(spark: SparkSession, sf: str) -> DataFrame:
    symbols = bind.symbols(spark, sf).select("id", "path", F.col("name").alias("selector"), F.array("kind").alias("aliases"))
    parts = table(spark, sf, "part")
    here = parts.select(F.col("p_brand").alias("path"), F.concat_ws(" ", "p_name", "p_brand").alias("selector"))
    by_alias = parts.select(F.col("p_brand").alias("path"), F.lower("p_type").alias("selector"))
    anywhere = parts.select(F.lit(None).cast("string").alias("path"), F.concat_ws(" ", "p_name", F.lit("Brand#3")).alias("selector"))
    return resolve.selectors(here.union(by_alias).union(anywhere).distinct(), symbols)


def container_parent(spark: SparkSession, sf: str) -> DataFrame:
    members = table(spark, sf, "lineitem").select(F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string")).alias("path"), F.col("l_partkey")).distinct()
    name = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), name.alias("container"))
    types = table(spark, sf, "part").select(named("part", "p_partkey").alias("id"), F.col("p_brand").alias("path"), name.alias("name"))
    return resolve.containers(members.join(names, "l_partkey").select("path", "container").distinct(), types)


def pattern_resolution(spark: SparkSession, sf: str) -> DataFrame:
    declared = table(spark, sf, "part").select(F.concat_ws("/", "p_name", "p_type").alias("pattern"), F.col("p_partkey").alias("seq"), named("part", "p_partkey").alias("decision"))
    asked = table(spark, sf, "part").select(F.concat_ws("/", "p_name", F.when(F.col("p_size") > 20, F.col("p_type")).otherwise("gone")).alias("pattern")).distinct()
    return resolve.patterns(asked, declared)


def editor_lookup(spark: SparkSession, sf: str) -> DataFrame:
    keys = bind.symbols(spark, sf).select("id", F.col("name").alias("key"), F.col("kind").alias("legacy"))
    asked = keys.select(F.col("key").alias("target")).union(keys.select("legacy")).union(keys.select(F.concat("key", F.lit("?")))).distinct()
    return resolve.candidates(asked, keys).select("target", "state", "total", F.array_join("ids", ",").alias("ids"))


def note_resolution(spark: SparkSession, sf: str) -> DataFrame:
    notes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("seq"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("notes/"), "n_name", F.lit(".md")).alias("path"), F.concat(F.lit("Title "), F.col("n_regionkey").cast("string")).alias("title"))
    k = F.col("c_custkey")
    asked = table(spark, sf, "customer").select("c_custkey", F.when(k % 3 == 0, F.concat(F.lit("n"), (k % 40).cast("string"))).when(k % 3 == 1, F.concat(F.lit("nation_"), (k % 40).cast("string"))).otherwise(F.concat(F.lit("TITLE "), (k % 8).cast("string"))).alias("key"))
    return resolve.notes_by_key(asked, notes).select("c_custkey", "note")


def github_escape(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.github_escaped(F.col("text"), True)).alias("escaped_md5"))


def diagnostic_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = bind.url_paths(spark, sf).select("page_id", ids.file_name(F.col("path")).alias("message"), ids.parent_dir(F.col("path")).alias("code"), F.lit("x").alias("path"))
    return rules.containing(rows, "12").select("page_id")


def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.line_number(F.col("text"), F.char_length("text")).alias("last_line"))


def remote_callables(spark: SparkSession, sf: str) -> DataFrame:
    """(module, name, arity) to the one callable, else none."""
    return scopes.remote_callables(table(spark, sf, "part").select(F.col("p_brand").alias("module"), F.col("p_name").alias("name"), (F.col("p_size") % 3).cast("long").alias("arity"), named("part", "p_partkey").alias("id")))


def clause_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses by module and name; default arguments give several arities; the ranges are merged."""
    c = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("module"), (F.col("l_linenumber") % 3).cast("long").alias("least"), F.col("l_linenumber").cast("long").alias("most"), F.col("l_orderkey").alias("line"))
    return scopes.clause_groups(c, bind.parts(spark, sf, "lineitem"))


def snapshot_order(spark: SparkSession, sf: str) -> DataFrame:
    """Indexed snapshots in their order, then the others by time and hash, the latest last; place from 1."""
    o = table(spark, sf, "region").crossJoin(table(spark, sf, "nation").select("n_nationkey"))  # 125 rows
    o = o.select((F.col("r_regionkey") * 25 + F.col("n_nationkey")).alias("snapshot"), F.when(F.col("r_regionkey") < 3, F.col("n_nationkey") * 5 + F.col("r_regionkey")).alias("place"), (F.col("n_nationkey") % 4).alias("mtime"))
    return ordered.snapshot_order(o, F.col("snapshot") == 7).select("snapshot", "position")


QUERIES = {
    f.__name__: f
    for f in (
        callers, callees, attack_surface, call_resolution, references, undocumented, cites, cited_by, orphans, governs, governing, glob_scope, suffix_resolution,
        coverage_total, coverage_by_module, coverage_by_owner, nodes_by_kind, snapshot_diff, symmetric_difference, equal_sets, changed_policy_paths, retention,
        budget_cut, first_wins, duplicates, duplicate_patterns, supersession_effective, supersession_historical, rename_chain, asof_alias, scope_interval, link_extract,
        link_resolve, slug, safe_path, id_parse, decision_ids, suggest_topk, node_hashes, graph_root_hash, hash_tree_update, stored_diff, policy_scan, deny_imports, debounce_sessions, state_summary,
        failure_categories, severity_counts, affected_paths, changes, changes_similar, rename_history, selector_resolution, container_parent, pattern_resolution, editor_lookup, note_resolution,
        github_escape, diagnostic_filter, line_counts, remote_callables, clause_groups, snapshot_order,
    )
}
QUERIES |= VALIDATION
