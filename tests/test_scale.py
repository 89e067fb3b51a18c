"""What work grows with: rows that are multiplied are not made distinct, small tables are dealt over tasks."""

from collections import Counter
from dataclasses import replace

import pyarrow as pa
import pytest
import yaml
from pyspark.sql import functions as F

from tracery.functions import text
from tracery.operators import checks, graph, hashing, hashtree, policy, recursion, renames, scopes, sets
from tracery.plans import queries, validation
from tracery.sources import elixir, notes, snapshots


def test_callers_by_name_are_not_shuffled_again(spark):
    symbols = spark.createDataFrame([("s1", "f"), ("s2", "f"), ("s2", "g"), ("s3", None), (None, "f"), ("s1", "f")], "id string, name string")
    calls = spark.createDataFrame(
        [("a", None, "f", "call"), ("a", None, "g", "call"), ("a", None, "f", "delegate"), ("a", "s1", "f", "call"), ("b", "s1", "x", "call"), ("b", "s1", "y", "call"), (None, None, "g", "call"), (None, "s2", "g", "call"), ("c", "s3", "z", "call"), ("c", None, None, "call"), ("d", None, "f", "capture"), ("e", "gone", "f", "call")],
        "caller string, target string, text string, kind string",
    )
    found = graph.callers(symbols, calls)
    rows = sorted(map(tuple, found.select("symbol", "caller").collect()), key=str)
    assert rows == sorted([("s1", "a"), ("s2", "a"), (None, "a"), ("s1", "b"), ("s2", None), ("s3", "c")], key=str)
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_references_to_a_path_are_not_shuffled_again(spark):
    symbols = spark.createDataFrame([("s1", "p"), ("s2", "p"), ("s3", None), ("p", "q"), ("s1", "q")], "id string, path string")
    links = spark.createDataFrame([("n", "p"), ("n", "s1"), ("n", "s1"), ("m", "s3"), ("m", "gone"), ("m", "q")], "note string, target string")
    found = graph.references(symbols, links)
    assert sorted(map(tuple, found.select("symbol", "note").collect())) == [("p", "m"), ("p", "n"), ("s1", "m"), ("s1", "n"), ("s2", "n"), ("s3", "m")]
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_callers_by_one_name_are_dealt_over_tasks(spark, monkeypatch):
    """What a name's callers and symbols give was made by one task, as both sides are small."""
    monkeypatch.setattr(graph, "BLOCK", 8)
    monkeypatch.setattr(graph, "MET", 64)
    symbols = spark.range(64).selectExpr("concat('s', id) as id", "'f' as name")
    calls = spark.range(64).selectExpr("concat('c', id) as caller", "cast(null as string) as target", "'f' as text", "'call' as kind")
    found = graph.callers(symbols, calls)
    assert found.distinct().count() == found.count() == 64 * 64
    assert max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) < 1024


def test_small_tables_are_dealt_over_tasks(spark):
    """Parsing takes far longer than reading: one task read a whole table of parts, whatever its rows took."""
    texts = spark.createDataFrame([(str(k), f"---\nid: N{k}\n---\n# T\n") for k in range(40)], "path string, text string").coalesce(1)
    for parsed in (notes.notes(texts), elixir.parsed(texts)):
        assert parsed.rdd.getNumPartitions() > 1
        assert parsed.count() == 40


def test_frontmatter_is_read_by_libyaml_as_before():
    for head in ("id: x\ngoverns: ['a', 7]\n", "a: [1", "a: b: c\n", "- 1\n", "x: 2024-01-01\n", "", "t:\t1\n", "a: |# x\n"):
        try:
            told = yaml.safe_load(head)
        except yaml.YAMLError as e:
            with pytest.raises(yaml.YAMLError) as other:
                notes._loaded(head)
            assert str(other.value) == str(e)
        else:
            assert notes._loaded(head) == told


def test_one_pattern_of_many_policies_is_matched_once(monkeypatch):
    calls = []
    monkeypatch.setattr(policy.code, "matches", lambda t, p, r: calls.append(p) or [(1, "L1", "x", {})])
    monkeypatch.setattr(policy.code, "error", lambda p, r: None)
    asked = [{"id": f"p{k}", "decision": "d", "pattern": "x()", "rule": None} for k in range(5)]
    kind = pa.list_(pa.struct([(c, pa.string()) for c in ("id", "decision", "pattern", "rule")]))
    batch = pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array(["rust"]), pa.array(["x()"]), pa.array([asked], kind)], ["path", "language", "text", "asked"])
    out = list(policy._matches(iter([batch])))
    assert calls == ["x()"] and out[0].column(0).to_pylist() == ["p0", "p1", "p2", "p3", "p4"]


def test_matches_by_glob_equal_those_of_pairs(spark):
    files = spark.createDataFrame([(f"f{k}", "rust" if k % 3 else "go", "a(); b(1);\na()" if k % 2 else "b(2)") for k in range(12)], "path string, language string, text string")
    policies = spark.createDataFrame([(f"p{k}", f"d{k % 4}", "rust", "a()" if k % 2 else "b($X)", None) for k in range(9)], "id string, decision string, language string, pattern string, rule string")
    globs = spark.createDataFrame([("d0", "g0"), ("d0", "g1"), ("d1", "g1"), ("d2", "g1"), ("d3", "none")], "decision string, glob string")
    hits = spark.createDataFrame([(g, f"f{k}") for g, n in (("g0", 8), ("g1", 12)) for k in range(n)], "glob string, path string")
    plain = policy.matches(files, policies, globs.join(hits, "glob"))
    rows = lambda f: sorted(str(r) for r in f.collect())
    assert rows(policy.matches_by_glob(files, policies, globs, hits)) == rows(plain) != []


def test_matches_are_counted_without_a_row_for_each_policy(spark):
    """Each match had a row for each decision that asks for it, only to be counted."""
    files = spark.createDataFrame([(f"f{k % 11}", "rust" if k % 3 else "go", "a(); b(1);\na()" if k % 2 else "b(2)") for k in range(13)], "path string, language string, text string")
    own = [(f"p{k}", f"d{k % 5}", "rust", "a()" if k % 2 else "b($X)", None) for k in range(20)]
    policies = spark.createDataFrame([*own, ("p1", "d1", "rust", "b($X)", None), ("p4", "d4", "rust", "a()", None), (None, "d0", "rust", "a()", None), (None, "d0", "rust", "b($X)", None)], "id string, decision string, language string, pattern string, rule string")
    globs = spark.createDataFrame([("d0", "g0"), ("d0", "g1"), ("d1", "g1"), ("d2", "g1"), ("d3", "none"), ("d4", "g1"), ("d4", "g0"), ("d4", "none")], "decision string, glob string")
    hits = spark.createDataFrame([(g, f"f{k}") for g, n in (("g0", 8), ("g1", 12)) for k in range(n)], "glob string, path string")
    by = policy.scanned_by_glob(files, policies, globs, hits)
    for some in (by, replace(by, owners=by.owners.where("_globs = 1")), replace(by, owners=by.owners.where("_globs > 1")), replace(by, owners=by.owners.where("glob = 'none'"))):
        assert policy.counted_by_glob(some).first()["n"] == policy.told_by_glob(some).count()
    assert policy.counted_by_glob(by).first()["n"] > 0


def test_a_check_is_counted_as_its_rows_are(spark, sf):
    d = checks.derive(*validation._repository(spark, sf))
    plain = checks.check(d, "docs/adr").groupBy("severity", "code").count()
    assert sorted(map(tuple, checks.counts(d, "docs/adr").collect())) == sorted(map(tuple, plain.collect()))


def test_blockers_need_no_symbols_links_or_policies(spark, sf, monkeypatch):
    noted, files_, symbols = validation._repository(spark, sf)
    whole = sorted(map(tuple, checks.blocking(checks.derive(noted, files_, symbols)).collect()))
    monkeypatch.setattr(checks, "symbol_targets", None)
    assert sorted(map(tuple, checks.blockers(noted, files_).collect())) == whole


def test_top_level_parts_by_kind_of_brackets(spark):
    rows = spark.createDataFrame([("a<b, c>, [1, {2}], )x, f(,",), (None,), ("",), ("a,,b\u2003,",)], "x string")
    assert [r.p for r in rows.select(text.split_top_level(F.col("x")).alias("p")).collect()] == [["a<b, c>", "[1, {2}]", ")x", "f(,"], None, [], ["a", "b"]]


def test_files_alike_take_no_round_each(spark, monkeypatch):
    """Of 12 x 12 pairs of one score a round took one."""
    rows = [(f"l{a:02}", f"r{b:02}", 90 if (a + b) % 5 else 95, a == b) for a in range(12) for b in range(12)]
    pairs = spark.createDataFrame(rows, "left string, right string, percent int, equal boolean")
    left = spark.createDataFrame([(f"l{k:02}", k % 3 + 1) for k in range(12)], "file string, n long")
    right = spark.createDataFrame([(f"r{k:02}", k % 2 + 1) for k in range(12)], "file string, n long")
    tables = []
    monkeypatch.setattr(renames, "kept", lambda f, own=renames.kept: tables.append(1) or own(f))
    told = lambda: sorted(map(tuple, renames.one_to_one(pairs, left, right).select("left", "right", "l_from", "r_from", "n", "percent").collect()))
    fast, few = told(), len(tables)
    monkeypatch.setattr(renames, "REST", 0)
    assert told() == fast
    assert few == 2 < len(tables) - few


def test_groups_of_files_alike_take_few_rounds(spark, monkeypatch):
    """Pairs beyond REST took a round for each pair of a group of like files."""
    rows = [(f"l{g}{a:02}", f"r{g}{b:02}", 90 if (a + b) % 7 else 95, a == b) for g in range(3) for a in range(20) for b in range(15 + g)]
    rows += [("l120", "r000", 60, False), ("x", "l000", 70, False), ("l000", "r-", 99, True)]
    pairs = spark.createDataFrame(rows, "left string, right string, percent int, equal boolean")
    side = lambda k, m: spark.createDataFrame([(f, i % m + 1) for i, f in enumerate(sorted({r[k] for r in rows}))], "file string, n long")
    left, right = side(0, 3), side(1, 2)
    told = lambda: sorted(map(tuple, renames.one_to_one(pairs, left, right).select("left", "right", "l_from", "r_from", "n", "percent").collect()))
    fast, tables = told(), []
    monkeypatch.setattr(renames, "REST", 0)
    monkeypatch.setattr(renames, "kept", lambda f, own=renames.kept: tables.append(1) or own(f))
    assert told() == fast
    assert len(tables) <= 8


def test_components_of_edges(spark):
    edges = [(1, 2), (2, 1), (3, 2), (9, 9), *[(k, k + 1) for k in range(20, 60)], *[(100, k) for k in range(101, 120)], (150, 119)]
    found = recursion.components(spark.createDataFrame(edges, "src long, dst long"))
    want = [(k, 1) for k in (1, 2, 3)] + [(k, 20) for k in range(20, 61)] + [(k, 100) for k in (*range(100, 120), 150)]
    assert sorted(map(tuple, found.collect())) == want
    assert recursion.components(spark.createDataFrame([(9, 9)], "src long, dst long")).count() == 0


def test_pieces_of_one_side_are_only_counted(spark):
    """A file with half of its bytes in pieces that the other side lacks is like none of it; such pieces were looked up and ranked."""
    left = spark.createDataFrame([("a", "x\ny\nz\n"), ("b", "x\nx\nq1\n"), ("c", "only here\n"), ("d", "x\n" + "gone " * 9)], "file string, text string")
    right = spark.createDataFrame([("A", "x\ny\nw\n"), ("B", "x\nx\nx\n"), ("C", "z\n"), ("D", "x\n")], "file string, text string")
    pieces = lambda t: [p + "\n" for p in t.split("\n")[:-1]] + [x for x in [t.split("\n")[-1]] if x]
    want = []
    for f, t in map(tuple, left.collect()):
        for g, u in map(tuple, right.collect()):
            n = sum((Counter(pieces(t)) & Counter(pieces(u)))[p] * len(p) for p in set(pieces(t)))
            if n * 2 >= max(len(t), len(u)):
                want.append((f, g, n * 100 // max(len(t), len(u))))
    assert sorted(map(tuple, renames.shared_bytes(left, right).collect())) == sorted(want) != []


def _counted(spark, df, column):
    """(df, accumulator): how many of its rows were evaluated."""
    told = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def same(x):
        told.add(1)
        return x

    return df.withColumn(column, same(F.col(column))), told


def test_a_stored_tree_evaluates_its_hashes_once(spark, tmp_path):
    """The levels were made of the hashes first and the leaves were shuffled again for their folders."""
    hashes = spark.range(40).select(F.sha2((F.col("id") % 30).cast("string"), 256).alias("hash"))
    counted, told = _counted(spark, hashes, "hash")
    folder = f"file://{tmp_path}/tree"
    hashtree.store(hashtree.build(counted), folder)
    assert told.value == 40
    tree = hashtree.load(spark, folder)
    assert tree.root().first() == hashing.root_hash(hashes).first() and hashtree.same_root(tree)
    one = lambda *ids: spark.createDataFrame([(k,) for k in ids], "k string").select(F.sha2("k", 256).alias("hash"))
    after, read = hashtree.updated(tree, one("3", "3", "new", "new", "gone"), one("3", "4", "4", "4", "29", "gone", "other"))
    want = hashes.exceptAll(one("3", "4", "4", "29")).union(one("3", "3", "new", "new"))
    assert after.root().first() == hashing.root_hash(want).first()
    assert sorted(r.h for r in after.leaves.collect()) == sorted(r.hash for r in want.collect()) and read.count() == 5


def test_buckets_grow_with_the_rows(spark, sf, monkeypatch):
    """One of eight tasks sorted an eighth of a snapshot, however large."""
    told = []
    monkeypatch.setattr(snapshots, "TASK_ROWS", 500)
    monkeypatch.setattr(snapshots, "publish", lambda *a, buckets=None, **k: told.append(buckets) or "r")
    monkeypatch.setattr(snapshots, "stored_diff", lambda *a: None)
    queries.QUERIES["stored_diff"](spark, sf)  # 6,000 rows
    assert told == [16, 16] and snapshots.buckets_for(0) == snapshots.buckets_for(4000) == 8


def test_aliases_are_looked_up_without_blocks(spark, monkeypatch):
    """Each scope was put under all blocks of lines that make it up, though the last directive before a site mostly holds."""
    rows = [("f", None, k, 0, k, k + 50, f"A{k % 2}", f"A{(k + 1) % 2}.x") for k in (10, 21, 32, 300)]
    directives = spark.createDataFrame(rows, "path string, owner string, d_line long, d_site long, scope_start long, scope_end long, alias string, target string")
    sites = spark.createDataFrame([(k, "f", None, k, 0, "A0.f") for k in (5, 10, 11, 40, 90, 310)], "id long, path string, owner string, line long, site long, module string")

    def none(*a):
        raise AssertionError("blocks")

    monkeypatch.setattr(scopes, "placed", none)
    assert sorted(map(tuple, scopes.expand_aliases(sites, directives).collect())) == [(5, "A0.f"), (10, "A0.f"), (11, "A1.x.f"), (40, "A1.x.x.x.f"), (90, "A0.f"), (310, "A1.x.f")]


def test_clauses_are_dealt_before_arities_multiply_them(spark):
    rows = [(k % 5, k % 3, k % 4, k) for k in range(60)]
    clauses = spark.createDataFrame(rows, "module long, least long, most long, line long")
    want = {}
    for module, least, most, line in rows:
        for arity in range(least, most + 1):
            want.setdefault((module, arity), []).append(line)
    found = scopes.clause_groups(clauses, parts=7)
    assert sorted(map(tuple, found.collect())) == sorted((*k, len(v), min(v), max(v)) for k, v in want.items())
    assert found.rdd.getNumPartitions() == 7


def test_snapshots_are_compared_by_one_grouping(spark):
    """Four differences joined and sorted both sides twice."""
    nodes = lambda *ids: spark.createDataFrame([(k,) for k in ids], "id string")
    edges = lambda *ends: spark.createDataFrame([(a, "k", b) for a, b in ends], "src string, kind string, dst string")
    found = sets.snapshot_diff(nodes("a", "b", "b", None), edges("ab", "ab", "bc"), nodes("b", "c", "c", None), edges("ab", "cd", "cd"), 3)
    assert sorted(map(tuple, found.collect())) == [("edge_added", "c:k:d"), ("edge_removed", "b:k:c"), ("node_added", "c"), ("node_removed", "a")]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_history_is_evaluated_once(spark):
    """Each lookup evaluated it again."""
    rows = [(1, "added", "a", None), (2, "renamed", "b", "a"), (3, "renamed", "c", "b"), (4, "deleted", "c", None)]
    history, told = _counted(spark, spark.createDataFrame(rows, "commit long, status string, path string, previous_path string"), "path")
    assert [tuple(r) for r in renames.followed(history).collect()] == [("a", 1, "c", 4, 2)]
    assert told.value == 4
