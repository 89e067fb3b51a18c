from pyspark.sql import functions as F

from tracery.operators import graph, hashing, ordered, policy, projection, recursion, resolve, rules, scopes, sets


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


def test_cycles_and_closure(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")], "src string, dst string")
    assert rows(recursion.cycles(edges)) == [("a", ["a", "b", "c"]), ("b", ["b", "c", "a"]), ("c", ["c", "a", "b"]), ("e", ["e"])]
    decisions = spark.createDataFrame([("a", "accepted"), ("b", "accepted"), ("c", "draft"), ("d", "accepted"), ("x", "accepted")], "id string, status string")
    assert rows(recursion.effective(decisions, edges)) == [("x",)]
    assert rows(recursion.historical(decisions, edges)) == [("a",), ("b",), ("d",)]


def test_chains_end_or_circle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "x")], "src string, dst string")
    assert rows(recursion.chain_ends(edges)) == [("a", "d", 3), ("b", "d", 2), ("c", "d", 1)]


def test_braces(spark):
    m = spark.createDataFrame([("a::{b, c::{d, self}}",), ("x",), ("std::{io::{Read,Write}, fmt}",)], "module string")
    assert rows(recursion.expand_braces(m, "module")) == [("a::b",), ("a::c",), ("a::c::d",), ("std::fmt",), ("std::io::Read",), ("std::io::Write",), ("x",)]


def test_self_citation_counts_as_outgoing_only(spark):
    links = spark.createDataFrame([("a", "a"), ("b", "c")], "note string, target string")
    notes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "note string")
    assert rows(graph.orphans(notes, links)) == [("d",)]
    assert rows(graph.cited_by(links)) == [("c", "b")]


def test_unresolved_calls_count_by_name(spark):
    symbols = spark.createDataFrame([("1", "p", "run", "fn", True, True)], "id string, path string, name string, kind string, exported boolean, top_level boolean")
    calls = spark.createDataFrame([("x", "1", "run", "call"), ("y", None, "run", "call"), ("z", "1", "run", "capture")], "caller string, target string, text string, kind string")
    assert rows(graph.callers(symbols, calls)) == [("1", "x"), ("1", "y")]


def test_link_cascade(spark):
    notes = spark.createDataFrame([(0, "N1", "docs/guide.md", "The Guide", ["Intro", "How To"]), (1, "src", "docs/other.md", None, [])], "seq long, id string, path string, title string, headings array<string>")
    paths = spark.createDataFrame([("src/a.rs",), ("lib/a.rs",), ("src/b.rs",)], "path string")
    symbols = spark.createDataFrame([("src/b.rs", "fn:run")], "path string, selector string")
    patterns = spark.createDataFrame([("ADR-0001/p",)], "id string")
    raw = spark.createDataFrame([(x,) for x in ["guide", "THE GUIDE#how-to", "guide#nope", "source:a.rs", "b.rs#fn:run", "b.rs#fn:gone", "b.rs#L3", "match:ADR-0001/p", "match:x", "gone|alias"]], "link string")
    got = {r.link: (r.kind, r.target, r.ambiguous) for r in resolve.links(raw, notes, paths, symbols, patterns).collect()}
    assert got == {
        "guide": ("note", "N1", False), "THE GUIDE#how-to": ("note", "N1", False), "guide#nope": ("broken", None, False), "source:a.rs": ("source", "lib/a.rs", True),
        "b.rs#fn:run": ("source", "src/b.rs#fn:run", False), "b.rs#fn:gone": ("broken", None, False), "b.rs#L3": ("source", "src/b.rs", False),
        "match:ADR-0001/p": ("pattern", "ADR-0001/p", False), "match:x": ("broken", None, False), "gone|alias": ("broken", None, False),
    }


def test_aliases_of_aliases(spark):
    d = "path string, owner string, d_line long, d_site long, scope_start long, scope_end long, alias string, target string"
    directives = spark.createDataFrame([("f", "M", 1, 1, 1, 99, "A", "X.Y"), ("f", "M", 3, 1, 1, 99, "B", "A.Z"), ("f", "M", 5, 1, 5, 6, "B", "Q")], d)
    sites = spark.createDataFrame([(1, "f", "M", 4, 1, "B.w"), (2, "f", "M", 6, 1, "B"), (3, "f", "M", 9, 1, "B"), (4, "f", "M", 2, 1, "B")], "id long, path string, owner string, line long, site long, module string")
    assert rows(scopes.expand_aliases(sites, directives)) == [(1, "X.Y.Z.w"), (2, "Q"), (3, "X.Y.Z"), (4, "B")]


def test_visible_imports(spark):
    i = "path string, owner string, d_line long, d_site long, scope_start long, scope_end long, module string, only_kind string, only array<string>, except array<string>"
    imports = spark.createDataFrame([("f", None, 1, 1, 1, 99, "A", None, ["go/1"], None), ("f", None, 2, 1, 1, 99, "B", None, None, ["go/1"])], i)
    callables = spark.createDataFrame([("A.go", "A", "function", "go", 1), ("B.go", "B", "function", "go", 1), ("A.no", "A", "function", "no", 0), ("B.no", "B", "function", "no", 0)], "id string, module string, kind string, name string, arity long")
    sites = spark.createDataFrame([(1, "f", None, 5, 1, "go", 1), (2, "f", None, 5, 2, "no", 0), (3, "f", None, 5, 3, "zz", 0)], "id long, path string, owner string, line long, site long, name string, arity long")

    got = dict(rows(scopes.visible_imports(sites, imports, callables)))
    assert got == {1: "A.go", 2: "B.no", 3: None}


def test_ordered_scans_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 7)
    df = spark.range(100).select("id", (F.col("id") % 5).alias("n"))
    got = {r.id: r.s for r in ordered.running_sum(df, F.col("id"), [F.col("id")], F.col("n"), "s").collect()}
    total = 0
    for i in range(100):
        total += i % 5
        assert got[i] == total
    at = spark.createDataFrame([(i, t) for i, t in enumerate([0, 1, 2, 50, 51, 200, 201, 202, 203, 400])], "id long, t long")
    assert [s for _, s in rows(ordered.gap_sessions(at, F.col("t"), [F.col("_at"), F.col("id")], 10).select("id", "session"))] == [1, 1, 1, 2, 2, 3, 3, 3, 3, 4]


def test_asof_over_spans(spark):
    sites = spark.createDataFrame([(1, 5), (1, 25), (2, 5), (1, 100)], "k long, t long")
    directives = spark.createDataFrame([(1, 3, "a"), (1, 24, "b"), (2, 6, "c")], "k long, t long, v string")
    assert rows(ordered.asof_latest(sites, directives, "k", ["t"], "v", F.floor(F.col("t") / 10))) == [(1, 5, "a"), (1, 25, "b"), (1, 100, "b"), (2, 5, None)]


def test_changes_proofs_and_reconciliation(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, hash string")
    after = spark.createDataFrame([("a", "1"), ("b", "9"), ("e", "3"), ("f", "1"), ("g", "7")], "path string, hash string")
    changes = sets.changes_between(before, after)
    assert sorted((r.status, r.path, r.previous_path or "") for r in changes.collect()) == [("added", "g", ""), ("copied", "f", "a"), ("deleted", "d", ""), ("modified", "b", ""), ("renamed", "e", "c")]
    values = spark.createDataFrame([("c",), ("d",), ("a",), ("zz",)], "value string")
    assert rows(sets.reconciled(values, changes), "value", "outcome") == [("a", "copied"), ("c", "renamed"), ("d", "deleted"), ("zz", "unresolved")]
    receipt = spark.createDataFrame([("a", "1", "2"), ("b", "1", "1")], "path string, before string, after string")
    staged = spark.createDataFrame([("a", "1", "3"), ("c", "1", "1")], "path string, before string, after string")
    assert rows(sets.proof(receipt, staged)) == [("a", "other contents"), ("b", "not staged"), ("c", "not in the receipt")]
    twice = spark.createDataFrame([("renamed", "x", "a"), ("renamed", "y", "a"), ("copied", "z", "b")], "status string, path string, previous_path string")
    assert rows(sets.rename_conflicts(twice)) == [("a", "left twice")]


def test_root_hash_ignores_order(spark):
    a = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    assert hashing.root_hash(a).first() == hashing.root_hash(a.repartition(7).orderBy(F.rand())).first()
    assert hashing.root_hash(a).first() != hashing.root_hash(a.where("hash > '1'")).first()
    x = spark.range(1).select(hashing.typed_hash("d", F.lit(None), F.lit("")).alias("a"), hashing.typed_hash("d", F.lit(""), F.lit(None)).alias("b")).first()
    assert x.a != x.b


def test_declared_policies(spark):
    p = spark.createDataFrame([("a", 1, "rust", "x", None), ("", 2, "rust", "x", None), ("b", 3, None, None, None), ("c", 4, None, "x", None), ("d", 5, "go", None, None), ("e", 6, "go", "x", "y"), ("f", 7, "go", " ", None)], "id string, line long, language string, pattern string, rule string")
    assert rows(policy.declaration_errors(p), "id", "code") == [
        ("", "missing-policy-pattern-id"), ("b", "missing-policy-pattern-definition"), ("c", "missing-policy-pattern-language"), ("d", "missing-policy-pattern-body"),
        ("e", "ambiguous-policy-pattern-body"), ("f", "empty-policy-pattern"),
    ]


def test_note_rules(spark):
    schema = "path string, id string, kind string, title string, status string, headings array<struct<level:int,text:string,line:long>>, frontmatter_error string, historical boolean"
    good = [(1, "Use Spark", 1), (2, "Context", 2), (2, "Decision", 3), (2, "Consequences", 4)]
    notes = spark.createDataFrame([
        ("docs/adr/0001-use-spark.md", "ADR-0001", "decision", "Use Spark", "accepted", good, None, False),
        ("docs/adr/0002-x.md", "ADR-0002", "decision", "Use Spark", "accepted", good[:3], None, False),
        ("docs/adr/0003-x.md", "ADR-0003", "decision", "Use Spark", "accepted", good[:1], None, True),
        ("docs/a.md", None, "doc", None, None, [], None, False), ("docs/b.md", "b", "what", None, None, [], None, False),
        ("docs/c.md", "b", "doc", None, None, [], None, False), ("docs/d.md", None, None, None, None, [], "bad yaml", False), ("docs/adr/e.md", "e", "doc", None, None, [], None, False),
        ("docs/f.md", "ADR-9", "decision", "T", "draft", good, None, False),
    ], schema)
    assert rows(rules.note_rules(notes, "docs/adr"), "path", "code") == [
        ("docs/a.md", "missing-id"), ("docs/adr/0002-x.md", "document-format"), ("docs/adr/e.md", "adr-dir-non-decision"), ("docs/b.md", "duplicate-id"), ("docs/b.md", "invalid-kind"),
        ("docs/c.md", "duplicate-id"), ("docs/d.md", "invalid-frontmatter"), ("docs/f.md", "decision-location"), ("docs/f.md", "document-format"), ("docs/f.md", "invalid-adr-id"),
    ]


def test_supersession_rules(spark):
    d = spark.createDataFrame([("A", "a.md", ["B", "X"], []), ("B", "b.md", [], ["A"]), ("C", "c.md", ["D"], ["D"]), ("D", "d.md", ["C"], ["C"]), ("E", "e.md", ["A"], [])], "id string, path string, supersedes array<string>, superseded_by array<string>")
    assert rows(rules.supersession_rules(d), "path", "code") == [("a.md", "unknown-supersedes"), ("c.md", "supersession-cycle"), ("d.md", "supersession-cycle"), ("e.md", "inconsistent-supersession")]


def test_report_and_scope(spark):
    d = spark.createDataFrame([("error", "broken-link", "a", None, "m"), ("error", "duplicate-id", "b", 2, "m"), ("warning", "x", "c", 1, "m")], "severity string, code string, path string, line long, message string")
    assert rows(rules.report(d, {"ids": ["duplicate-id"], "links": ["broken-link"]})) == [("ids", 1, True), ("links", 1, False)]
    assert rules.github_lines(d).collect()[1].value == "::error file=b,line=2,title=duplicate-id::m"
    change = lambda status, path: spark.createDataFrame([(status, path)], "status string, path string")
    assert not rules.needs_full_scan(change("modified", "src/a"), "c.toml", "docs/adr")
    assert rules.needs_full_scan(change("deleted", "src/a"), "c.toml", "docs/adr") and rules.needs_full_scan(change("modified", "docs/adr/1.md"), "c.toml", "docs/adr")


def test_projection_keeps_the_first_node(spark):
    notes = spark.createDataFrame([("g", "doc", "Guide", "g.md", ["ADR-9"], [(2, "How To", 3)])], "id string, kind string, title string, path string, supersedes array<string>, headings array<struct<level:int,text:string,line:long>>")
    resolved = spark.createDataFrame([("g", "source", "a.py#fn:f"), ("g", "note", "h")], "note string, kind string, target string")
    governed = spark.createDataFrame([("g", "a.py")], "decision string, path string")
    nodes = projection.note_nodes(notes).union(projection.note_nodes(notes.withColumn("title", F.lit("Later")).withColumn("path", F.lit("z.md"))))
    n, e = projection.graph(nodes, projection.note_edges(notes, resolved, governed))
    assert rows(n, "id", "label", "path") == [("note:g", "Guide", "g.md"), ("note:g#how-to", "How To", "g.md#L3:H2")]
    assert rows(e, "src", "kind", "dst") == [("note:g", "cites", "note:h"), ("note:g", "contains", "note:g#how-to"), ("note:g", "governs", "code:a.py"), ("note:g", "references", "symbol:a.py#fn:f"), ("note:g", "supersedes", "note:ADR-9")]


def test_braces_of_any_number_and_depth(spark):
    from tracery.operators import recursion

    deep = "::{".join(f"m{k}" for k in range(40)) + "}" * 39
    wide = "a::{" + ", ".join(f"b{k}::{{c, self}}" for k in range(40)) + "}"
    frame = spark.createDataFrame([(1, deep), (2, wide), (3, "x::y"), (4, None), (5, "a::{b, c::{}}")], "id int, module string")
    got = sorted(tuple(r) for r in recursion.expand_braces(frame, "module").collect())
    want = [(1, "::".join(f"m{k}" for k in range(40))), *[(2, f"a::b{k}{end}") for k in range(40) for end in ("::c", "")], (3, "x::y"), (5, "a::b")]
    assert got == sorted(want)


def test_a_long_cycle(spark):
    from tracery.operators import recursion

    edges = spark.createDataFrame([(k, (k + 1) % 66) for k in range(66)], "src int, dst int").coalesce(1)
    got = recursion.cycles(edges).collect()
    assert sorted(r.start for r in got) == list(range(66)) and all(len(r.path) == 66 and r.path[0] == r.start for r in got)


def test_scopes_by_blocks_of_lines(spark):
    import random

    rng = random.Random(3)
    span = lambda: sorted((rng.randrange(1, 400), rng.randrange(1, 400)))
    sites = [(i, rng.choice("fg"), rng.choice(["M", None, ""]), rng.randrange(1, 400), rng.randrange(3), f"{rng.choice('ABC')}.x") for i in range(300)]
    directives = [(rng.choice("fg"), rng.choice(["M", None, ""]), rng.randrange(1, 400), rng.randrange(3), *span(), rng.choice("ABC"), f"T{i}") for i in range(300)]
    s = spark.createDataFrame(sites, "id long, path string, owner string, line long, site long, module string")
    d = spark.createDataFrame(directives, "path string, owner string, d_line long, d_site long, scope_start long, scope_end long, alias string, target string")
    want = sorted((a[0], x[7]) for a in sites for x in directives if a[1:3] == x[:2] and x[2:4] < a[3:5] and x[4] <= a[3] <= x[5])
    for unit in (1, 50):
        assert rows(scopes.active(s, d, unit), "id", "target") == want
    none = spark.createDataFrame([], d.schema)
    assert rows(scopes.active(s, none), "id") == [] and rows(scopes.expand_aliases(s, none)) == sorted((a[0], a[5]) for a in sites)

    def written(path, owner, line, site, module, depth=16):
        own = [x for x in directives if (path, owner) == x[:2] and x[2:4] < (line, site) and x[4] <= line <= x[5] and x[6] == module.split(".")[0]]
        if not own or not depth:
            return module
        last = max(own, key=lambda x: x[2:4])
        return written(path, owner, last[2], last[3], last[7] + module[len(last[6]) :], depth - 1)

    unique = {x[:4] + x[6:7]: x for x in directives}
    directives[:] = unique.values()
    d = spark.createDataFrame(directives, d.schema)
    assert rows(scopes.expand_aliases(s, d)) == sorted((a[0], written(*a[1:])) for a in sites)


def test_a_large_file_meets_only_what_is_active(spark):
    """Of 100,000 sites and as many directives of one file only pairs that hold are joined."""
    n = 100_000
    one = spark.range(n).select(F.lit("f").alias("path"), F.lit("M").alias("owner"), (F.col("id") * 3).alias("at"))
    sites = one.select("path", "owner", (F.col("at") + 1).alias("line"), F.lit(0).alias("site"), F.col("at").alias("id"))
    directives = one.select("path", "owner", F.col("at").alias("d_line"), F.lit(0).alias("d_site"), F.col("at").alias("scope_start"), (F.col("at") + 4).alias("scope_end"))
    assert scopes.active(sites, directives).count() == 2 * n - 1


def test_components_cycles_and_closure_of_any_graph(spark):
    import random

    rng = random.Random(1)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(38)]
    edges += [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(200, 201), (201, 202), (202, 200), (202, 5)] + [(300 + i, 301 + i) for i in range(9)]
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reached(a):
        seen, todo = set(), list(after.get(a, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        return seen

    reach = {x: reached(x) for e in edges for x in e}
    want = {x: min(y for y in reach if y in reach[x] and x in reach[y]) for x in reach if x in reach[x]}
    frame = spark.createDataFrame(edges, "src long, dst long")
    assert dict(rows(recursion.strong_components(frame))) == want
    found = recursion.cycles(frame).collect()
    assert sorted(r.start for r in found) == sorted(want)
    for r in found:
        assert r.path[0] == r.start and len(set(r.path)) == len(r.path) and set(zip(r.path, r.path[1:] + r.path[:1], strict=True)) <= set(edges)
    starts = spark.createDataFrame([(0,), (100,), (303,), (999,)], "id long")
    assert [i for (i,) in rows(recursion.reachable(starts, frame))] == sorted(reach.get(0, set()) | reach[100] | reach[303])
    empty = frame.limit(0)
    assert rows(recursion.cycles(empty)) == [] and rows(recursion.reachable(starts, empty)) == []


def test_globs_by_their_literal_characters(spark):
    import random
    import re

    from tracery.functions.text import glob_regex

    rng = random.Random(2)
    names = ["name", "na", "main", "x", "lib.rs", "a.b", "ünï", "tests", "z[1]", ""]
    paths = sorted({"/".join(rng.choice(names) + rng.choice(["", "1", ".rs"]) for _ in range(rng.randrange(1, 5))) for _ in range(400)} - {""})
    globs = ["**/name*.rs", "*.rs", "**", "*", "?", "**/x", "x/**", "**/tests/**", "*/na?/*", "{main,name}/*", "**/{a.b,x}*", "[mn]a*", "**/z\\[1\\]*", "*a*", "**/nothing*", "na**me", "?/**/?", "**/*", "src/**", "lib.rs", "*ï*", "*/*/*/*", "{x", "[!m]*"]
    made = policy.with_regex(spark, [(f"d{i % 20}", g) for i, g in enumerate(globs)])
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    want = set()
    for i, g in enumerate(globs):
        try:
            hits = {p for p in paths if re.search(glob_regex(g), p)}
        except ValueError:
            hits = set()
        if not hits:  # a tail of a path
            tails = [p for p in paths if p == g or p.endswith(f"/{g}")]
            hits = {g} if g in tails else set(tails[:1])
        want |= {(f"d{i % 20}", p) for p in hits}
    assert set(rows(policy.governed(made, frame))) == want


def test_many_globs_meet_few_paths(spark):
    """A thousand globs over 20,000 paths: what meets is what matches, not their product."""
    paths = spark.range(20_000).select(F.concat(F.lit("src/mod"), (F.col("id") % 40).cast("string"), F.lit("/name"), F.col("id").cast("string"), F.lit("_x.rs")).alias("path"))
    made = policy.with_regex(spark, [(f"d{i}", f"**/name{i}_*.rs") for i in range(0, 20_000, 20)])
    assert policy.governed(made, paths).count() == 1000


def test_what_allows_a_change_of_a_decision(spark):
    from tracery.operators import gate

    old = "---\nstatus: accepted\ngoverns:\n  - src/a.rs\n  - 'src/x.rs'\n---\nsee [[ADR-0001]]\n"
    schema = "status string, path string, previous_path string, old_text string, new_text string"
    files = [("renamed", "src/b.rs", "src/a.rs", None, None), ("renamed", "src/c.rs", "src/b.rs", None, None), ("copied", "src/y.rs", "src/x.rs", None, None)]

    def allowed(new, before=old, files=files, **more):
        changes = spark.createDataFrame([("modified", "docs/adr/1.md", None, before, new), *files], schema)
        return {r.why for r in gate.allowed_changes(changes, **more).collect() if r.path == "docs/adr/1.md"}

    moved = old.replace("src/a.rs", "src/c.rs")
    assert allowed(moved) == {"source rename"}
    assert allowed(moved + "more\n") == allowed(old.replace("src/a.rs", "src/b.rs")) == allowed(old.replace("src/x.rs", "src/y.rs")) == allowed(old) == set()
    assert allowed(moved, files=[*files, ("renamed", "src/d.rs", "src/a.rs", None, None)]) == set()  # no one answer
    assert allowed(moved.replace("accepted", "draft"), old.replace("accepted", "draft")) == set()
    assert allowed(old.replace("[[ADR-0001]]", "[[docs/adr/0001-x.md|ADR-0001]]")) == {"portable links"}
    receipt = spark.createDataFrame([("docs/adr/1.md", "h1", "h2")], "path string, before string, after string")
    assert allowed("x", receipt=receipt, staged=receipt) == {"receipt"}
    assert allowed("x", receipt=receipt, staged=receipt.union(spark.createDataFrame([("y", "h", "h")], receipt.schema))) == set()
    assert allowed("x", base=spark.createDataFrame([("docs/adr/2.md",)], "path string")) == {"branch"}
    assert allowed("x", base=spark.createDataFrame([("docs/adr/1.md",)], "path string")) == set()
    ring = spark.createDataFrame([("renamed", "b", "a"), ("renamed", "a", "b"), ("renamed", "a", "c"), ("renamed", "z", "y")], "status string, path string, previous_path string")
    assert rows(gate.cyclic_renames(ring)) == [("a",), ("b",), ("c",)]
    swap = spark.createDataFrame([(1, "renamed", "b", "a"), (1, "renamed", "a", "b"), (2, "renamed", "c", "a"), (3, "added", "a", None), (4, "deleted", "c", None)], "commit long, status string, path string, previous_path string")
    from tracery.operators import renames

    assert {tuple(r) for r in renames.followed(swap).collect()} == {("a", None, "b", None, 1), ("a", 3, "a", None, 0), ("b", None, "c", 4, 2)}
    twice = spark.createDataFrame([(1, "renamed", "b", "a"), (1, "renamed", "c", "a"), (2, "renamed", "d", "b")], swap.schema)
    assert rows(renames.ambiguous(twice)) == [(1, "a", "left twice")]


def test_a_long_history_of_renames(spark):
    """10,000 commits that pass one file on, in a few rounds."""
    from tracery.operators import renames

    history = spark.range(1, 10_001).select(F.col("id").alias("commit"), F.lit("renamed").alias("status"), F.concat(F.lit("f"), (F.col("id") % 7).cast("string")).alias("path"), F.concat(F.lit("f"), ((F.col("id") - 1) % 7).cast("string")).alias("previous_path"))
    assert rows(renames.followed(history)) == [("f0", None, "f4", None, 10_000)]


def test_renames_of_edited_files(spark):
    from tracery.operators import renames

    lines = [f"line {i} of this file\n" for i in range(100)]
    text = lambda a, b, own="": "".join(lines[a:b]) + "}\n" * 40 + own
    files = lambda rows: spark.createDataFrame([(p, str(hash(t)), t) for p, t in rows], "path string, hash string, text string")
    before = [("old/a", text(0, 50)), ("old/b", text(50, 100)), ("old/gone", "nothing like it\n" * 5), ("same", "x\n"), ("old/e", ""), ("old/e2", ""), *((f"old/copy{i}", "copy of one text\n" * 9) for i in range(5))]
    after = [("new/a", text(0, 40)), ("new/b", text(60, 100, "more\n")), ("new/fresh", "all is new here\n" * 7), ("same", "x\n"), ("new/e", ""), *((f"new/copy{i}", "copy of one text\n" * 9) for i in range(3)), ("new/like", "copy of one text\n" * 8)]
    got = {r.path: (r.status, r.previous_path, r.percent) for r in renames.similar_changes(files(before), files(after)).collect()}
    moved = {p: x for p, x in got.items() if x[0] == "renamed"}
    assert moved == {"new/a": ("renamed", "old/a", 81), "new/b": ("renamed", "old/b", 81), "new/copy0": ("renamed", "old/copy0", 100), "new/copy1": ("renamed", "old/copy1", 100), "new/copy2": ("renamed", "old/copy2", 100), "new/like": ("renamed", "old/copy3", 88)}
    assert {p for p, x in got.items() if x[0] == "added"} == {"new/fresh", "new/e"} and {p for p, x in got.items() if x[0] == "deleted"} == {"old/gone", "old/e", "old/e2", "old/copy4"}
    assert rows(renames.similar_changes(files(before).limit(0), files(after).limit(0))) == []


def test_suggestions_of_many_queries(spark):
    """Equal to scoring every pair, and few pairs are scored where matches are plenty."""
    import random

    from tracery.functions.text import suggestion_score
    from tracery.operators import suggest

    rng = random.Random(5)
    parts = ["src", "lib", "main", "graph", "Node", "état", "x", "test_a", "b2"]
    targets = sorted({"/".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) + rng.choice(["", ".rs", ".py"]) for _ in range(400)})
    asked = ["src", "NODE", " lib/x ", "gph", "e", "zzz", "main.rs", "état", "srb", "", "tst", "lib/x.rs", "q", "mn", None, "src"]
    t, q = spark.createDataFrame([(x,) for x in [*targets, *targets[:9], None]], "target string"), spark.createDataFrame([(x,) for x in asked], "query string")
    pairs = q.where("query is not null and trim(query) <> ''").distinct().crossJoin(t.where("target is not null").distinct())
    want = {}
    for r in pairs.select("query", "target", suggestion_score(F.lower(F.trim("query")), F.col("target")).alias("score")).where("score is not null").collect():
        want.setdefault(r["query"], []).append((-r.score, r.target))
    want = sorted((a, n + 1, x, -s) for a, found in want.items() for n, (s, x) in enumerate(sorted(found)[:5]))
    got = suggest.top(q, t, 5).collect()
    assert sorted(tuple(r) for r in got if r.query.strip()) == want
    assert [(r["rank"], r.target) for r in sorted((r for r in got if not r.query.strip()), key=lambda r: r["rank"])] == list(enumerate(targets[:5], 1))
    many = spark.range(20_000).select(F.concat(F.lit("src/m"), (F.col("id") % 50).cast("string"), F.lit("/name"), F.col("id").cast("string"), F.lit(".rs")).alias("target"))
    own = many.select("target", F.col("target").alias("low"))
    matches, loose = suggest.scored_pairs(spark.range(0, 20_000, 20).select(F.concat(F.lit("name"), F.col("id").cast("string")).alias("q")), own, 1)
    assert matches.count() + loose.count() < 20_000  # of 20,000,000


def test_the_gate_of_json_arrays(spark):
    from tracery.sources import sinks

    found = [r.value for r in sinks.json_array(spark.range(3)).collect()]
    assert found == ["[", '{"id":0},', '{"id":1},', '{"id":2}', "]"]
