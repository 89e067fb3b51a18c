import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracery.operators.hashing import typed_hash
from tracery.sources import code, config, files, notes, sinks, snapshots
from tracery.streaming import refresh

NOTE = """---
id: ADR-0001
kind: decision
governs: ["src/**"]
policy:
  patterns:
    - {id: p, language: rust, pattern: println}
---
# Use Spark

See [[guide#Intro|x]] and `[[not]]`.

```
[[nor this]]
```
Context
-------
"""


def test_note():
    n = notes.parse("a.md", NOTE)
    assert (n["id"], n["governs"], n["policies"][0]["pattern"]) == ("ADR-0001", ["src/**"], "println")
    assert n["headings"] == [{"level": 1, "text": "Use Spark", "line": 9}, {"level": 2, "text": "Context", "line": 16}]
    assert n["links"] == [{"link": "guide#Intro|x", "line": 11}]
    bad = notes.parse("b.md", "---\nid: [\n---\nx")
    assert bad["frontmatter_error"] and bad["id"] is None and bad["body"].startswith("---")
    assert notes.split_frontmatter("---\r\na: 1\r\n---\r\nb")[1] == "b" and notes.split_frontmatter("---\na: 1\n---")[0] is None


@given(st.text())
def test_any_text_is_a_note(t):
    head, body, before = notes.split_frontmatter(t)
    assert t.endswith(body) and (head is not None or body == t)
    notes.parse("x.md", t)


def test_notes_frame(spark):
    got = notes.notes(spark.createDataFrame([("a.md", NOTE), ("n.md", None)], "path string, text string")).orderBy("path").collect()
    assert got[0].links[0].link == "guide#Intro|x" and got[1].headings == []


def test_code(spark):
    rust = "use a::{b, c};\nimpl Foo {\n    pub fn run(&self) {\n        helper(1);\n        println!(\"x()\");\n    }\n}\nfn helper(x: u8) {}\n"
    py = "import os\nclass A:\n    def go(self):\n        return help(os.path.join('x'))\ndef _no():\n    pass\n"
    f = code.parsed(spark.createDataFrame([("a.rs", "rust", rust), ("b.py", "python", py), ("c.txt", "unknown", "x()")], "path string, language string, text string")).orderBy("path").collect()
    assert [(s.name, s.kind, s.parent, s.exported, s.start_line, s.end_line) for s in f[0].symbols] == [("run", "method", "Foo", True, 3, 6), ("helper", "function", None, False, 8, 8)]
    assert [(c.caller, c.text) for c in f[0].calls] == [("run", "helper")] and f[0].imports[0].module == "a::{b, c}"
    assert [(s.name, s.kind, s.exported) for s in f[1].symbols] == [("A", "class", True), ("go", "method", True), ("_no", "function", False)]
    assert {(c.caller, c.text) for c in f[1].calls} == {("A", "help"), ("go", "help"), ("A", "join"), ("go", "join")} and f[2].symbols == []


def test_config():
    c = config.read('[vault]\ndocs = "./doc"\n[source]\nroots = ["src/", "lib"]\n[state]\nkeep = 3\n[other]\nx = 1')
    assert (c.docs, c.roots, c.keep, c.stages) == ("doc", ["src", "lib"], 3, ["commit", "push", "ci"])
    for bad in ('[vault]\ndocs = "../x"', '[vault]\ndocs = "/x"', "[patterns]\na = 1"):
        with pytest.raises(ValueError):
            config.read(bad)


def test_files(spark, tmp_path):
    for name, data in {"src/a.py": b"x = 1\n", "src/b.bin": b"a\0b", "src/node_modules/c.py": b"1", "lib/d.rs": b"fn d() {}", "img/e.png": b"\x89PNG....", "img/f.png": b"no", "img/g.png": b"\x89PNG" + b"0" * 100}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    all_ = files.listing(spark, str(tmp_path))
    assert [(r.path, r.language) for r in files.sources(all_.where("path not like 'img/%'")).orderBy("path").collect()] == [("lib/d.rs", "rust"), ("src/a.py", "python")]
    assert [r.path for r in files.assets(all_).collect()] == ["img/e.png", "img/g.png"]
    assert [r.path for r in files.assets(all_, budget=50).collect()] == ["img/e.png"]
    assert files.planned_roots(["src", "src/a", "lib/"]) == ["lib", "src"]


def graph(spark, ids):
    n = spark.createDataFrame([(i,) for i in ids], "id string").withColumn("hash", typed_hash("node", F.col("id")))
    e = spark.createDataFrame([], "src string, dst string, kind string, hash string")
    return {"nodes": n, "edges": e}


def test_snapshots(spark, tmp_path):
    folder = f"file://{tmp_path}/state"
    roots = [snapshots.publish(spark, folder, graph(spark, ids), keep=2) for ids in (["a"], ["a", "b"], ["c"], ["a", "b"])]
    assert roots[1] == roots[3] and [x["root"] for x in snapshots.history(spark, folder)] == [roots[2], roots[1]]
    assert sorted(r.id for r in snapshots.load(spark, folder, "latest", "nodes").collect()) == ["a", "b"]
    assert not (tmp_path / "state" / roots[0]).exists()
    with pytest.raises(ValueError):
        snapshots.load(spark, folder, roots[0], "nodes")


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("b", 2), ("a", None)], "x string, y long")
    assert [r.value for r in sinks.lines(d, "text", 1).collect()] == ["a"]
    assert json.loads(sinks.lines(d, "ndjson").collect()[1].value) == {"x": "b", "y": 2}
    sinks.write(d, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize("stop", ["staged", "installed", "committed"])
def test_a_publication_may_stop_anywhere(spark, tmp_path, stop):
    folder = f"file://{tmp_path}/state"
    first = snapshots.publish(spark, folder, graph(spark, ["a"]))

    def die(step):
        if step == stop:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        snapshots.publish(spark, folder, graph(spark, ["a", "b"]), at=die)
    seen = sorted(r.id for r in snapshots.load(spark, folder, "latest", "nodes").collect())
    assert seen == (["a", "b"] if stop == "committed" else ["a"])
    assert first in [x["root"] for x in snapshots.history(spark, folder)]
    again = snapshots.publish(spark, folder, graph(spark, ["a", "b"]))
    assert [x["root"] for x in snapshots.history(spark, folder)] == [first, again]
    assert sorted(p.name for p in (tmp_path / "state").iterdir() if not p.name.startswith(".")) == sorted([first, again, *(p.name for p in (tmp_path / "state").glob("index.*.json"))])
    assert len(list((tmp_path / "state").glob("index.*.json"))) == 1


def test_every_table_counts(spark, tmp_path):
    folder = f"file://{tmp_path}/state"
    patterns = [graph(spark, ["a"]) | {"patterns": spark.createDataFrame([(x,)], "id string")} for x in "pq"]
    one, two = (snapshots.publish(spark, folder, t) for t in patterns)
    assert one != two and [snapshots.load(spark, folder, r, "patterns").first().id for r in (one, two)] == ["p", "q"]
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "state" / one).rglob("*.parquet")}
    assert snapshots.publish(spark, folder, patterns[0]) == one
    assert {p: p.stat().st_mtime_ns for p in files} == files  # readers' files stay as they are


def test_refresh(spark, tmp_path):
    drops, folder = tmp_path / "events", f"file://{tmp_path}/state"
    drops.mkdir()
    causes, fail = [], [False]

    def rebuild(why):
        causes.append(why)
        if fail[0]:
            raise OSError("no source")
        return graph(spark, ["n" * len(causes)])

    fresh = lambda: refresh.Refresh(spark, f"{folder}/own", rebuild, lambda t: snapshots.publish(spark, folder, t))
    handler = fresh()

    def drop(name, *paths):
        (drops / name).write_text("\n".join(json.dumps({"path": p}) for p in paths))
        refresh.watch(refresh.event_stream(spark, str(drops)), handler, str(tmp_path / "check"), ["src"], "docs").awaitTermination()

    drop("1.json", "src/a.rs", "docs/a.md")
    first = handler.last
    drop("2.json", "other/x")
    fail[0] = True
    drop("3.json", "src/b.rs")
    assert handler.last == first and handler.errors == ["no source"] and handler.pending == "source"
    handler = fresh()  # the process died
    assert handler.pending == "source" and handler.last == first and handler.done == 2
    fail[0] = False
    drop("4.json", "docs/b.md")
    assert causes == ["source", "source", "source"] and handler.generation == 2 and handler.pending is None
    assert [x["root"] for x in snapshots.history(spark, folder)] == [first, handler.last]


def test_a_configuration_that_changes_around_the_commit(spark, tmp_path):
    config, published = [1], []

    def commit(tables):
        published.append(tables)
        config[0] += 1
        return "root"

    handler = refresh.Refresh(spark, f"file://{tmp_path}/own", lambda why: {}, commit, lambda: config[0])
    assert not handler.refresh("docs") and len(published) == 1 and handler.pending == "docs"
    handler.commit = lambda tables: "root"
    assert handler.refresh(None) and handler.pending is None
    handler.rebuild = lambda why: config.__setitem__(0, 99) or {}
    handler.commit = published.append
    assert not handler.refresh("docs") and len(published) == 1


def test_events_before_the_first_build_wait(spark, tmp_path):
    order = []
    handler = refresh.Refresh(spark, f"file://{tmp_path}/own", lambda why: order.append(why) or {}, lambda t: "r")
    import threading

    batch = spark.createDataFrame([("docs",)], "what string")
    other = threading.Thread(target=lambda: handler(batch, 0))

    def start():
        other.start()
        return "query"

    assert refresh.started(handler, start) == "query"
    other.join()
    assert order == ["source", "docs"]


def test_only_the_newest_load_publishes():
    gone = []
    r = refresh.Revisions(gone.append)
    a, b = r.begin(), r.begin()
    assert not r.publish(a, "late") and r.publish(b, "new") and r.current == "new" and gone == ["late"]
    c = r.begin()
    assert r.publish(c, "newer") and gone == ["late", "new"]


def test_generations_follow_the_configuration():
    class Query:
        isActive = True

        def stop(self):
            self.isActive = False

    config, made = ["a"], []

    def start(c):
        if c == "bad":
            raise OSError("cannot watch")
        made.append((c, Query()))
        return made[-1][1]

    g = refresh.Generations(lambda: config[0], start)
    assert g.step() and g.step() and [c for c, _ in made] == ["a"]
    config[0] = "bad"
    assert not g.step() and not made[0][1].isActive and g.errors == ["cannot watch"]
    config[0] = "b"
    assert g.step() and g.number == 2 and made[-1][1].isActive


def test_incremental_equals_full(spark):
    parse = lambda t: code.parsed(t).withColumn("n", F.size("symbols")).select("path", "n")
    frame = lambda d: spark.createDataFrame([(p, "python", t) for p, t in d.items()], "path string, language string, text string").withColumn("hash", F.sha2("text", 256))
    one, two = frame({"a": "def x(): pass", "b": "1", "c": "def y(): pass"}), frame({"a": "def x(): pass", "b": "def z(): pass", "d": "2"})
    full = lambda t: parse(t).join(t.select("path", "hash"), "path")
    got = refresh.incremental(full(one), two, parse)
    assert sorted(map(tuple, got.select("path", "hash", "n").collect())) == sorted(map(tuple, full(two).select("path", "hash", "n").collect()))


def test_single_writer(tmp_path):
    with refresh.single_writer(str(tmp_path / "lock")), pytest.raises(BlockingIOError), refresh.single_writer(str(tmp_path / "lock")):
        pass


ELIXIR = """defmodule Acme.Worker do
  @moduledoc '''
  def not_code(x)
  '''
  alias Acme.{Store, Other}
  alias Acme.Long.Name, as: Short
  import Enum, only: [map: 2], except: [sum: 1]
  use GenServer
  @behaviour Acme.Job
  @callback handle(term, integer) :: :ok

  def run(x, opts \\\\ []) when is_list(opts) do
    alias Acme.Inner
    x |> Store.put(1) |> local(2)   # comment(1)
    Inner.go()
    Enum.each(x, &helper/1)
    f = &Short.call/3
    apply(Acme.Late, :fun, [1, 2])
    apply(x, :y, z)
    x.send(1)
    fn a -> bump(a) end
  end

  def run(:none, _), do: Other.none()
  defp helper(y) do
    if y do
      ~r/call(1)/
    end
  end
  defdelegate size(map), to: Map, as: :count
  defmacro mac(a), do: a
end

defimpl Enumerable, for: Acme.Worker do
  def count(_), do: 0
end
""".replace("'''", '"' * 3)


def test_elixir():
    from tracery.sources import elixir

    r = elixir.parse("a.ex", ELIXIR)
    assert [(m["name"], m["kind"], m["start_line"], m["end_line"]) for m in r["modules"]] == [("Acme.Worker", "module", 1, 32), ("Enumerable.Acme.Worker", "implementation", 34, 36)]
    assert [(c["kind"], c["name"], c["least"], c["most"], c["exported"], c["start_line"], c["end_line"]) for c in r["callables"]] == [
        ("callback", "handle", 2, 2, True, 10, 10), ("function", "run", 1, 2, True, 12, 22), ("function", "run", 2, 2, True, 24, 24), ("function", "helper", 1, 1, False, 25, 29),
        ("function", "size", 1, 1, True, 30, 30), ("macro", "mac", 1, 1, True, 31, 31), ("function", "count", 1, 1, True, 35, 35),
    ]
    assert [(d["kind"], d["module"], d["alias"], d["scope_start"], d["scope_end"]) for d in r["directives"]] == [
        ("alias", "Acme.Store", "Store", 5, 32), ("alias", "Acme.Other", "Other", 5, 32), ("alias", "Acme.Long.Name", "Short", 6, 32), ("import", "Enum", None, 7, 32), ("use", "GenServer", None, 8, 32), ("alias", "Acme.Inner", "Inner", 13, 22),
    ]
    assert [(x["kind"], x["module"], x["name"], x["arity"], x["line"]) for x in r["relations"]] == [
        ("implementation", "Acme.Job", None, None, 9), ("call", "Store", "put", 2, 14), ("call", None, "local", 2, 14), ("call", "Inner", "go", 0, 15), ("call", "Enum", "each", 2, 16), ("capture", None, "helper", 1, 16),
        ("capture", "Short", "call", 3, 17), ("call", "Acme.Late", "fun", 2, 18), ("dynamic", None, None, None, 19), ("dynamic", None, "send", 1, 20), ("call", None, "bump", 1, 21), ("call", "Other", "none", 0, 24),
        ("delegate", "Map", "count", 1, 30), ("protocol", "Enumerable", None, None, 34),
    ]


@given(st.text(st.sampled_from("def do end fn(){}[],.:&|>/@#\"\\A1 x\n")))
def test_any_text_is_elixir(t):
    from tracery.functions import pattern
    from tracery.sources import elixir

    elixir.parse("x.ex", t)
    pattern.tokens(t)


def test_code_patterns():
    from tracery.functions import pattern

    find = lambda text, p=None, rule=None: [(line, place, captures) for line, place, _, captures in pattern.matches(text, p, rule)]
    assert find("a = f(1, g(2));\n// f(3)\n\"f(4)\"; x.f(5)", "f($$$A)") == [(1, "L1:C5-L1:C15", {"A": "1\n,\ng(2)"})]
    assert find("f(a, a) f(a, b)", "f($X, $X)") == [(1, "L1:C1-L1:C8", {"X": "a"})]
    assert find("if x { log(1) } log(2)", rule="{pattern: log($A), inside: {pattern: 'if x { $$$ }'}}") == [(1, "L1:C8-L1:C14", {"A": "1"})]
    assert find("f(g(1)) f(2)", rule="{any: [{pattern: f($A)}], has: {pattern: g($B)}}") == [(1, "L1:C1-L1:C8", {"A": "g(1)"})]
    assert pattern.error("", None) and pattern.error(None, "kind: call") and pattern.error(None, "[") and not pattern.error("f($A)", None)


def test_publication_is_blocked_by_what_governs_nothing(spark, tmp_path):
    """The gate is derived from notes and files, and a blocked publication leaves the last snapshot."""
    from tracery.operators import checks

    note = "---\nid: ADR-0001\nkind: decision\ntitle: One\nstatus: {}\ngoverns: ['{}']\n---\n# One\n## Context\n## Decision\n## Consequences\n"
    files_ = spark.createDataFrame([("src/a.rs", "rust", "fn a() {}")], "path string, language string, text string")
    symbols = spark.createDataFrame([("src/a.rs#fn:a", "src/a.rs", "fn:a", ["a"])], "id string, path string, selector string, aliases array<string>")
    folder = f"file://{tmp_path}"

    def blockers(status, glob):
        texts = spark.createDataFrame([("docs/adr/0001-one.md", note.format(status, glob))], "path string, text string")
        return checks.blocking(checks.derive(notes.notes(texts), files_, symbols))

    first = snapshots.publish(spark, folder, {"files": files_}, blockers=blockers("accepted", "src/**"))
    with pytest.raises(snapshots.PublicationBlocked, match="unresolved-governs"):
        snapshots.publish(spark, folder, {"files": files_.limit(0)}, blockers=blockers("accepted", "lib/**"))
    with pytest.raises(snapshots.PublicationBlocked, match="invalid-glob"):
        snapshots.publish(spark, folder, {"files": files_.limit(0)}, blockers=blockers("accepted", "src/{x"))
    assert [x["root"] for x in snapshots.history(spark, folder)] == [first]
    assert snapshots.publish(spark, folder, {"files": files_.limit(0)}, blockers=blockers("draft", "lib/**")) != first


def test_derived_targets(spark):
    from tracery.operators import checks

    paths = spark.createDataFrame([("src/a.rs",), ("lib/b.rs",)], "path string")
    symbols = spark.createDataFrame([("src/a.rs#fn:run", "src/a.rs", "fn:run", ["run"])], "id string, path string, selector string, aliases array<string>")
    values = ["src/a.rs", "a.rs", "source:src/a.rs", "src/a.rs#fn:run", "src/a.rs#run", "a.rs#fn:run", "src/a.rs#fn:no", "none.rs", "src/a.rs#L3", "lib/b.rs#fn:run"]
    rows = checks.symbol_targets(spark.createDataFrame([(v,) for v in values], "value string"), paths, symbols).collect()
    assert {r.value: (r.found, r.legacy) for r in rows} == {
        "src/a.rs": (True, False), "a.rs": (True, True), "source:src/a.rs": (True, True), "src/a.rs#fn:run": (True, False), "src/a.rs#run": (True, True), "a.rs#fn:run": (True, True),
        "src/a.rs#fn:no": (False, False), "none.rs": (False, False), "src/a.rs#L3": (True, False), "lib/b.rs#fn:run": (False, False),
    }


def test_only_stale_pairs_are_scanned_again(spark, tmp_path):
    from tracery.operators import partitions, policy

    files_ = lambda texts: spark.createDataFrame([(p, "rust", str(hash(t)), t) for p, t in texts.items()], "path string, language string, hash string, text string")
    texts = {f"src/{i}.rs": f"fn a() {{ log({i}) }}" for i in range(20)}
    policies = lambda pattern: spark.createDataFrame([("p", "d", "rust", "log($A)", None), ("q", "d", "rust", pattern, None), ("bad", "d", "rust", None, "pattern: log\nregex: '('")], "id string, decision string, language string, pattern string, rule string")
    globs = spark.createDataFrame([("d", "src/**")], "decision string, glob string")
    scope = lambda texts: spark.createDataFrame([("d", p) for p in texts], "decision string, path string")
    folder = f"file://{tmp_path}/kept"

    def scan(texts, pattern="drop($A)", globs=globs):
        plan = partitions.plan(policies(pattern), globs)
        n = partitions.rescan(spark, folder, files_(texts), plan, scope(texts))
        full = policy.matches(files_(texts).drop("hash"), policies(pattern), scope(texts))
        key = lambda df: sorted((r.id, r.path, r.line, r.range, r.text, sorted(r.captures.items())) for r in df.collect())
        assert key(partitions.matches(spark, folder)) == key(full)
        return n

    assert scan(texts) == 60
    assert scan(texts) == 0
    texts["src/3.rs"] = "fn b() { drop(x) }"
    assert scan(texts) == 3  # one file for each policy
    assert scan(texts, "log(4)") == 20  # one policy for each file
    del texts["src/3.rs"], texts["src/4.rs"]
    assert scan(texts, "log(4)") == 0  # the last match of a policy is gone
    assert scan({}, "log(4)") == 0
    assert scan(texts, "log(4)", globs.limit(0)) == 54  # other globs are another policy


def test_a_change_reads_only_its_branches(spark, tmp_path):
    from tracery.operators import hashtree
    from tracery.operators.hashing import root_hash

    hashed = lambda lo, hi: spark.range(lo, hi).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    before = hashed(0, 3000).union(hashed(7, 9))  # two are there twice
    folder = f"file://{tmp_path}/tree"
    hashtree.store(hashtree.build(before), folder)
    tree = hashtree.load(spark, folder)
    assert hashtree.same_root(tree)
    came, gone = hashed(5000, 5004), hashed(7, 8).union(hashed(100, 103)).union(hashed(9999, 10000))
    after, read = hashtree.updated(tree, came, gone)
    want = before.exceptAll(gone).union(came)
    assert after.root().first()[0] == root_hash(want).first()[0]
    assert hashtree.same_root(after) and after.leaves.count() == want.count()
    assert 5 <= read.count() < 20  # of 3,002
    found, seen = hashtree.differences(tree, after)
    assert sorted((r.change, r.hash, r.n) for r in found.collect()) == sorted([("added", r.hash, 1) for r in came.collect()] + [("removed", r.hash, 1) for r in gone.collect() if r.hash != hashed(9999, 10000).first().hash])
    assert seen.count() < 40
    same, seen = hashtree.differences(tree, hashtree.load(spark, folder))
    assert same.count() == seen.count() == 0
    emptied, _ = hashtree.updated(tree, before.limit(0), before)
    assert emptied.leaves.count() == 0


def test_stored_snapshots_are_compared_without_a_shuffle(spark, tmp_path):
    edge = "src string, kind string, dst string, hash string"
    tables = lambda nodes, edges: {"nodes": spark.createDataFrame([(n, f"h{n}") for n in nodes], "id string, hash string"), "edges": spark.createDataFrame([(*e, "".join(e)) for e in edges], edge)}
    folder = f"file://{tmp_path}"
    old, new = tables("abc", [("a", "calls", "b"), ("b", "calls", "c")]), tables("abd", [("a", "calls", "b"), ("a", "calls", "d")])
    a, b = (snapshots.publish(spark, folder, t, buckets=4) for t in (old, new))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the tables were large
    try:
        found = snapshots.stored_diff(spark, folder, a, b)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert sorted(map(tuple, found.collect())) == [("edge_added", "a:calls:d"), ("edge_removed", "b:calls:c"), ("node_added", "d"), ("node_removed", "c")]
    assert sorted(r.id for r in snapshots.load(spark, folder, "latest", "nodes").collect()) == ["a", "b", "d"]
    c = snapshots.publish(spark, folder, tables("a", []), buckets=None)
    assert sorted(map(tuple, snapshots.stored_diff(spark, folder, "latest", b).collect()))[:2] == [("edge_added", "a:calls:b"), ("edge_added", "a:calls:d")]
    assert snapshots.publish(spark, folder, new, buckets=None) == b and snapshots.history(spark, folder)[-1]["buckets"] == 4 and c != b
