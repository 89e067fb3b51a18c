"""Recursive operators as loops of joins: closures, cycles, chains. Each round is a checkpoint, so plans stay short."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import per_value


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a folder of our own serves a local session; on a cluster it is an error, as each
    machine would write to its own disk.
    """
    sc = spark.sparkContext
    own = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not own and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(own or f"file://{tempfile.gettempdir()}/tracery-checkpoints-{uuid.uuid4().hex}")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: as cut(), for what is costly to evaluate, which a checkpoint does twice."""
    path = f"{shared_folder(df.sparkSession)}/tracery-kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rounds whose additions are read as they are before they are written as one.
TOGETHER = 16


def _flood(front: DataFrame, edges: DataFrame) -> DataFrame:
    """front (id) and all ids that edges (src, dst) lead to from it, a round for each step. Each round joins and writes only what the last one added."""
    seen, rounds = front, 1
    while front.limit(1).count():
        step = edges.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen, "id", "left_anti"))
        seen, rounds = seen.union(front), rounds + 1
        if rounds % TOGETHER == 0:
            seen = cut(seen)
    return seen


def reachable(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids reached from starts (id) by edges (src, dst) in one step or more; cycles end by themselves.

    Ids with one edge into them are chains and trees: each looks up its line of descent by doubling a pointer, until
    it has met a start or an id where several edges meet, so a chain takes rounds as the logarithm of its length.
    Only where edges meet does a round follow each step, from one such id to the next.
    """
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    began = starts.select(F.col("id").alias("src")).distinct().withColumn("_s", F.lit(True))
    into = edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("src"))
    line = into.where("n = 1").join(began, "src", "left").select(F.col("dst").alias("id"), F.col("src").alias("at"), F.coalesce("_s", F.lit(False)).alias("hit"))
    line = cut(line)
    single = line.select(F.col("id").alias("at"))
    ended = cut(line.where("hit").union(line.where("not hit").join(single, "at", "left_anti").select("id", "at", "hit")))
    open_ = cut(line.where("not hit").join(single, "at", "left_semi").select("id", "at", "hit"))
    before = -1
    while (n := open_.count()) and n != before:  # those of rings without a start never end, and are not reached
        known = ended.select(F.col("id").alias("at"), F.col("at").alias("_at"), "hit", F.lit(True).alias("_end")).union(open_.select(F.col("id").alias("at"), F.col("at").alias("_at"), "hit", F.lit(False)))
        step = cut(open_.select("id", "at").join(known, "at").select("id", F.col("_at").alias("at"), "hit", "_end"))
        ended = ended.union(step.where("_end").drop("_end"))
        open_, before = step.where("not _end").drop("_end"), n
    many = cut(into.where("n > 1").select(F.col("dst").alias("id")))
    found = ended.where("hit").select("id")
    if not many.limit(1).count():
        return found
    met = edges.join(many.select(F.col("id").alias("dst")), "dst", "left_semi").join(began, "src", "left").join(ended.union(open_).select(F.col("id").alias("src"), "at", "hit"), "src", "left")
    met = cut(met.select("dst", F.coalesce("at", "src").alias("src"), (F.coalesce("_s", F.lit(False)) | F.coalesce("hit", F.lit(False))).alias("hit")))
    first = cut(met.where("hit").select(F.col("dst").alias("id")).distinct())
    meets = cut(_flood(first, cut(met.where("not hit").join(many.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst").distinct())))
    below = ended.where("not hit").join(meets.select(F.col("id").alias("at")), "at", "left_semi").select("id")
    return found.union(meets).union(below)


def effective(decisions: DataFrame, supersedes: DataFrame) -> DataFrame:
    """Accepted decisions (id, status) that no accepted one supersedes, through decisions of any status."""
    accepted = decisions.where("status = 'accepted'").select("id")
    return accepted.join(reachable(accepted, supersedes), "id", "left_anti")


def historical(decisions: DataFrame, supersedes: DataFrame) -> DataFrame:
    """Accepted decisions that another supersedes."""
    accepted = decisions.where("status = 'accepted'").select("id")
    return accepted.join(reachable(accepted, supersedes), "id", "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of ids that edges (src, dst) join, whatever their direction; a component is named by its smallest id.

    Each round every id hooks to its smallest neighbour, pointers jump once and edges are drawn together, so rounds grow with
    the logarithm of the longest chain. Ids that only loops have are in no component.
    """
    live, whole = kept(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct()), None
    while live.limit(1).count():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("to"))
        jump = kept(hook.join(hook.select(F.col("id").alias("to"), F.col("to").alias("_to")), "to").select("id", F.col("_to").alias("to")))
        step = jump.select("id", F.col("to").alias("component"))
        whole = step if whole is None else kept(whole.join(jump.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        a, b = jump.select(F.col("id").alias("a"), F.col("to").alias("_a")), jump.select(F.col("id").alias("b"), F.col("to").alias("_b"))
        live = kept(live.join(a, "a").join(b, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).where("a < b").distinct())
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("component")).limit(0) if whole is None else whole


def chain_ends(edges: DataFrame) -> DataFrame:
    """(start, end, steps) of chains of edges (src, dst) that do not branch, from every start, by pointer doubling.

    The rounds grow with the logarithm of the longest chain. A start on a cycle, or on the way to one, has no
    end and no row.
    """
    ends = edges.select(F.col("dst").alias("id")).distinct().join(edges.select(F.col("src").alias("id")), "id", "left_anti")
    left = edges.select(F.col("src").alias("start"), F.col("dst").alias("at"), F.lit(1).cast("long").alias("steps"))
    left = left.join(ends.select(F.col("id").alias("at"), F.lit(True).alias("_end")), "at", "left")
    step = kept(left.select("start", "at", "steps", F.coalesce("_end", F.lit(False)).alias("_end")))
    done, left, before, rounds = step.where("_end"), step.where("not _end"), -1, 1
    while (n := left.count()) and n != before:
        known = done.union(left).select(F.col("start").alias("at"), F.col("at").alias("_to"), F.col("steps").alias("_more"), "_end")
        step = kept(left.drop("_end").join(known, "at").select("start", F.col("_to").alias("at"), (F.col("steps") + F.col("_more")).alias("steps"), "_end"))
        new, left, rounds = step.where("_end"), step.where("not _end"), rounds + 1
        before = n if not new.limit(1).count() else -1
        done = done.union(new)
        if rounds % TOGETHER == 0:
            done = kept(done)
    return done.select("start", F.col("at").alias("end"), "steps")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those off all cycles: ends that nothing leads to, or that lead nowhere, are peeled away."""
    n = edges.count()
    while n:
        kept = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        kept = cut(kept.join(kept.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        n, before = kept.count(), n
        edges = kept
        if n == before:
            break
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(id, component) of components of two ids or more: all ids take the greatest one that leads to them as colour, and a
    component is what leads back to its colour's own id through ids of that colour. What is left begins anew."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("component")).limit(0)
    live = _trimmed(edges)
    while live.limit(1).count():
        colour = cut(live.select(F.col("src").alias("id")).union(live.select("dst")).distinct().withColumn("colour", F.col("id")))
        front = colour
        while front.limit(1).count():
            told = live.join(front.select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("told"))
            front = cut(told.join(colour, "id").where("told > colour").select("id", F.col("told").alias("colour")))
            colour = cut(colour.join(front.select("id", F.col("colour").alias("new")), "id", "left").select("id", F.coalesce("new", "colour").alias("colour")))
        own = live.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("d")), "dst").where("c = d")
        own = cut(own.select("src", "dst", "c"))
        # Colours have no edges between them here, so one flood serves all.
        back = _flood(cut(own.select(F.col("c").alias("id")).distinct()), own.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        named = cut(back.join(colour, "id").select("id", F.col("colour").alias("component")))
        out = out.union(named)
        rest = own.join(named.select(F.col("id").alias("src")), "src", "left_anti").join(named.select(F.col("id").alias("dst")), "dst", "left_anti")
        live = _trimmed(cut(rest.select("src", "dst")))
    many = out.groupBy("component").count().where("count > 1").select("component")
    return out.join(many, "component", "left_semi").select("id", "component")


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ids on a cycle of edges (src, dst): ids that lead to each other have one component, named by its smallest id.

    Ids with one edge in and one out are taken out first and their chains followed by doubled pointers, so long chains
    and rings take few rounds; what is left is trimmed and told apart by colours, in rounds as long as its paths.
    """
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    loops = edges.where("src = dst").select(F.col("src").alias("id"))
    plain = edges.where("src <> dst")
    ins, outs = plain.groupBy(F.col("dst").alias("id")).count().where("count = 1"), plain.groupBy(F.col("src").alias("id")).count().where("count = 1")
    passing = cut(ins.select("id").join(outs.select("id"), "id", "left_semi").join(loops, "id", "left_anti"))
    at = lambda c: passing.select(F.col("id").alias(c))
    hops, backs = cut(plain.join(at("src"), "src", "left_semi").select("src", "dst")), cut(plain.join(at("dst"), "dst", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ends, heads = chain_ends(hops).select(F.col("start").alias("id"), "end"), chain_ends(backs).select(F.col("start").alias("id"), F.col("end").alias("head"))
    short = plain.join(at("src"), "src", "left_anti").join(ends.select(F.col("id").alias("dst"), "end"), "dst", "left")
    short = cut(short.select("src", F.coalesce("end", "dst").alias("dst")).distinct())
    named = cut(_coloured(short.where("src <> dst")))
    alone = loops.union(short.where("src = dst").select("src")).distinct().join(named, "id", "left_anti").select("id", F.col("id").alias("component"))
    whole = cut(named.union(alone))
    name = lambda c, out: whole.select(F.col("id").alias(c), F.col("component").alias(out))
    inside = heads.join(ends, "id").join(name("head", "h"), "head").join(name("end", "e"), "end").where("h = e").select("id", F.col("h").alias("component"))
    # Rings: chains without an end. Each id learns the least of ever longer stretches of its ring.
    ring = cut(hops.join(ends.select(F.col("id").alias("src")), "src", "left_anti").select(F.col("src").alias("id"), F.col("dst").alias("at"), F.least("src", "dst").alias("component")))
    for _ in range(ring.count().bit_length()):
        ring = cut(ring.join(ring.select(F.col("id").alias("at"), F.col("at").alias("to"), F.col("component").alias("c")), "at").select("id", F.col("to").alias("at"), F.least("component", "c").alias("component")))
    found = whole.union(inside).union(ring.select("id", "component"))
    least = found.groupBy("component").agg(F.min("id").alias("least"))
    return found.join(least, "component").select("id", F.col("least").alias("component"))


def _ring_paths(ring: DataFrame) -> DataFrame:
    """(start, path) of edges (src, dst, component) whose components are rings: each ring from each of its ids on."""
    chain = ring.where(F.col("dst") != F.col("component")).select("src", "dst")
    place = chain_ends(chain).select(F.col("start").alias("src"), "steps")  # the rest of the ring behind it, up to its smallest id
    order = ring.join(place, "src", "left").withColumn("left", F.coalesce("steps", F.lit(0).cast("long")))
    whole = order.groupBy("component").agg(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("at"), F.col("src").alias("id")))).alias("ids"))
    ids = F.transform("ids", lambda x: x["id"])
    turn = F.posexplode(ids).alias("k", "start")
    rows = whole.select(ids.alias("path"), turn)
    return rows.select("start", F.concat(F.slice("path", F.col("k") + 1, F.size("path")), F.slice("path", F.lit(1), F.col("k"))).alias("path"))


def _tree_paths(inner: DataFrame) -> DataFrame:
    """(id, path) for edges (src, dst, component): a shortest path to each id from its component's name, of those the least."""
    seen = cut(inner.select(F.col("component").alias("id")).distinct().withColumn("path", F.array("id")))
    front = seen
    while front.limit(1).count():
        step = inner.join(front.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("path").alias("path"))
        front = cut(step.join(seen, "id", "left_anti").select("id", F.concat("path", F.array("id")).alias("path")))
        seen = seen.union(front)
    return cut(seen)


def cycles(edges: DataFrame) -> DataFrame:
    """(start, path): for each id on a cycle a simple cycle through it, the path beginning at that id.

    Paths are sought only inside components, and no more than two for each id: from the component's smallest id and back
    to it. They make a closed walk, which is cut short wherever it meets itself. Work grows with edges times the
    length of these paths, not with the number of cycles.
    """
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    own = strong_components(edges)
    inner = edges.join(own.withColumnRenamed("id", "src"), "src").join(own.select(F.col("id").alias("dst"), F.col("component").alias("c")), "dst").where("component = c").select("src", "dst", "component")
    inner = cut(inner)
    loops = inner.where("src = dst").select(F.col("src").alias("start"), F.array("src").alias("path"))
    plain = cut(inner.where("src <> dst"))
    branched = plain.groupBy("component", "src").count().where("count > 1").select("component").distinct()
    rings, webs = plain.join(branched, "component", "left_anti").select(plain.columns), cut(plain.join(branched, "component", "left_semi").select(plain.columns))
    out = loops.union(_ring_paths(rings).join(loops.select("start"), "start", "left_anti").select("start", "path"))
    if not webs.limit(1).count():
        return out
    there = _tree_paths(webs)
    back = _tree_paths(webs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "component")).select("id", F.reverse("path").alias("back"))
    last = webs.where("dst = component").join(there.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct(F.size("path").alias("n"), "path"))["path"].alias("round"))
    walks = there.join(back, "id").join(last, "id", "left")
    walk = F.when(F.size("path") == 1, F.col("round")).otherwise(F.concat("back", F.slice("path", F.lit(2), F.size("path") - 2)))
    erased = F.aggregate("walk", F.slice("walk", 1, 0), lambda a, x: F.when(F.array_contains(a, x), F.slice(a, F.lit(1), F.array_position(a, x).cast("int"))).otherwise(F.concat(a, F.array(x))))
    found = walks.select(F.col("id").alias("start"), walk.alias("walk")).select("start", erased.alias("path"))
    return out.union(found.join(loops.select("start"), "start", "left_anti").select("start", "path"))


def braces(text: str | None) -> list[str]:
    """All that a text with braces stands for: each group is expanded by itself, at any depth; one left open ends with the text."""
    if text is None:
        return []
    stack: list[tuple[list[str], list[str]]] = [([], [""])]  # for each open group what is done, and what is being written

    def end() -> None:
        own, now = stack.pop()
        own += [x for p in now if (x := p.strip())]
        above, outer = stack[-1]
        stack[-1] = (above, [o + x for o in outer for x in own])

    for part in re.findall(r"[{},]|[^{},]+", text):
        own, now = stack[-1]
        if part == "{":
            stack.append(([], [""]))
        elif part == "," and len(stack) > 1:
            stack[-1] = (own + [x for p in now if (x := p.strip())], [""])
        elif part == "}" and len(stack) > 1:
            end()
        else:
            stack[-1] = (own, [p + part for p in now])
    while len(stack) > 1:
        end()
    return stack[0][1]


def expand_braces(modules: DataFrame, column: str) -> DataFrame:
    """Rows with the braces of a::{b, c::{d}} written out in the column itself, however many and deep they are."""
    plain, nested = modules.where(~F.col(column).contains("{")), modules.where(F.col(column).contains("{"))
    own = F.explode(per_value(braces, "array<string>")(F.col(column)))
    return plain.union(nested.withColumn(column, own)).withColumn(column, F.regexp_replace(column, "::self$", "")).distinct()
