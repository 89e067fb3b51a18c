"""Renames of files whose contents changed, and paths followed over a history of commits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spread import parts_for, sliced
from .ordered import asof_latest
from .recursion import chain_ends, components, kept
from .sets import changes_between

#: Shared bytes in a hundred of the larger file that make a rename.
LEAST = 50
#: Pairs of files that one task should meet over one piece.
PAIRS = 1 << 20
#: Pairs at most that one task takes from one by one, when no more are left.
REST = 1 << 19
#: Rounds go on while each settles one in so many pairs.
FEW = 2
#: Commits of a span in which the last arrival at a path is looked up.
SPAN = 1 << 16
# Fixed value: a piece is a line with its end, or 64 characters of a longer one.
PIECE = r"[^\n]{0,63}\n|[^\n]{1,64}"


def pieces(files: DataFrame) -> DataFrame:
    """(file, piece, n, bytes): the distinct pieces of files (file, text), how often each stands there and its bytes in all."""
    each = files.select("file", F.explode(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))).alias("p"))
    each = each.select("file", F.unhex(F.md5("p")).alias("piece"), F.octet_length("p").cast("long").alias("size"))
    return each.groupBy("file", "piece").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def shared_bytes(left: DataFrame, right: DataFrame, least: int = LEAST) -> DataFrame:
    """(left, right, percent) of all files (file, text) of two sides that share at least `least` of a hundred bytes of the larger one.

    Pieces are put in one order: first those that one side alone has, which are but counted, then the rarest. Two files that share enough share one piece at least of what
    comes before the last `least` hundredths of each, so only those are looked up: a piece that all files have is a
    lookup of no file that has enough else, but counts for the score. What many files look up is dealt over parts.
    """
    sides = kept(pieces(left).select(F.lit(0).alias("side"), "*").union(pieces(right).select(F.lit(1).alias("side"), "*")))
    both = sides.groupBy("piece").agg(F.count_if(F.col("side") == 0).alias("l"), F.count_if(F.col("side") == 1).alias("r")).where("l > 0 and r > 0")
    file, sizes = ["side", "file"], sides.groupBy("side", "file").agg(F.sum("bytes").alias("size"))
    own = sides.join(both.select("piece", (F.col("l") + F.col("r")).alias("files"), F.ceil(F.col("l") * F.col("r") / PAIRS).cast("int").alias("parts")), "piece")
    own = own.join(sizes, file).withColumn("left", F.sum("bytes").over(Window.partitionBy(*file)))
    own = kept(own.where(F.col("left") * 100 >= F.col("size") * least))
    before = Window.partitionBy(*file).orderBy("files", "piece").rowsBetween(Window.unboundedPreceding, -1)
    asked = own.withColumn("left", F.col("left") - F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    asked = kept(asked.where(F.col("left") * 100 >= F.col("size") * least).select("side", "file", "piece", "size", "parts"))
    a = asked.where("side = 0").select("piece", F.pmod(F.xxhash64("file"), "parts").cast("int").alias("part"), F.col("file").alias("left"), F.col("size").alias("l_size"))
    b = asked.where("side = 1").select("piece", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("file").alias("right"), F.col("size").alias("r_size"))
    larger, smaller = F.greatest("l_size", "r_size"), F.least("l_size", "r_size")
    pairs = a.join(b, ["piece", "part"]).where(smaller * 100 >= larger * least).select("left", "right", larger.alias("size")).distinct()
    mine = own.where("side = 0").select(F.col("file").alias("left"), "piece", F.col("n").alias("l_n"), (F.col("bytes") / F.col("n")).cast("long").alias("each"))
    other = own.where("side = 1").select(F.col("file").alias("right"), "piece", F.col("n").alias("r_n"))
    met = pairs.join(mine, "left").join(other, ["right", "piece"]).groupBy("left", "right", "size").agg(F.sum(F.least("l_n", "r_n") * F.col("each")).alias("shared"))
    return met.where(F.col("shared") * 100 >= F.col("size") * least).select("left", "right", F.floor(F.col("shared") * 100 / F.col("size")).cast("int").alias("percent"))


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What pairs take, the best first and group by group; what they bring are their ends' numbers and how many these still have."""
    names = ["left", "right", "percent", "l_from", "r_from", "n"]
    gone: tuple[dict, dict] = {}, {}
    used: tuple[set, set] = set(), set()  # ends that have none left
    group = None
    for batch in sliced(batches):
        rows = []
        columns = [batch.column(c) for c in (*names[2:5], "l_n", "r_n")]
        for k, (own, left, right) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("group", "left", "right")), strict=True)):
            if own != group:
                group, gone, used = own, ({}, {}), (set(), set())
            if left in used[0] or right in used[1]:
                continue
            percent, l_from, r_from, l_n, r_n = (c[k].as_py() for c in columns)
            l, r = gone[0].get(left, 0), gone[1].get(right, 0)
            if (n := min(l_n - l, r_n - r)) > 0:
                rows.append((left, right, percent, l_from + l, r_from + r, n))
                gone[0][left], gone[1][right] = l + n, r + n
            for side, end, there in ((0, left, l_n), (1, right, r_n)):
                if gone[side].get(end, 0) >= there:
                    used[side].add(end)
        kinds = [batch.schema.field(c).type for c in (*names[:5], "l_n")]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names)


def one_to_one(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right, l_from, r_from, n, percent): pairs (left, right, percent, equal) that are the best of both their ends, again and again.

    left, right: file, n, how many stand for the file. A pair takes as many of both as the smaller side still has,
    from the numbers l_from and r_from on. The best pair has the most percent, then equal contents, then the
    smallest names. The best of all pairs left is always taken, so rounds end; they are few where scores differ. Where
    many files are alike a round takes but one pair of them. So the last REST pairs are taken by one task in that
    order: of two pairs with an end in common the better one comes first, as in rounds. More pairs are taken so by many
    tasks once a round leaves all but one in FEW of them: a task takes whole groups, which have no end in common.
    """
    live = pairs.join(left.select(F.col("file").alias("left"), F.col("n").alias("l_n")), "left").join(right.select(F.col("file").alias("right"), F.col("n").alias("r_n")), "right")
    live = kept(live.select("left", "right", "percent", "equal", F.lit(0).cast("long").alias("l_from"), F.lit(0).cast("long").alias("r_from"), "l_n", "r_n"))
    order = (-F.col("percent"), ~F.col("equal"), "left", "right")
    schema = live.select("left", "right", "percent", "l_from", "r_from", F.col("l_n").alias("n")).schema
    out, n = None, live.count()
    while n:
        if n <= REST:
            last = live.withColumn("group", F.lit(0).cast("long")).repartition(1)
            last = kept(last.sortWithinPartitions(*order).mapInArrow(_taken, schema))
            return last if out is None else out.union(last)
        rank = lambda other: F.struct((-F.col("percent")).alias("p"), (~F.col("equal")).alias("e"), F.col(other).alias("to"))
        best = lambda end, other: F.min(rank(other)).over(Window.partitionBy(end))["to"]
        took = live.withColumn("_best", best("left", "right")).where(F.col("_best") == F.col("right")).drop("_best")
        took = took.join(live.groupBy("right").agg(F.min(rank("left"))["to"].alias("left")), ["left", "right"])
        took = kept(took.select("left", "right", "percent", "l_from", "r_from", F.least("l_n", "r_n").alias("n")))
        out = took if out is None else out.union(took)
        left_took, right_took = took.select("left", F.col("n").alias("l")), took.select("right", F.col("n").alias("r"))
        rest = live.join(took.select("left", "right"), ["left", "right"], "left_anti").join(left_took, "left", "left").join(right_took, "right", "left").fillna(0, ["l", "r"])
        rest = rest.select("left", "right", "percent", "equal", (F.col("l_from") + F.col("l")).alias("l_from"), (F.col("r_from") + F.col("r")).alias("r_from"), (F.col("l_n") - F.col("l")).alias("l_n"), (F.col("r_n") - F.col("r")).alias("r_n"))
        live = kept(rest.where("l_n > 0 and r_n > 0"))
        before, n = n, live.count()
        if n > REST and n * FEW > before:
            return out.union(kept(_grouped(live, n).sortWithinPartitions("group", *order).mapInArrow(_taken, schema)))
    return out if out is not None else live.select("left", "right", "l_from", "r_from", F.col("l_n").alias("n"), "percent")


def _grouped(live: DataFrame, rows: int) -> DataFrame:
    """Pairs dealt over tasks by group, those that ends in common join; two groups of one hash are one, which changes nothing."""
    edges = live.select(F.xxhash64(F.lit(0), "left").alias("src"), F.xxhash64(F.lit(1), "right").alias("dst"))
    named = components(edges).select(F.col("id").alias("_id"), F.col("component").alias("group"))
    return live.join(named, F.xxhash64(F.lit(0), "left") == F.col("_id")).drop("_id").repartition(parts_for(live.sparkSession, rows), "group")


def _numbered(files: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contents, members): each distinct content by its smallest path with text and count, and each path with its number there. names are the files' path and hash."""
    own = names.groupBy("hash").agg(F.min("path").alias("file"), F.count("*").alias("n"))
    texts = files.select("path", "text").join(own.select(F.col("file").alias("path"), "file", "hash", "n"), "path").select("file", "hash", "n", "text")
    members = names.join(own.select("hash", "file"), "hash").select("file", "path", (F.row_number().over(Window.partitionBy("file").orderBy("path")) - 1).cast("long").alias("number"))
    return texts, members


def similar_renames(deleted: DataFrame, added: DataFrame, least: int = LEAST, names: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(path, previous_path, percent): each deleted file (path, hash, text) with the added one that it became, one to one.

    Equal contents are compared once and paired in the order of their paths, so copies cost no pairs. A file
    without text, null or empty, is like no other. names: both sides' path and hash where they are known, and then those
    of the files that count.
    """
    names = names or tuple(kept(f.select("path", "hash")) for f in (deleted, added))
    (l_text, l_own), (r_text, r_own) = (_numbered(f, n) for f, n in zip((deleted, added), names, strict=True))
    l_text, r_text = kept(l_text), kept(r_text)
    found = shared_bytes(l_text.select("file", "text"), r_text.select("file", "text"), least)
    hashes = lambda t, name: t.select(F.col("file").alias(name), F.col("hash").alias(f"{name}_hash"))
    found = found.join(hashes(l_text, "left"), "left").join(hashes(r_text, "right"), "right")
    pairs = found.select("left", "right", "percent", (F.col("left_hash") == F.col("right_hash")).alias("equal"))
    took = one_to_one(pairs, l_text.select("file", "n"), r_text.select("file", "n"))
    each = took.select("left", "right", "l_from", "r_from", "percent", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    each = each.select("left", "right", "percent", (F.col("l_from") + F.col("k")).alias("l_number"), (F.col("r_from") + F.col("k")).alias("r_number"))
    named = each.join(l_own.select(F.col("file").alias("left"), F.col("number").alias("l_number"), F.col("path").alias("previous_path")), ["left", "l_number"])
    named = named.join(r_own.select(F.col("file").alias("right"), F.col("number").alias("r_number"), "path"), ["right", "r_number"])
    return named.select("path", "previous_path", "percent")


def similar_changes(before: DataFrame, after: DataFrame, least: int = LEAST) -> DataFrame:
    """S14. Change rows (status, path, previous_path, percent) of two listings (path, hash, text).

    As changes_between, and of the files that it calls deleted and added those are renames that share `least` of a
    hundred bytes of the larger one. Listings are evaluated twice: for their hashes, and for the texts of these files.
    """
    listed = tuple(kept(f.select("path", "hash")) for f in (before, after))
    plain = kept(changes_between(*listed))
    lost = tuple(kept(n.join(plain.where(F.col("status") == status).select("path"), "path", "left_semi")) for n, status in zip(listed, ("deleted", "added"), strict=True))
    moved = kept(similar_renames(before, after, least, lost))
    gone = moved.select(F.lit("deleted").alias("status"), F.col("previous_path").alias("path")).union(moved.select(F.lit("added"), "path"))
    same = F.when(F.col("status").isin("renamed", "copied"), 100).alias("percent")
    rest = plain.join(gone, ["status", "path"], "left_anti").select("status", "path", "previous_path", same)
    return rest.union(moved.select(F.lit("renamed").alias("status"), "path", "previous_path", "percent"))


def _name(path: str, commit: str):
    """A path since a commit; a path of before the history has none."""
    return F.concat_ws("\n", F.coalesce(F.col(commit).cast("string"), F.lit("")), F.col(path))


def ambiguous(history: DataFrame) -> DataFrame:
    """(commit, path, reason): paths that one commit's renames leave or reach twice; copies do not count."""
    renames = history.where("status = 'renamed'")
    left = renames.groupBy("commit", F.col("previous_path").alias("path")).agg(F.countDistinct("path").alias("n")).where("n > 1")
    reached = renames.groupBy("commit", "path").agg(F.countDistinct("previous_path").alias("n")).where("n > 1")
    return left.select("commit", "path", F.lit("left twice").alias("reason")).union(reached.select("commit", "path", F.lit("reached twice").alias("reason")))


def followed(history: DataFrame) -> DataFrame:
    """(first_path, born, last_path, died, steps) of every file that a history (commit, status, path, previous_path) adds, renames or deletes.

    born and died are commits, null where the file was there before or is there after. A path that several files
    have one after the other is told apart: what leaves a path is what came to it last, in an earlier commit, so
    two files may also swap theirs in one commit. Each arrival points to the next one of its file, and these
    pointers are doubled: rounds grow with the logarithm of the longest chain of renames. Histories that are
    ambiguous() have no one answer.
    """
    history = kept(history.select("commit", "status", "path", "previous_path"))  # it is read many times
    arrive = history.where("status in ('added', 'copied', 'renamed')").select("path", (F.col("commit") * 2 + 1).alias("at"), F.col("commit").alias("since"))
    left = history.where("status = 'renamed'").select(F.col("previous_path").alias("path"), (F.col("commit") * 2).alias("at"), "commit", F.col("path").alias("to"))
    left = left.union(history.where("status = 'deleted'").select("path", (F.col("commit") * 2).alias("at"), "commit", F.lit(None).cast("string").alias("to")))
    told = asof_latest(left, arrive, "path", ["at"], "since", F.floor(F.col("at") / (2 * SPAN)))
    # A file that arrived before its path was last left is another one: it is there no more.
    last = asof_latest(left.select("path", (F.col("at") - 1).alias("at"), F.col("commit").alias("c")), left.select("path", "at", F.col("commit").alias("left_at")), "path", ["at"], "left_at", F.floor(F.col("at") / (2 * SPAN)))
    told = told.join(last.select("path", F.col("c").alias("commit"), "left_at"), ["path", "commit"], "left")
    told = kept(told.select("path", "commit", "to", F.when(F.col("left_at").isNull() | (F.col("since") >= F.col("left_at")), F.col("since")).alias("since")))
    moves = told.where("to is not null").select(_name("path", "since").alias("src"), _name("to", "commit").alias("dst"))
    ends = chain_ends(moves).select("start", "end", "steps")
    died = told.where("to is null").select(_name("path", "since").alias("end"), F.col("commit").alias("died"))
    starts = arrive.join(history.where("status = 'renamed'").select("path", F.col("commit").alias("since")), ["path", "since"], "left_anti").select("path", "since")
    starts = starts.union(told.where("since is null").select("path", "since")).distinct().withColumn("start", _name("path", "since"))
    out = starts.join(ends, "start", "left").withColumn("end", F.coalesce("end", "start")).join(died, "end", "left")
    return out.select(F.col("path").alias("first_path"), F.col("since").alias("born"), F.regexp_extract("end", r"(?s)^[^\n]*\n(.*)$", 1).alias("last_path"), "died", F.coalesce("steps", F.lit(0).cast("long")).alias("steps"))
