"""A stored hash tree: a change hashes only its branches anew, and two trees are compared from the root down."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spread import parts_for
from .hashing import root_hash
from .recursion import cut, kept

# Leading digits of a hash that name its branch on each level.
LOW, MID = 6, 3
#: Leading digits of the leaves that stand in one folder.
FOLDER = 2


@dataclass
class Tree:
    """branches (part, p, leaves, h): the sorted leaves under leading digits p, and their hash; mid (p, h): the level above. They are those of hashing.root_hash.

    Hashes are lower-case hexadecimal digits; branches hold them as bytes, half as many.
    """

    branches: DataFrame
    mid: DataFrame

    @property
    def leaves(self) -> DataFrame:
        """(part, p, h), h in digits."""
        return _leaves(self.branches, "leaves")

    @property
    def low(self) -> DataFrame:
        """(p, h), h as bytes."""
        return self.branches.select("p", "h")

    def root(self) -> DataFrame:
        """One row, root, as root_hash gives it for all leaves."""
        return self.mid.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("root"))  # at most 16^3


def _digits(h) -> Column:
    return F.lower(F.hex(h))


def _leaves(branches: DataFrame, column: str) -> DataFrame:
    return branches.select("part", "p", F.explode(column).alias("h")).withColumn("h", _digits(F.col("h")))


def _hashed(leaves: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(F.transform(leaves, _digits), ""), 256))


def _mid(low: DataFrame) -> DataFrame:
    own = low.groupBy(F.substring("p", 1, MID).alias("p"))
    return own.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: _digits(x["h"])), ""), 256).alias("h"))


def _dealt(rows: DataFrame, parts: int | None) -> DataFrame:
    """rows dealt by folder (part) over so many tasks, so that all of a folder's branches are made, and written to one file, by one task."""
    return rows.repartition(min(16**FOLDER, parts or parts_for(rows.sparkSession, 0)), "part")


def _leaf(hashes: DataFrame, column: str) -> DataFrame:
    """(part, leaf): hashes as bytes."""
    return hashes.select(F.substring(column, 1, FOLDER).alias("part"), F.to_binary(column, F.lit("hex")).alias("leaf"))


def _prefix(leaf: Column) -> Column:
    return F.substring(_digits(F.substring(leaf, 1, (LOW + 1) // 2)), 1, LOW)


def build(hashes: DataFrame, column: str = "hash", parts: int | None = None) -> Tree:
    own = _dealt(_leaf(hashes, column), parts).groupBy("part", _prefix(F.col("leaf")).alias("p")).agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))
    branches = own.withColumn("h", _hashed(F.col("leaves")))
    return Tree(branches, _mid(branches.select("p", "h")))


def store(tree: Tree, folder: str) -> None:
    """Write a tree; branches stand in folders by their first digits, so one is read without most of the others. The level above is made of what was written."""
    tree.branches.write.partitionBy("part").parquet(f"{folder}/branches")
    _mid(_branches(tree.branches.sparkSession, folder).select("p", "h")).coalesce(1).write.parquet(f"{folder}/mid")


def _branches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("p string, leaves array<binary>, h binary, part string").parquet(f"{folder}/branches").select("part", "p", "leaves", "h")


def load(spark: SparkSession, folder: str) -> Tree:
    return Tree(_branches(spark, folder), spark.read.schema("p string, h string").parquet(f"{folder}/mid"))


def _folders(rows: DataFrame) -> list[str]:
    return [r.part for r in rows.select("part").distinct().collect()]  # at most 16^2


def _branch(tree: Tree, low: DataFrame) -> DataFrame:
    """The leaves of some branches (p) of the low level; only folders that hold them are read."""
    own = tree.branches.where(F.col("part").isin(_folders(low.select(F.substring("p", 1, FOLDER).alias("part")))))
    return _leaves(own.join(low.select("p").distinct(), "p", "left_semi"), "leaves")


def updated(tree: Tree, added: DataFrame, removed: DataFrame, column: str = "hash", parts: int | None = None) -> tuple[Tree, DataFrame]:
    """(the tree after some hashes came and others went, the leaves that were read for it).

    A hash that came several times is there as often, and goes as often as it is removed; what is not there cannot go.
    Only folders with a change are read, and only branches with one are hashed; all others are taken as they are.
    What came and went is evaluated twice, first for the folders: keep it in a table if it is costly. parts: tasks that all is dealt over.
    """
    changes = _leaf(added, column).withColumn("came", F.lit(True)).union(_leaf(removed, column).withColumn("came", F.lit(False)))
    folders = F.col("part").isin(_folders(changes))
    old = tree.branches.where(folders).select("part", F.lit(None).cast("binary").alias("leaf"), F.lit(None).cast("boolean").alias("came"), F.struct("p", "leaves", "h").alias("old"))
    rows = _dealt(changes.withColumn("old", F.lit(None).cast(old.schema["old"].dataType)).union(old), parts)
    one = lambda came: F.collect_list(F.when(F.col("came") == came, F.col("leaf")))
    met = rows.groupBy("part", F.coalesce("old.p", _prefix(F.col("leaf"))).alias("p")).agg(F.first("old", ignorenulls=True).alias("old"), one(True).alias("come"), one(False).alias("go"))
    none = F.array().cast("array<binary>")
    changed, there = F.size("come") + F.size("go") > 0, F.coalesce("old.leaves", none)
    both = F.concat(there, F.col("come"))
    count = lambda all_, x: F.size(F.filter(all_, lambda y: y == x))
    left = F.transform(F.array_distinct(both), lambda x: F.array_repeat(x, F.greatest(F.lit(0), count(both, x) - count(F.col("go"), x))))
    leaves = F.when(changed, F.array_sort(F.when(F.size("go") == 0, both).otherwise(F.flatten(left)))).otherwise(there)
    own = met.select("part", "p", leaves.alias("leaves"), F.col("old.h").alias("h"), changed.alias("changed"))
    own = kept(own.withColumn("h", F.when(F.col("changed"), _hashed(F.col("leaves"))).otherwise(F.col("h"))))
    above = own.where("changed").select(F.substring("p", 1, MID).alias("_p")).distinct()
    stays = own.where(F.size("leaves") > 0)
    mine = stays.join(F.broadcast(above), F.substring("p", 1, MID) == F.col("_p"), "left_semi").select("p", "h")  # at most 16^3
    mid = cut(tree.mid.join(F.broadcast(above), F.col("p") == F.col("_p"), "left_anti").union(_mid(mine)))
    read = _leaves(met.where(changed).select("part", "p", there.alias("leaves")), "leaves")
    return Tree(tree.branches.where(~folders).union(stays.select("part", "p", "leaves", "h")), mid), read


def differences(a: Tree, b: Tree) -> tuple[DataFrame, DataFrame]:
    """((change, hash, n): hashes of which b has n more (added) or fewer (removed) than a; the leaves that were read).

    Branches whose hashes are equal are not looked into.
    """

    def differ(x: DataFrame, y: DataFrame) -> DataFrame:
        both = x.join(y.select("p", F.col("h").alias("other")), "p", "full")
        return both.where(~F.col("h").eqNullSafe(F.col("other"))).select("p")

    upper = cut(differ(a.mid, b.mid))
    inside = lambda low: low.join(upper.select(F.col("p").alias("_p")), F.substring("p", 1, MID) == F.col("_p"), "left_semi")
    lower = cut(differ(inside(a.low), inside(b.low)))
    mine, theirs = cut(_branch(a, lower)), cut(_branch(b, lower))
    n = theirs.select("h", F.lit(1).alias("n")).union(mine.select("h", F.lit(-1))).groupBy("h").agg(F.sum("n").alias("n")).where("n <> 0")
    return n.select(F.when(F.col("n") > 0, "added").otherwise("removed").alias("change"), F.col("h").alias("hash"), F.abs("n").alias("n")), mine.union(theirs)


def same_root(tree: Tree) -> bool:
    """Whether the levels fit the leaves: a check of what is stored."""
    return tree.root().first()[0] == root_hash(tree.leaves, "h").first()[0]
