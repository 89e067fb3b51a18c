"""Elixir relationships resolved: aliases where they stand, then modules, the file's own callables, and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scopes
from .recursion import kept


def callables(parsed: DataFrame) -> DataFrame:
    """(id, path, module, kind, name, arity, exported, clauses, first_line, last_line): clauses of one name and arity are one callable.

    Default arguments give several arities.
    """
    each = parsed.select("path", F.explode("callables").alias("c")).select("path", "c.*").withColumn("arity", F.explode(F.sequence("least", "most")))
    one = each.groupBy("path", "module", "kind", "name", "arity").agg(F.bool_or("exported").alias("exported"), F.count("*").alias("clauses"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))
    return one.withColumn("id", F.concat("module", F.lit("."), "name", F.lit("/"), F.col("arity").cast("string")))


def directives(parsed: DataFrame) -> DataFrame:
    """Directives by file, named as the operators of scopes take them."""
    d = parsed.select("path", F.explode("directives").alias("d")).select("path", "d.*")
    return d.withColumnRenamed("line", "d_line").withColumnRenamed("site", "d_site")


def relations(parsed: DataFrame) -> DataFrame:
    """(path, line, site, kind, owner, caller, caller_arity, text, target, outcome) of every relationship of parsed files.

    target is the one callable or module that a relationship leads to; outcome is resolved, external (nothing
    or several answer) or dynamic (only known when the code runs). A private callable answers in its module alone.
    """
    parsed = kept(parsed)  # files are read once for all that is asked of them
    rows = parsed.select("path", F.explode("relations").alias("r")).select("path", "r.*").withColumn("id", F.concat_ws(":", "path", F.col("site").cast("string"), "kind"))
    told = directives(parsed)
    aliased = told.where("alias is not null").withColumn("target", F.col("module"))
    written = scopes.expand_aliases(rows.where("module is not null").select("id", "path", "owner", "line", "site", "module"), aliased).withColumnRenamed("module", "_module")
    rows = kept(rows.join(written, "id", "left").withColumn("module", F.coalesce("_module", "module")).drop("_module"))
    known = callables(parsed)
    remote = scopes.remote_callables(known.where("exported and kind in ('function', 'macro', 'guard')").select("module", "name", "arity", "id")).withColumnRenamed("target", "_remote")
    modules = parsed.select(F.explode("modules").alias("m")).select(F.col("m.name").alias("module")).groupBy("module").agg(F.count("*").alias("_n")).where("_n = 1").select("module", F.col("module").alias("_whole"))
    own = known.where("kind in ('function', 'macro', 'guard')").groupBy("path", F.col("module").alias("owner"), "name", "arity").agg(F.min("id").alias("_own"))
    imports = told.where("kind = 'import'").select("path", "owner", "d_line", "d_site", "scope_start", "scope_end", "module", "only_kind", "only", "except")
    plain = rows.where("module is null and name is not null and kind <> 'dynamic'")
    seen = scopes.visible_imports(plain.select("id", "path", "owner", "line", "site", "name", "arity"), imports, known.where("exported").select("id", "module", "kind", "name", "arity")).withColumnRenamed("target", "_import")
    rows = rows.join(remote, ["module", "name", "arity"], "left").join(modules, "module", "left").join(own, ["path", "owner", "name", "arity"], "left").join(seen, "id", "left")
    local = F.when(F.col("module").isNull() & (F.col("kind") != "dynamic"), F.coalesce("_own", "_import"))
    target = F.coalesce(F.col("_remote"), local, F.when(F.col("name").isNull(), F.col("_whole")))
    text = F.concat_ws("/", F.concat_ws(".", "module", "name"), F.col("arity").cast("string"))
    outcome = F.when(F.col("kind") == "dynamic", "dynamic").when(target.isNotNull(), "resolved").otherwise("external")
    return rows.select("path", "line", "site", "kind", "owner", "caller", "caller_arity", text.alias("text"), target.alias("target"), outcome.alias("outcome"))
