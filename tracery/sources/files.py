"""Files of a repository as rows: which paths belong, their text, hash, language, and assets within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..functions.text import glob_regex
from ..operators.ordered import running_sum

# Folders that are never read, limits of assets.
PRUNED = [".git", "node_modules", "target"]
ASSET_BYTES, ASSETS_BYTES = 8 << 20, 64 << 20
# First bytes of media files, in hexadecimal.
MAGIC = {"application/pdf": "25504446", "image/gif": "47494638", "image/jpeg": "FFD8FF", "image/png": "89504E47", "image/webp": "52494646"}


def planned_roots(roots: list[str]) -> list[str]:
    """Roots without those that lie in another one."""
    kept: list[str] = []
    for root in sorted({r.strip("/") for r in roots}):
        if not any(not k or root == k or root.startswith(k + "/") for k in kept):
            kept.append(root)
    return kept


def pruned(path: Column, excludes: list[str] = ()) -> Column:
    """Whether a path lies in a folder that is never read, or in an excluded one."""
    out = F.exists(F.split(path, "/"), lambda p: p.isin(PRUNED))
    for glob in excludes:
        out = out | path.rlike(glob_regex(glob))
    return out


def listing(spark: SparkSession, folder: str, roots: list[str] = ("",), excludes: list[str] = (), pattern: str | None = None) -> DataFrame:
    """(path, length, modified, content) of files under roots of a folder; columns that are not used are not read."""
    places = [f"{folder.rstrip('/')}/{r}".rstrip("/") for r in planned_roots(list(roots))]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = folder.split("://", 1)[-1].rstrip("/")
    base = base[5:] if base.startswith("file:") else base
    rows = reader.load(places)
    relative = F.expr(f"substring(path, locate('{base}/', path) + {len(base) + 1})")
    return rows.select(relative.alias("path"), "length", F.col("modificationTime").alias("modified"), "content").where(~pruned(F.col("path"), list(excludes)))


class ScanError(ValueError):
    """Files that cannot be read, all of them at once."""


def scan_errors(files: DataFrame) -> DataFrame:
    """S5. (path, reason), distinct: files (path, content) that should be text and are no UTF-8, and paths that are not safe."""
    bad = F.when(ids.safe_path(F.col("path")).isNull(), "path is not safe").when(text.is_text(F.col("content")) & ~F.is_valid_utf8(F.col("content").cast("string")), "content is not UTF-8")
    return files.select("path", bad.alias("reason")).where("reason is not null").distinct()


def checked(files: DataFrame, shown: int = 1000) -> DataFrame:
    """S5. files, or a ScanError that lists all errors in order (the first `shown` of very many)."""
    errors = [f"{r.path}: {r.reason}" for r in scan_errors(files).orderBy("path", "reason").limit(shown).collect()]
    if errors:
        raise ScanError("\n".join(errors))
    return files


def routed(paths: DataFrame) -> DataFrame:
    """S3. paths (path) of a documentation folder with what: note or asset by extension; others, and pruned folders, are left out."""
    ext = F.regexp_extract(F.col("path"), r"[^/]\.([^./]*)$", 1)
    what = F.when(ext == "md", "note").when(text.media_type(F.lower(ext)).isNotNull(), "asset")
    return paths.where(~pruned(F.col("path"))).withColumn("what", what).where("what is not null")


def sources(files: DataFrame) -> DataFrame:
    """(path, language, hash, text) of text files; others are left out. Reading, telling and hashing are one pass."""
    known = files.where(text.is_text(F.col("content")))
    return known.select("path", text.language(ids.extension(F.col("path"))).alias("language"), F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("text"))


def document_hash(content: Column) -> Column:
    """Hash of a document without its last line end."""
    return F.sha2(F.regexp_replace(content, r"\r?\n\z", ""), 256)


def assets(files: DataFrame, budget: int = ASSETS_BYTES) -> DataFrame:
    """(path, mime, bytes, hash) of media files in order of their paths, until the budget would be passed.

    A file counts if its first bytes are those of its extension's type and it is not too large.
    """
    mime = text.media_type(ids.extension(F.col("path")))
    head = F.hex(F.substring("content", 1, 8))
    real = F.coalesce(*[F.when(mime == m, head.startswith(x)) for m, x in MAGIC.items()], F.lit(True))
    ok = files.select("path", mime.alias("mime"), F.col("length").alias("bytes"), real.alias("real"), F.sha2("content", 256).alias("hash"))
    ok = ok.where(F.col("mime").isNotNull() & F.col("real") & (F.col("bytes") <= ASSET_BYTES)).drop("real")
    # The first bytes of a path give ranges that follow its order.
    key = F.conv(F.rpad(F.hex(F.substring(F.encode("path", "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return running_sum(ok, key, [F.col("path")], F.col("bytes"), "_used").where(F.col("_used") <= budget).drop("_used")


def changed_files(known: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose (path, hash) is not known yet: what has to be parsed again."""
    return files.join(known.select("path", "hash"), ["path", "hash"], "left_anti")
