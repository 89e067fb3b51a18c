"""Scan of a repository as a Python data source: subtrees are partitions, pruned folders are never opened, links are refused."""

from __future__ import annotations

import json
import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from ..functions.text import glob_regex
from .files import PRUNED, ScanError, planned_roots

SCHEMA = "path string, length long, modified timestamp, content binary, error string"
PUSHES = "spark.sql.python.filterPushdown.enabled"
#: Subtrees that a scan is dealt over, where it has as many; files of one folder are read by one task.
PARTS = 256


@dataclass
class Subtree(InputPartition):
    """Folders that a task walks, and single files or errors beside them, by paths relative to the scanned folder."""

    folders: tuple[str, ...]
    files: tuple[str, ...] = ()
    errors: tuple[tuple[str, str], ...] = ()


class ScanReader(DataSourceReader):
    """Lists what lies under roots of a folder that driver and executors share; see scan()."""

    def __init__(self, options: dict[str, str]):
        self.base = re.sub(r"^file:(//)?(?=/)", "", options["path"]).rstrip("/") or "/"
        self.roots = json.loads(options.get("roots", '[""]'))
        self.pruned = set(json.loads(options.get("pruned", json.dumps(PRUNED))))
        excludes = json.loads(options.get("excludes", "[]"))
        # An exclude of all that a folder holds cuts the folder; others only leave files out.
        self.cut = [re.compile(glob_regex(x.removesuffix("/**"))) for x in excludes if x.endswith("/**")]
        self.left_out = [re.compile(glob_regex(x)) for x in excludes]
        self.contents = options.get("contents", "true") == "true"
        self.starts: list[str] = []
        self.wanted: set[str] | None = None

    def opens(self, folder: str) -> bool:
        """Whether a folder, by its relative path, is looked into."""
        if folder and (folder.rsplit("/", 1)[-1] in self.pruned or any(x.search(folder) for x in self.cut)):
            return False
        inside = f"{folder}/" if folder else ""
        if any(not (inside.startswith(s) or s.startswith(inside)) for s in self.starts):
            return False
        return self.wanted is None or any(w.startswith(inside) for w in self.wanted)

    def takes(self, file: str) -> bool:
        return all(file.startswith(s) for s in self.starts) and (self.wanted is None or file in self.wanted) and not any(x.search(file) for x in self.left_out)

    def listed(self, folder: str) -> tuple[list[str], list[str], list[tuple[str, str]]]:
        """(folders, files, errors) that a folder holds, each in order of the names."""
        folders, files, errors = [], [], []
        try:
            with os.scandir(os.path.join(self.base, folder)) as entries:
                for e in sorted(entries, key=lambda e: e.name):
                    path = f"{folder}/{e.name}" if folder else e.name
                    try:
                        path.encode()
                    except UnicodeEncodeError:
                        errors.append((os.fsencode(path).decode("utf-8", "replace"), "path is not UTF-8"))
                        continue
                    if e.is_symlink():
                        if self.opens(path) or self.takes(path):
                            errors.append((path, "links are refused"))
                    elif e.is_dir():
                        folders += [path] if self.opens(path) else []
                    elif e.is_file():
                        files += [path] if self.takes(path) else []
        except OSError as error:
            errors.append((folder, error.strerror or str(error)))
        return folders, files, errors

    def partitions(self) -> list[Subtree]:
        """Subtrees, opened level by level on the driver until there are enough of them to deal out, and no further."""
        here: list[str] = []
        files: list[str] = []
        errors: list[tuple[str, str]] = []
        for root in planned_roots(self.roots):
            full = os.path.join(self.base, root)
            parts = [p for p in root.split("/") if p]
            linked = next((p for p in ("/".join(parts[: k + 1]) for k in range(len(parts))) if os.path.islink(os.path.join(self.base, p))), None)
            if linked:
                errors.append((linked, "links are refused"))
            elif os.path.isfile(full):
                files += [root] if self.takes(root) else []
            elif all(self.opens("/".join(parts[: k + 1])) for k in range(len(parts))):
                here.append(root)
        while here and len(here) < PARTS:
            found = [self.listed(x) for x in here]
            files += [x for _, own, _ in found for x in own]
            errors += [x for _, _, own in found for x in own]
            here = [x for own, _, _ in found for x in own]
        parts = [Subtree(tuple(here[k::PARTS])) for k in range(min(PARTS, len(here)))]
        parts += [Subtree((), tuple(files[k::PARTS]), tuple(errors[k::PARTS])) for k in range(min(PARTS, max(len(files), len(errors))))]
        return parts or [Subtree(())]  # a reader without partitions is asked for one all the same

    def row(self, path: str) -> tuple:
        full = os.path.join(self.base, path)
        try:
            fd = os.open(full, os.O_RDONLY | os.O_NOFOLLOW)  # a file that became a link since is refused too
            with os.fdopen(fd, "rb") as f:
                known = os.fstat(fd)
                if not stat.S_ISREG(known.st_mode):
                    return path, None, None, None, "no regular file"
                when = datetime.fromtimestamp(known.st_mtime, timezone.utc)
                return path, known.st_size, when, f.read() if self.contents else None, None
        except OSError as error:
            return path, None, None, None, error.strerror or str(error)

    def read(self, partition: Subtree) -> Iterator[tuple]:
        yield from (self.row(x) for x in partition.files)
        yield from ((path, None, None, None, why) for path, why in partition.errors)
        todo = list(reversed(partition.folders))
        while todo:
            folders, files, errors = self.listed(todo.pop())
            todo += reversed(folders)
            yield from (self.row(x) for x in files)
            yield from ((path, None, None, None, why) for path, why in errors)


class PushedScanReader(ScanReader):
    """The same with filters on path, which Spark takes of a reader only where its session allows that."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Paths that are named, or begin with a text, are sought where they can be; everything is filtered again after."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.starts.append(f.value)
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = own if self.wanted is None else self.wanted & own
            yield f


class ScanSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tracery_scan"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ScanReader:
        return (PushedScanReader if self.options.get("push") == "true" else ScanReader)(dict(self.options))


def scan(spark: SparkSession, folder: str, roots: list[str] = ("",), excludes: list[str] = (), contents: bool = True) -> DataFrame:
    """S1, S2, S4. (path, length, modified, content, error) of what lies under roots of a folder.

    Folders that are never read, and those of which an exclude takes all, are not opened. With filters on path that
    are pushed down (where spark.sql.python.filterPushdown.enabled is true), neither are folders in which no wanted path can lie.
    Links, paths that are no UTF-8 and what cannot be read are rows with an error. The folder is one that driver
    and executors see under the same path; object stores have no links and are listed by files.listing.
    """
    spark.dataSource.register(ScanSource)
    reader = spark.read.format("tracery_scan").option("roots", json.dumps(list(roots))).option("excludes", json.dumps(list(excludes))).option("contents", str(contents).lower())
    return reader.option("push", spark.conf.get(PUSHES, "false")).load(folder)


def without_errors(found: DataFrame, shown: int = 1000) -> DataFrame:
    """S5. A scan's rows without the error, or a ScanError that lists all errors in order, each once (the first `shown` of very many)."""
    errors = [f"{r.path}: {r.error}" for r in found.where("error is not null").select("path", "error").distinct().orderBy("path", "error").limit(shown).collect()]
    if errors:
        raise ScanError("\n".join(errors))
    return found.drop("error")


def selected(spark: SparkSession, folder: str, paths: list[str]) -> DataFrame:
    """S6. The rows of named files alone, a path as long as it is wanted; what is missing is an error."""
    wanted = sorted({p.strip("/") for p in paths})
    found = scan(spark, folder, wanted)
    asked = spark.createDataFrame([(p,) for p in wanted], "path string")
    rows = found.join(asked, "path", "left_semi")
    missing = asked.join(found.select("path"), "path", "left_anti").selectExpr("path", "cast(null as long) length", "cast(null as timestamp) modified", "cast(null as binary) content", "'no such file' error")
    return rows.select(missing.columns).union(missing)
