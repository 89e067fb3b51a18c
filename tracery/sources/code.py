"""Source files as rows of symbols, imports and calls, by their lines.

Declarations are told by patterns of a line and their extents by indentation or braces, which is approximate
where code is written unusually. Joins of these rows resolve the calls.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.text import NO_CALLS

# Lines that declare something, by language: kind and pattern, whose group is the name.
DECLARED = {
    "python": [("class", r"\s*class\s+(\w+)"), ("function", r"\s*(?:async\s+)?def\s+(\w+)")],
    "rust": [("struct", r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+(\w+)"), ("impl", r"\s*(?:unsafe\s+)?impl\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)"), ("function", r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(\w+)")],
    "go": [("struct", r"type\s+(\w+)\s"), ("function", r"func\s+(?:\([^)]*\)\s*)?(\w+)")],
    "javascript": [("class", r"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("function", r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>")],
    "elixir": [("module", r"\s*def(?:module|protocol|impl)\s+([\w.]+)"), ("macro", r"\s*defmacrop?\s+(\w+[?!]?)"), ("function", r"\s*defp?\s+(\w+[?!]?)")],
}
DECLARED["typescript"] = DECLARED["javascript"]
IMPORTED = {
    "python": r"\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", "rust": r"\s*(?:pub\s+)?use\s+([^;]+);", "go": r"\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$",
    "javascript": r".*?(?:\bfrom\s*|\brequire\(\s*|^\s*import\s+)[\"']([^\"']+)[\"']", "elixir": r"\s*(?:alias|import|require|use)\s+([\w.{}, ]+)",
}
IMPORTED["typescript"] = IMPORTED["javascript"]
CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_]\w*(?:::|\.))*[A-Za-z_]\w*[?!]?)\s*\(")
PARSED = """path string, language string, symbols array<struct<name:string,kind:string,parent:string,exported:boolean,start_line:bigint,end_line:bigint>>,
 imports array<struct<module:string,line:bigint>>, calls array<struct<caller:string,text:string,line:bigint>>"""


def _exported(language: str, line: str, name: str) -> bool:
    if language == "go":
        return name[:1].isupper()
    if language == "python":
        return not name.startswith("_")
    if language == "elixir":
        return not re.match(r"\s*def(?:macro)?p\b", line)
    return bool(re.match(r"\s*(?:pub\b|export\b)", line))


def parse(path: str, language: str, text: str | None) -> dict:
    """A file's row. A symbol ends before the next line that is indented no deeper than its own."""
    lines = (text or "").splitlines()
    open_: list[tuple[int, dict]] = []
    symbols, imports, calls = [], [], []
    for k, line in enumerate(lines, 1):
        if not line.strip() or language not in DECLARED:
            continue
        depth = len(line) - len(line.lstrip())
        closing = line.strip()[0] in "})]" or line.strip() == "end"
        while open_ and depth <= open_[-1][0] and not (closing and depth == open_[-1][0]):
            open_.pop()
        for _, s in open_:
            s["end_line"] = k
        if m := re.match(IMPORTED[language], line):
            imports.append({"module": next(g for g in m.groups() if g).strip(), "line": k})
            continue
        for kind, pattern in DECLARED[language]:
            if m := re.match(pattern, line):
                holder = next((s for _, s in reversed(open_) if s["kind"] in ("class", "struct", "impl", "module")), None)
                own = {"name": m[1], "kind": "method" if kind == "function" and holder and holder["kind"] != "module" else kind, "parent": holder and holder["name"], "exported": _exported(language, line, m[1]), "start_line": k, "end_line": k}
                open_.append((depth, own))
                if kind != "impl":
                    symbols.append(own)
                line = line[m.end() :].replace("(", " ", 1)
                break
        code = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*|#.*", "", line)
        for m in CALL.finditer(code):
            name = re.split(r"::|\.", m[1])[-1]
            if name not in NO_CALLS and not (language == "rust" and name.endswith("!")):  # a macro is no call
                calls += [{"caller": s["name"], "text": name, "line": k} for _, s in open_ if s["kind"] != "impl"]
    return {"path": path, "language": language, "symbols": symbols, "imports": imports, "calls": [dict(x) for x in sorted({tuple(c.items()) for c in calls}, key=lambda c: (c[2][1], c[1][1], c[0][1]))]}


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one, line = pa.string(), pa.int64()
    schema = pa.schema([
        ("path", one), ("language", one),
        ("symbols", pa.list_(pa.struct([("name", one), ("kind", one), ("parent", one), ("exported", pa.bool_()), ("start_line", line), ("end_line", line)]))),
        ("imports", pa.list_(pa.struct([("module", one), ("line", line)]))), ("calls", pa.list_(pa.struct([("caller", one), ("text", one), ("line", line)]))),
    ])
    for batch in batches:
        yield pa.RecordBatch.from_pylist([parse(*r) for r in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)], schema)


def parsed(sources: DataFrame) -> DataFrame:
    """Rows of sources (path, language, text); a file of an unknown language has no symbols."""
    return sources.select("path", "language", "text").mapInArrow(_files, PARSED)
