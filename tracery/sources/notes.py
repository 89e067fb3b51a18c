"""Markdown notes as rows: frontmatter, headings and links with their lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.spread import sliced, spread

PARSED = """path string, id string, kind string, title string, status string, body string, governs array<string>, supersedes array<string>,
 superseded_by array<string>, targets_symbols array<string>, targets_scope array<string>, target_patterns array<string>,
 policies array<struct<id:string,language:string,pattern:string,rule:string,message:string>>,
 headings array<struct<level:int,text:string,line:bigint>>, links array<struct<link:string,line:bigint>>, frontmatter_error string"""
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
LINK = re.compile(r"\[\[([^\[\]\n]+)\]\]")
# Fixed value: frontmatter without that on which libyaml and PyYAML differ: tabs, control and other characters, a # at the mark of a block.
PLAIN = re.compile(r"(?s)(?!.*[|>][-+0-9]*#)[\n\r\x20-\x7e]*")
SPAN = re.compile(r"(`+)(?:(?!\1).)+?\1(?!`)")


def split_frontmatter(text: str) -> tuple[str | None, str, int]:
    """(frontmatter, body, lines before the body); delimiters are whole lines, and the closing one ends in a line end."""
    if not re.match(r"---\r?\n", text):
        return None, text, 0
    end = re.search(r"(?m)^---\r?\n", text[text.index("\n") + 1 :])
    if not end:
        return None, text, 0
    first = text.index("\n") + 1
    return text[first : first + end.start()], text[first + end.end() :], text[: first + end.end()].count("\n")


def scan(body: str, before: int = 0) -> tuple[list[dict], list[dict]]:
    """(headings, links) of a body; code blocks and code spans hold neither."""
    headings, links, fence, last = [], [], None, ""
    for k, line in enumerate(body.splitlines(), before + 1):
        mark = FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = None
            last = ""
            continue
        if mark:
            fence, last = mark[1], ""
            continue
        if line.startswith(("    ", "\t")) and not last:
            continue
        if m := HEADING.match(line):
            headings.append({"level": len(m[1]), "text": (m[2] or "").strip(), "line": k})
            last = ""
        elif last and re.fullmatch(r" {0,3}(=+|-+)[ \t]*", line):
            headings.append({"level": 1 if "=" in line else 2, "text": last.strip(), "line": k - 1})
            last = ""
        else:
            last = line if line.strip() else ""
        code = [m.span() for m in SPAN.finditer(line)]
        links += [{"link": m[1], "line": k} for m in LINK.finditer(line) if not any(a < m.end() and m.start() < b for a, b in code)]
    return headings, links


def link_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, body) of a text's links; code blocks and code spans hold none."""
    found, at = [], 0
    lines = text.splitlines(keepends=True)
    linked = {}
    for link in scan(text)[1]:
        linked.setdefault(link["line"], []).append(link["link"])
    for k, line in enumerate(lines, 1):
        code = [m.span() for m in SPAN.finditer(line)]
        if k in linked:
            found += [(at + m.start(), at + m.end(), m[1]) for m in LINK.finditer(line) if not any(a < m.end() and m.start() < b for a, b in code)]
        at += len(line)
    return found


def path_decision(path: str) -> str | None:
    """The decision id that a decision's file name gives."""
    name = re.sub(r"\.md$", "", path.rsplit("/", 1)[-1])
    if m := re.fullmatch(r"(?:ADR-)?(\d{8})-([a-z0-9]+(?:-[a-z0-9]+)*)", name):
        return f"ADR-{m[1]}-{m[2]}"
    m = re.fullmatch(r"(?:ADR-)?(\d{4})(?:-.*)?", name)
    return f"ADR-{m[1]}" if m else None


def portable(text: str | None) -> str | None:
    """X23. A text whose links to decisions by file with the id as alias are written as that id alone."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, body in link_spans(text):
        target, bar, alias = body.partition("|")
        base, _, fragment = target.strip().partition("#")
        alias = alias.strip()
        own, _, own_fragment = alias.partition("#")
        if bar and own and path_decision(base.strip()) == own and fragment.strip() == own_fragment.strip():
            out += [text[at:a], f"[[{alias}]]"]
            at = b
    return "".join([*out, text[at:]])


def governs_rewritten(text: str | None, new: dict[str, str] | None) -> str | None:
    """X24. A note whose governs values are replaced by a map, each in its own quotes; null where its frontmatter cannot be rewritten."""
    head, _, _ = split_frontmatter(text or "")
    if head is None:
        return None
    first = (text or "").index("\n") + 1
    out, inside, seen = [], False, False
    for line in head.splitlines(keepends=True):
        if line.strip() and not line[0].isspace() and not line.startswith("#"):
            inside = line.rstrip("\r\n") == "governs:"
            if line.startswith("governs:") and (not inside or seen):
                return None
            seen |= inside
        elif inside and line.strip() and not line.lstrip().startswith("#"):
            m = re.match(r"(\s*- )('(?:[^']|'')*'|\"(?:\\.|[^\"\\])*\"|[^\s'\"\[{&*!|>@`][^\r\n]*?)([ \t]*\r?\n)\Z", line)
            if not m or m[2][0] not in "'\"" and " #" in m[2]:
                return None
            quote = m[2][0] if m[2][0] in "'\"" else ""
            value = m[2][1:-1].replace("''", "'") if quote == "'" else re.sub(r"\\(.)", r"\1", m[2][1:-1]) if quote else m[2]
            if value in (new or {}):
                to = new[value]
                to = to.replace("'", "''") if quote == "'" else to.replace("\\", "\\\\").replace('"', '\\"') if quote else to
                line = f"{m[1]}{quote}{to}{quote}{m[3]}"
        out.append(line)
    return (text or "")[:first] + "".join(out) + (text or "")[first + len(head) :]


def _strings(x: object) -> list[str]:
    return [str(v) for v in x] if isinstance(x, list) else []


def _loaded(head: str) -> object:
    """The YAML of a frontmatter; libyaml reads plain ones, all that it refuses or reads in another way is left to PyYAML's own reader."""
    import yaml

    if not PLAIN.fullmatch(head):
        return yaml.safe_load(head)
    try:
        return yaml.load(head, getattr(yaml, "CSafeLoader", yaml.SafeLoader))  # noqa: S506 (a safe loader)
    except yaml.YAMLError:
        return yaml.safe_load(head)


def parse(path: str, text: str | None) -> dict:
    """A note's row; frontmatter that cannot be read is an error, and the whole file is then the body."""
    import yaml

    head, body, before = split_frontmatter(text or "")
    meta, error = {}, None
    if head is not None:
        try:
            meta = _loaded(head) or {}
            if not isinstance(meta, dict):
                raise ValueError("frontmatter is no mapping")
        except (yaml.YAMLError, ValueError) as e:
            meta, error, body, before = {}, str(e).splitlines()[0], text or "", 0
    headings, links = scan(body, before)
    one = lambda k: None if meta.get(k) is None else str(meta[k])
    targets = meta.get("targets") if isinstance(meta.get("targets"), dict) else {}
    policy = meta.get("policy") if isinstance(meta.get("policy"), dict) else {}
    declared = [p for p in policy.get("patterns") or [] if isinstance(p, dict)]
    row = {k: one(k) for k in ("id", "kind", "title", "status")} | {k: _strings(meta.get(k)) for k in ("governs", "supersedes", "superseded_by")}
    return row | {
        "path": path, "body": body, "targets_symbols": _strings(targets.get("symbols")), "targets_scope": _strings(targets.get("scope")),
        "target_patterns": [str(p["ref"]) for p in targets.get("patterns") or [] if isinstance(p, dict) and p.get("ref") is not None],
        "policies": [{k: None if p.get(k) is None else str(p[k]) for k in ("id", "language", "pattern", "rule", "message")} for p in declared],
        "headings": headings, "links": links, "frontmatter_error": error,
    }


def _notes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings, one = pa.list_(pa.string()), pa.string()
    kinds = {
        "path": one, "id": one, "kind": one, "title": one, "status": one, "body": one, "governs": strings, "supersedes": strings, "superseded_by": strings,
        "targets_symbols": strings, "targets_scope": strings, "target_patterns": strings,
        "policies": pa.list_(pa.struct([(k, one) for k in ("id", "language", "pattern", "rule", "message")])),
        "headings": pa.list_(pa.struct([("level", pa.int32()), ("text", one), ("line", pa.int64())])), "links": pa.list_(pa.struct([("link", one), ("line", pa.int64())])), "frontmatter_error": one,
    }
    schema = pa.schema(list(kinds.items()))
    for batch in sliced(batches):
        rows = [parse(p, t) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pylist(rows, schema)


def notes(texts: DataFrame) -> DataFrame:
    """Notes of texts (path, text)."""
    return spread(texts.select("path", "text"), "path").mapInArrow(_notes, PARSED)
