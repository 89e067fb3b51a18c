"""Text functions: scores for suggestions, globs, escaping, positions, languages."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages and media types by extension.
LANGUAGES = {"ex": "elixir", "exs": "elixir", "go": "go", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "py": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript"}
MEDIA = {"gif": "image/gif", "jpeg": "image/jpeg", "jpg": "image/jpeg", "pdf": "application/pdf", "png": "image/png", "svg": "image/svg+xml", "webp": "image/webp"}
# Brackets.
CLOSED_BY = {"(": ")", "[": "]", "{": "}", "<": ">"}
# Words that look like calls but are none.
NO_CALLS = ["Err", "Ok", "Some", "for", "format", "if", "match", "println", "return", "sizeof", "switch", "vec", "while"]


def per_value(f: Callable, returns: str) -> Callable[..., Column]:
    """A function of values over whole columns in Arrow batches, for what columns cannot express."""

    def own(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*x) for x in zip(*columns, strict=True)], dtype=object)

    return F.pandas_udf(own, returns)


def looked_up(x: Column, values: dict[str, str], other: str | None = None) -> Column:
    """The value of a small fixed table."""
    found = F.create_map(*[F.lit(v) for pair in values.items() for v in pair])[x]
    return F.coalesce(found, F.lit(other)) if other is not None else found


def glob_regex(glob: str) -> str:
    """Regular expression of a path glob: * and ? stay within a part, ** crosses parts, a backslash escapes."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out.append("(?:[^/]+/)*")
            k += 3
            continue
        if glob.startswith("**", k):
            out.append(".*")
            k += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := glob.find("]", k + 2)) > 0:
            body = glob[k + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            k = end
        elif c == "{" and (end := glob.find("}", k)) > 0:
            out.append("(?:" + "|".join(glob_regex(x)[1:-1] for x in glob[k + 1 : end].split(",")) + ")")
            k = end
        elif c == "\\" and k + 1 < len(glob):
            k += 1
            out.append(re.escape(glob[k]))
        elif c in "[{":
            raise ValueError(f"invalid glob: {glob}")
        else:
            out.append(re.escape(c))
        k += 1
    return "^" + "".join(out) + "$"


def glob_prefix(glob: str) -> str:
    """Whole parts of a path that stand before a glob's first special character."""
    plain = re.split(r"[*?\[{\\]", glob, maxsplit=1)[0]
    return plain if plain == glob else plain[: plain.rfind("/") + 1]


def denies(module: Column, rule: Column, rule_regex: Column) -> Column:
    """Whether an import rule forbids a module: itself, what it holds, or by glob over its parts."""
    return (module == rule) | module.startswith(F.concat(rule, F.lit("::"))) | F.regexp_like(F.replace(module, F.lit("::"), F.lit("/")), rule_regex)


def source_match_score(query: Column, path: Column) -> Column:
    """How well a path answers a query: whole, file name, tail, beginning of the file name, or anywhere; null for no match.

    Lengths and places are in bytes.
    """
    q, p = F.lower(query), F.lower(path)
    name, size = F.substring_index(p, "/", -1), F.octet_length(path)
    at = F.octet_length(F.substring(p, F.lit(1), F.instr(p, q) - 1))
    return (
        F.when(p == q, F.lit(100_000))
        .when(name == q, F.lit(90_000))
        .when(p.endswith(F.concat(F.lit("/"), q)), F.lit(80_000) - size)
        .when(name.startswith(q), F.lit(70_000) - size)
        .when(F.instr(p, q) > 0, F.lit(60_000) - at - size)
        .cast("long")
    )


def fuzzy_score(query: Column, text: Column) -> Column:
    """Score of the query as a subsequence of the text: three for each letter of the run so far, eight where a part begins.

    Null where the query is no subsequence.
    """
    q, t = F.split(F.lower(query), ""), F.split(F.lower(text), "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("score"), F.lit("/").alias("before"))

    def step(s: Column, c: Column) -> Column:
        hit = (s["at"] < F.size(q)) & (c == F.get(q, s["at"]))
        run = F.when(hit, s["run"] + 1).otherwise(F.lit(0))
        gain = F.when(hit, 3 * run + F.when(s["before"] == "/", F.lit(8)).otherwise(F.lit(0))).otherwise(F.lit(0))
        return F.struct((s["at"] + hit.cast("int")).alias("at"), run.alias("run"), (s["score"] + gain).alias("score"), c.alias("before"))

    end = F.aggregate(t, start, step)
    return F.when(end["at"] == F.size(q), end["score"].cast("long"))


def suggestion_score(query: Column, path: Column) -> Column:
    """source_match_score, or behind all of its matches the fuzzy one."""
    return F.coalesce(source_match_score(query, path), F.lit(40_000) + fuzzy_score(query, path) - F.octet_length(path))


def line_number(text: Column, offset: Column) -> Column:
    """One-based line of a character offset."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return (F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def github_escaped(x: Column, value: bool = False) -> Column:
    """Escapes of workflow commands; a property's value also escapes colons and commas."""
    out = F.replace(F.replace(F.replace(x, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.replace(F.replace(out, F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C")) if value else out


def utf16_length(x: Column) -> Column:
    """Code units of UTF-16 in a text."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("long")


def language(extension: Column) -> Column:
    return looked_up(extension, LANGUAGES, "unknown")


def media_type(extension: Column) -> Column:
    return looked_up(extension, MEDIA)


def is_text(head: Column) -> Column:
    """Whether a file's first kilobyte is text: no null byte, and no mark of a PDF or PNG file."""
    hexed = F.hex(F.substring(head, 1, 1024))
    return ~(hexed.rlike("^(?:..)*?00") | hexed.startswith("25504446") | hexed.startswith("89504E47"))


def position(x: Column, offset: Column) -> Column:
    """X17. Struct (line, utf16, chars) of a byte offset, all from zero: the column in code units of UTF-16 and in characters.

    Null where the offset is beyond the text or within a character. A CR that ends the line with an LF at the
    offset is no part of it.
    """
    raw = F.encode(x, "UTF-8")
    before = F.try_validate_utf8(F.substring(raw, F.lit(1), offset.cast("int")).cast("string"))
    line = F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit("")))
    own = F.substring_index(before, "\n", -1)
    ends = own.endswith("\r") & (F.hex(F.substring(raw, (offset + 1).cast("int"), F.lit(1))) == "0A")
    own = F.when(ends, F.regexp_replace(own, r"\r\z", "")).otherwise(own)
    found = F.struct(line.cast("long").alias("line"), utf16_length(own).alias("utf16"), F.char_length(own).cast("long").alias("chars"))
    return F.when((offset >= 0) & (offset <= F.octet_length(raw)) & before.isNotNull(), found)


def key_line(frontmatter: Column, needle: Column) -> Column:
    """X25. The file's line of the first frontmatter line that holds a text, or of the first one; the opening mark is line 1."""
    at = F.instr(frontmatter, needle)
    return F.when(at > 0, line_number(frontmatter, at - 1) + 1).otherwise(F.lit(2).cast("long"))


def _top_level(x: str | None, separator: str) -> list[str] | None:
    """The stretches of a text between separators outside of brackets; each kind of brackets counts by itself, and one that closes nothing is none."""
    if x is None:
        return None
    depth, out, first = dict.fromkeys(")]}>", 0), [], 0
    for m in re.finditer(rf"[()\[\]{{}}<>]|{re.escape(separator)}", x):
        c = m[0]
        if c in CLOSED_BY:
            depth[CLOSED_BY[c]] += 1
        elif c in depth:
            depth[c] = max(0, depth[c] - 1)
        if c == separator and not any(depth.values()):
            out.append(x[first : m.start()])
            first = m.end()
    return [*out, x[first:]]


def split_top_level(x: Column, separator: str = ",") -> Column:
    """X22. The trimmed parts of a text between separators outside of brackets of the four kinds, without empty ones."""
    parts = per_value(partial(_top_level, separator=separator), "array<string>")(x)
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def signature(x: Column) -> Column:
    """X21. Struct (inputs, output) of a declaration's text: what stands between its first brackets, and behind -> or a colon after them.

    White space of any kind is one space. inputs are structs (name, type, value), split at the first colon and
    equals sign outside of brackets.
    """
    flat = F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"^ | $", "")
    inner = F.regexp_extract(flat, r"\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", 1)
    rest = F.regexp_extract(flat, r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*(?:->|:)\s*([^{;=]*?)\s*(?:[{;=]|\z|:\z)", 1)
    part = lambda p, k: F.nullif(F.regexp_replace(F.regexp_extract(p, r"^([^:=]*)(?::((?:[^=<>]|<[^<>]*>)*))?(?:=(.*))?$", k), "^ | $", ""), F.lit(""))
    inputs = F.transform(split_top_level(inner), lambda p: F.struct(part(p, 1).alias("name"), part(p, 2).alias("type"), part(p, 3).alias("value")))
    return F.struct(inputs.alias("inputs"), F.nullif(rest, F.lit("")).alias("output"))
