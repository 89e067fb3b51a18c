"""Elixir files as rows: modules, callables, directives with their scopes, and relationships; joins resolve them.

A small reader of tokens and do-end blocks. Sigils, heredocs and comments hold no code; macros are not expanded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.pattern import Tokens, tokens
from ..functions.spread import sliced, spread

# Words that declare callables, with the kind and whether others may call them; words that look like calls but are none.
DECLARES = {"def": ("function", True), "defp": ("function", False), "defmacro": ("macro", True), "defmacrop": ("macro", False), "defguard": ("guard", True), "defguardp": ("guard", False), "defdelegate": ("function", True)}
NO_CALLS = frozenset("alias and case cond def defdelegate defexception defguard defguardp defimpl defmacro defmacrop defmodule defp defprotocol defstruct do else end fn for if import in not or quote raise receive require rescue super throw try unless unquote unquote_splicing use when with".split())
MODULES = {"defmodule": "module", "defprotocol": "protocol", "defimpl": "implementation"}
BLANK = re.compile(r'"""[\s\S]*?"""|~[a-zA-Z](?:"[^"\n]*"|/[^/\n]*/|\([^)\n]*\)|\[[^\]\n]*\]|\{[^}\n]*\}|\|[^|\n]*\||<[^>\n]*>)')

_S, _L, _B = pa.string(), pa.int64(), pa.bool_()
SHAPES = {
    "modules": {"name": _S, "kind": _S, "of": _S, "start_line": _L, "end_line": _L},
    "callables": {"module": _S, "kind": _S, "name": _S, "least": _L, "most": _L, "exported": _B, "start_line": _L, "end_line": _L},
    "directives": {"kind": _S, "owner": _S, "module": _S, "alias": _S, "only_kind": _S, "only": pa.list_(_S), "except": pa.list_(_S), "line": _L, "site": _L, "scope_start": _L, "scope_end": _L},
    "relations": {"kind": _S, "owner": _S, "caller": _S, "caller_arity": _L, "module": _S, "name": _S, "arity": _L, "line": _L, "site": _L},
}
NAMES = {_S: "string", _L: "bigint", _B: "boolean", pa.list_(_S): "array<string>"}
PARSED = "path string, " + ", ".join(f"{k} array<struct<{','.join(f'`{n}`:{NAMES[t]}' for n, t in f.items())}>>" for k, f in SHAPES.items())


def _arguments(t: Tokens, at: int) -> list[tuple[int, int]]:
    """Token ranges of the arguments between the brackets that open at a token."""
    end, out, first, k = t.behind.get(at, at + 1) - 1, [], at + 1, at + 1
    while k < end:
        if t.values[k] == ",":
            out.append((first, k))
            first = k + 1
        k = t.behind.get(k, k + 1)
    return [*out, (first, end)] if first < end else out


def _module(t: Tokens, at: int) -> tuple[str, int]:
    """A module's name that begins at a token, and the token behind it."""
    name, k = "", at
    while k < len(t.values) and (re.match(r"[A-Z]\w*\Z", t.values[k]) or t.values[k] == "__MODULE__"):
        name, k = f"{name}.{t.values[k]}" if name else t.values[k], k + 1
        if k + 1 < len(t.values) and t.values[k] == "." and re.match(r"[A-Z]", t.values[k + 1]):
            k += 1
        else:
            break
    return name, k


def _options(t: Tokens, at: int, line: int, lines: list[int]) -> dict[str, tuple[int, int]]:
    """Token ranges of the key: value options from a token to the end of its line or brackets."""
    out, k, key, first = {}, at, None, at
    while k < len(t.values) and (lines[k] == line or t.values[k - 1] == ",") and t.values[k] not in ("do", "end", "}", ")"):
        if t.values[k] == ",":
            if key:
                out[key] = (first, k)
            key = None
        elif key is None and k + 1 < len(t.values) and t.values[k + 1] == ":" and re.match(r"\w", t.values[k]):
            key, first = t.values[k], k + 2
            k += 1
        line = max(line, lines[min(k, len(lines) - 1)]) if t.values[k] == "," else line
        k = t.behind.get(k, k + 1)
    if key:
        out[key] = (first, k)
    return out


def _pairs(t: Tokens, span: tuple[int, int]) -> list[str]:
    """name/arity of a list of name: arity."""
    v = t.values[slice(*span)]
    return [f"{v[i]}/{v[i + 2]}" for i in range(len(v) - 2) if v[i + 1] == ":" and v[i + 2].isdigit()]


def parse(path: str, text: str | None) -> dict:
    """A file's row."""
    code = BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text or "")
    t = tokens(code)
    starts = [m.end() for m in re.finditer("\n", code)]
    lines, k = [], 0
    for a, _ in t.spans:
        while k < len(starts) and starts[k] <= a:
            k += 1
        lines.append(k + 1)
    out: dict[str, list[dict]] = {k: [] for k in SHAPES}
    blocks: list[tuple[str, dict | None, list[dict]]] = []  # open blocks: what, its row, directives that end with it
    heads: list[tuple[str, dict]] = []  # declared, and waiting for their do
    v, n = t.values, len(t.values)

    def module() -> str | None:
        return next((b[1]["name"] for b in reversed(blocks) if b[0] == "module"), None)

    def caller() -> dict | None:
        return next((b[1] for b in reversed(blocks) if b[0] == "callable"), inline[0] if inline and inline[1] >= lines[at] else None)

    def close(line: int) -> None:
        _, row, own = blocks.pop()
        for d in [row, *own]:
            if d is not None:
                d["scope_end" if "scope_end" in d else "end_line"] = line

    def relate(kind: str, to: str | None, name: str | None, arity: int | None) -> None:
        who = caller()
        if to == "__MODULE__" or to and to.startswith("__MODULE__."):
            to = (module() or "") + to[10:]
        out["relations"].append({"kind": kind, "owner": module(), "caller": who and who["name"], "caller_arity": who and who["most"], "module": to, "name": name, "arity": arity, "line": lines[at], "site": t.spans[at][0]})

    inline: tuple[dict, int] | None = None  # a callable written as do: and the line it ends on
    at = 0
    while at < n:
        x, line = v[at], lines[at]
        if x in MODULES and at + 1 < n:
            name, k = _module(t, at + 1)
            above = module()
            of = _options(t, k, line, lines).get("for") if x == "defimpl" else None
            kind = _module(t, of[0])[0] if of else above if x == "defimpl" else None
            full = f"{name}.{kind}" if x == "defimpl" else f"{above}.{name}" if above else name
            row = {"name": full, "kind": MODULES[x], "of": name if x == "defimpl" else None, "start_line": line, "end_line": line}
            out["modules"].append(row)
            heads.append(("module", row))
            if x == "defimpl":
                out["relations"].append({"kind": "protocol", "owner": full, "caller": None, "caller_arity": None, "module": name, "name": None, "arity": None, "line": line, "site": t.spans[at][0]})
            at = k
            continue
        if x == "@" and at + 2 < n and v[at + 1] in ("callback", "macrocallback", "behaviour"):
            if v[at + 1] == "behaviour":
                relate("implementation", _module(t, at + 2)[0], None, None)
            else:
                args = _arguments(t, at + 3) if at + 3 < n and v[at + 3] == "(" else []
                out["callables"].append({"module": module(), "kind": "macro-callback" if v[at + 1] == "macrocallback" else "callback", "name": v[at + 2], "least": len(args), "most": len(args), "exported": True, "start_line": line, "end_line": line})
            while at < n and lines[at] == line:  # its types are no calls
                at += 1
            continue
        if x in DECLARES and at + 1 < n and (not at or v[at - 1] not in (".", "&", ":")):
            kind, exported = DECLARES[x]
            bracket = at + 2 < n and v[at + 2] == "("
            args = _arguments(t, at + 2) if bracket else []
            defaults = sum("\\" in v[a:b] for a, b in args)
            row = {"module": module(), "kind": kind, "name": v[at + 1], "least": len(args) - defaults, "most": len(args), "exported": exported, "start_line": line, "end_line": line}
            out["callables"].append(row)
            behind = t.behind.get(at + 2, at + 3) if bracket else at + 2
            k = behind
            while k < n and v[k] not in ("do", "end", *DECLARES, *MODULES) and not (v[k - 1] != "," and lines[k] > lines[behind - 1] and v[k] not in ("when", ",", "and", "or", "do")):
                k = t.behind.get(k, k + 1)
            if x == "defdelegate":
                told = _options(t, behind, line, lines)
                blocks.append(("callable", row, []))
                relate("delegate", _module(t, told["to"][0])[0] if "to" in told else None, v[told["as"][0] + 1] if "as" in told and v[told["as"][0]] == ":" else row["name"], row["most"])
                blocks.pop()
                at = k
                continue
            if k < n and v[k] == "do" and not (k + 1 < n and v[k + 1] == ":"):
                heads.append(("callable", row))
            else:
                last = max((lines[j] for j in range(at, min(k, n))), default=line)
                row["end_line"], inline = last, (row, last)
            at = behind
            continue
        if x in ("alias", "import", "require", "use") and at + 1 < n and (re.match(r"[A-Z]", v[at + 1]) or v[at + 1] == "__MODULE__"):
            name, k = _module(t, at + 1)
            name = name.replace("__MODULE__", module() or "__MODULE__")
            told = _options(t, k, line, lines)
            many = [(name, None)]
            if k + 1 < n and v[k] == "." and v[k + 1] == "{":
                many = [(f"{name}.{_module(t, a)[0]}", None) for a, _ in _arguments(t, k + 1)]
                k = t.behind.get(k + 1, k + 2)
            only = told.get("only")
            for full, _ in many:
                own = _module(t, told["as"][0])[0] if "as" in told else full.rsplit(".", 1)[-1]
                row = {
                    "kind": x, "owner": module(), "module": full, "alias": own if x == "alias" or "as" in told else None, "only_kind": v[only[0] + 1] if only and v[only[0]] == ":" else None,
                    "only": _pairs(t, only) if only and v[only[0]] != ":" else None, "except": _pairs(t, told["except"]) if "except" in told else None, "line": line, "site": t.spans[at][0], "scope_start": line, "scope_end": lines[-1],
                }
                out["directives"].append(row)
                if blocks:
                    blocks[-1][2].append(row)
            while k < n and lines[k] == line:
                k += 1
            at = k
            continue
        if x == "do" and not (at + 1 < n and v[at + 1] == ":"):
            what, row = heads.pop() if heads else ("other", None)
            blocks.append((what, row, []))
        elif x == "fn":
            blocks.append(("other", None, []))
        elif x == "end" and blocks and not (at + 1 < n and v[at + 1] == ":"):
            close(line)
        elif caller() is not None:
            piped = at >= 2 and v[at - 2 : at] == ["|", ">"]
            before = v[at - 1] if at else ""
            if re.match(r"[A-Z]", x) and before != ".":
                name, k = _module(t, at)
                piped = at >= 2 and v[at - 2 : at] == ["|", ">"]
                if k + 1 < n and v[k] == "." and re.match(r"[a-z_]", v[k + 1]):
                    if k + 3 < n and v[k + 2] == "/" and v[k + 3].isdigit() and "&" in v[max(0, at - 1) : at]:
                        relate("capture", name, v[k + 1], int(v[k + 3]))
                    else:
                        args = _arguments(t, k + 2) if k + 2 < n and v[k + 2] == "(" else []
                        relate("call", name, v[k + 1], len(args) + piped)
                    at = k + 2
                    continue
                at = k
                continue
            if re.match(r"[a-z_]", x) and before == "&" and at + 2 < n and v[at + 1] == "/" and v[at + 2].isdigit():
                relate("capture", None, x, int(v[at + 2]))
            elif re.match(r"[a-z_]\w*[?!]?\Z", x) and at + 1 < n and v[at + 1] == "(" and t.spans[at + 1][0] == t.spans[at][1] and x not in NO_CALLS and before not in (":", "@"):
                args = _arguments(t, at + 1)
                if before == ".":
                    relate("dynamic", None, x, len(args) + piped)
                elif x == "apply" and len(args) == 3:
                    to, k = _module(t, args[0][0])
                    a, b = args[1]
                    literal = to and k == args[0][1] and b - a == 2 and v[a] == ":" and v[args[2][0]] == "["
                    relate("call" if literal else "dynamic", to or None, v[a + 1] if literal else None, len(_arguments(t, args[2][0])) if literal else None)
                    if literal:
                        at = t.behind.get(at + 1, at + 2)
                        continue
                else:
                    relate("call", None, x, len(args) + piped)
        at += 1
    while blocks:
        close(lines[-1] if lines else 1)
    return {"path": path} | out


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", _S), *((k, pa.list_(pa.struct(list(f.items())))) for k, f in SHAPES.items())])
    for batch in sliced(batches):
        yield pa.RecordBatch.from_pylist([parse(p, x) for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], schema)


def parsed(sources: DataFrame) -> DataFrame:
    """Rows of Elixir sources (path, text): modules, callables, directives and relations."""
    return spread(sources.select("path", "text"), "path").mapInArrow(_files, PARSED)
