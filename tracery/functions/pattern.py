"""Code patterns with metavariables, matched over a file's tokens: a small helper of policy.matches.

$NAME stands for one expression: a run of tokens with closed brackets and no comma or semicolon outside of
them. $$$NAME and $$$ stand for any such run with commas, maybe none. Comments and white space do not count,
and one name stands for one text. A rule is YAML of pattern, regex, any, all, not, has and inside.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

STRING = r"\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])*'"
#: In these a quote opens one character, or names a lifetime.
CHARACTER = r"\"(?:\\.|[^\"\\])*\"|`[^`]*`|'(?:\\(?:u\{\w+\}|x\w\w|.)|[^'\\\n])'"
SLASHES, HASH = r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"(?<![\"'\w])#(?![\[!])[^\n]*"
# Comments of the known languages; others may have all.
COMMENTS = {"elixir": HASH, "python": HASH, "go": SLASHES, "javascript": SLASHES, "rust": SLASHES, "typescript": SLASHES}


@lru_cache
def _lexer(language: str | None) -> tuple[re.Pattern, re.Pattern]:
    """Tokens, and strings or comments, of a language."""
    string = CHARACTER if language in ("rust", "go") else STRING
    token = re.compile(r"\$\$\$[A-Z_][A-Z0-9_]*|\$\$\$|\$[A-Z_][A-Z0-9_]*|" + string + r"|[^\W\d]\w*[?!]?(?=\()|\w+|::|->|=>|[=!<>]=|&&|\|\||\S")
    return token, re.compile(string + "|" + COMMENTS.get(language, f"{SLASHES}|{HASH}"), re.S)


CLOSES = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Tokens:
    """A text's tokens, where they stand, and for each opening bracket the token behind its closing one."""

    text: str
    values: list[str]
    spans: list[tuple[int, int]]
    behind: dict[int, int]
    language: str | None = None


def tokens(text: str, language: str | None = None, comments: bool = True) -> Tokens:
    token, quoted = _lexer(language)
    code = quoted.sub(lambda m: m[0] if m[0][0] in "\"'`" else re.sub(r"[^\n]", " ", m[0]), text) if comments else text
    found = list(token.finditer(code))
    values, open_, behind = [m[0] for m in found], [], {}
    for k, v in enumerate(values):
        if v in CLOSES:
            open_.append(k)
        elif v in CLOSES.values() and open_ and CLOSES[values[open_[-1]]] == v:
            behind[open_.pop()] = k + 1
    return Tokens(text, values, [m.span() for m in found], behind, language)


def _run(t: Tokens, at: int, many: bool) -> Iterator[int]:
    """Where a run that begins at a token may end, the shortest first."""
    if many:
        yield at
    while at < len(t.values):
        v = t.values[at]
        if v in CLOSES.values() or v == ";" or v == "," and not many:
            return
        if v in CLOSES and at not in t.behind:
            return
        at = t.behind.get(at, at + 1)
        yield at


def _match(p: tuple[str, ...], k: int, t: Tokens, at: int, held: dict[str, tuple[int, int]], failed: set[tuple[int, int]] | None) -> tuple[int, dict[str, tuple[int, int]]] | None:
    """failed: places of the pattern that are known not to match from a token on, where no name is bound twice."""
    while k < len(p):
        if p[k].startswith("$") and len(p[k]) > 1:
            tried = [at]
            for end in () if failed is not None and (k, at) in failed else _run(t, at, p[k].startswith("$$$")):
                old = held.get(p[k])
                if old and t.values[slice(*old)] != t.values[at:end]:
                    continue
                if found := _match(p, k + 1, t, end, held if p[k] == "$$$" else {**held, p[k]: (at, end)}, failed):
                    return found
                if failed is not None and end != at and (k, end) in failed:
                    break  # a run from there on has the same ends
                tried.append(end)
            if failed is not None:
                failed.update((k, x) for x in tried)
            return None
        if at >= len(t.values) or t.values[at] != p[k]:
            return None
        k, at = k + 1, at + 1
    return at, held


def _nodes(t: Tokens, a: int, b: int) -> list[str]:
    """The texts of a run's expressions and of the commas between them."""
    out, first, k = [], a, a
    while k <= b:
        if k == b or t.values[k] == ",":
            if k > first:
                out.append(t.text[t.spans[first][0] : t.spans[k - 1][1]])
            if k < b:
                out.append(",")
            first = k + 1
            k += 1
        else:
            k = min(b, t.behind.get(k, k + 1))
    return out


@lru_cache(maxsize=4096)
def _words(pattern: str, language: str | None) -> tuple[str, ...]:
    """A pattern's tokens, told once for all files."""
    return tuple(tokens(pattern, language, comments=False).values)


def find(pattern: str, t: Tokens) -> dict[tuple[int, int], dict[str, str]]:
    """Token ranges that match a pattern, with what its names stand for."""
    p = _words(pattern, t.language)
    if not p:
        raise ValueError("empty pattern")
    out = {}
    names = [x for x in p if x.startswith("$") and len(x) > 1 and x != "$$$"]
    failed: set[tuple[int, int]] | None = set() if len(names) == len(set(names)) else None
    for at, v in enumerate(t.values):
        if not p[0].startswith("$") and (v != p[0] or at and re.match(r"\w", v) and t.values[at - 1] in (".", "::")):
            continue
        if (got := _match(p, 0, t, at, {}, failed)) and got[0] > at:
            captures = {}
            for name, (a, b) in got[1].items():
                nodes = _nodes(t, a, b) if name.startswith("$$$") else [t.text[t.spans[a][0] : t.spans[b - 1][1]]]
                captures[name.lstrip("$")] = "\n".join(nodes)
            out[at, got[0]] = captures
    return out


def evaluate(rule: dict, t: Tokens, among: dict[tuple[int, int], dict[str, str]] | None = None) -> dict[tuple[int, int], dict[str, str]]:
    """Token ranges that a rule matches, of those given or of all that its patterns find."""
    text = lambda r: t.text[t.spans[r[0]][0] : t.spans[r[1] - 1][1]]
    within = lambda a, b: b[0] <= a[0] and a[1] <= b[1]
    if unknown := set(rule) - {"pattern", "regex", "any", "all", "not", "has", "inside"}:
        raise ValueError(f"unknown rule: {sorted(unknown)[0]}")
    out = among
    if "pattern" in rule:
        found = find(rule["pattern"], t)
        out = found if out is None else {r: out[r] | found[r] for r in out if r in found}
    if "any" in rule:
        found = {}
        for part in rule["any"]:
            found |= evaluate(part, t, out)
        out = found
    for part in sorted(rule.get("all", []), key=lambda x: not {"pattern", "any", "all"} & set(x)):  # what finds comes before what filters
        out = evaluate(part, t, out)
    if out is None:
        raise ValueError("a rule needs a pattern")
    if "regex" in rule:
        out = {r: c for r, c in out.items() if re.search(rule["regex"], text(r))}
    if "not" in rule:
        out = {r: c for r, c in out.items() if r not in evaluate(rule["not"], t, dict(out))}
    for key, holds in (("has", lambda r, x: x != r and within(x, r)), ("inside", lambda r, x: x != r and within(r, x))):
        if key in rule:
            other = evaluate(rule[key], t)
            out = {r: c for r, c in out.items() if any(holds(r, x) for x in other)}
    return out


@lru_cache(maxsize=4096)
def read(rule: str) -> dict:
    """A rule of its text; what it holds is read too, so a rule that can be read can be evaluated."""
    import yaml

    told = yaml.safe_load(rule)
    told = told.get("rule", told) if isinstance(told, dict) else told

    def check(part: object) -> None:
        if not isinstance(part, dict):
            raise ValueError("a rule is a mapping")
        re.compile(part.get("regex", ""))
        if "pattern" in part and not tokens(part["pattern"], comments=False).values:
            raise ValueError("empty pattern")
        for key in ("any", "all"):
            for x in part.get(key, []):
                check(x)
        for key in ("not", "has", "inside"):
            if key in part:
                check(part[key])

    check(told)
    return told


def matches(text: str | Tokens, pattern: str | None, rule: str | None) -> list[tuple[int, str, str, dict[str, str]]]:
    """(line, range, text, captures) of what a pattern or a rule matches, in order of their places; a file's tokens serve many."""
    t = text if isinstance(text, Tokens) else tokens(text)
    found = find(pattern or "", t) if rule is None else evaluate(read(rule), t)
    starts = [0, *(m.end() for m in re.finditer("\n", t.text))]
    out = []
    for (a, b), captures in sorted(found.items()):
        lo, hi = t.spans[a][0], t.spans[b - 1][1]
        (l1, l2) = (bisect_right(starts, x) for x in (lo, hi))
        out.append((l1, f"L{l1}:C{lo - starts[l1 - 1] + 1}-L{l2}:C{hi - starts[l2 - 1] + 1}", t.text[lo:hi].strip(), captures))
    return out


@lru_cache(maxsize=4096)
def error(pattern: str | None, rule: str | None) -> str | None:
    """Why a pattern or a rule cannot be used, else nothing."""
    try:
        matches("x", pattern, rule)
    except Exception as e:  # whatever the YAML or the pattern holds
        return str(e).splitlines()[0]
    return None
