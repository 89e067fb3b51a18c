"""Configuration of a repository."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import PurePosixPath

# Defaults.
KEEP, STAGES = 20, ["commit", "push", "ci"]


@dataclass
class Config:
    docs: str = "docs"
    adr: str = "docs/adr"
    roots: list[str] = field(default_factory=lambda: ["."])
    excludes: list[str] = field(default_factory=list)
    index: bool = True
    keep: int = KEEP
    stages: list[str] = field(default_factory=lambda: list(STAGES))
    imports: list[dict] = field(default_factory=list)


def relative(path: str) -> str:
    """A path below the repository, in its plain form."""
    parts = [p for p in PurePosixPath(path.strip()).parts if p != "."]
    if path.strip().startswith("/") or ".." in parts:
        raise ValueError(f"path leaves the repository: {path}")
    return "/".join(parts) or "."


def read(text: str) -> Config:
    """Configuration from TOML; unknown keys are ignored, patterns belong to decisions and are refused here."""
    data = tomllib.loads(text)
    if data.get("patterns"):
        raise ValueError("patterns are declared by decisions")
    part = lambda k: data.get(k) or {}
    base = Config()
    return Config(
        docs=relative(part("vault").get("docs", base.docs)), adr=relative(part("vault").get("adr", base.adr)),
        roots=[relative(r) for r in part("source").get("roots", base.roots)], excludes=list(part("source").get("exclude", [])),
        index=bool(part("index").get("source", True)), keep=int(part("state").get("keep", KEEP)),
        stages=[s for s in part("enforce").get("stages", STAGES) if s in STAGES], imports=list(part("enforce").get("imports", [])),
    )
