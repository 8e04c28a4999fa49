"""Settings from a TOML file: what is read, how it is cut, how it is searched, and the projects."""

from __future__ import annotations

import dataclasses
import json
import math
import os
import re
import tempfile
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from .operators import chunk as C
from .operators import rank as R
from .operators import state as U
from .sources import files

#: The file that is looked for in a folder and all above it, and then at home.
NAME = Path(".tidewell/config.toml")


@dataclass(frozen=True)
class Indexing:
    documents_path: str = "."
    index_path: str = ".index"
    include: tuple[str, ...] = tuple(files.INCLUDE)
    exclude: tuple[str, ...] = tuple(files.EXCLUDE)
    exclude_hidden_dirs: bool = True
    #: Seconds between looks at all files; 0 for none.
    reconciliation_interval_seconds: int = 3600
    debounce_window_seconds: float = U.QUIET
    task_backpressure_limit: int = 100
    delta_full_reindex_threshold: float = U.REINDEX
    move_detection_threshold: float = U.MOVED


@dataclass(frozen=True)
class Search:
    semantic_weight: float = 1.0
    keyword_weight: float = 1.0
    abstention_threshold: float | None = None
    reranker_model: str | None = None
    rerank_budget: int = 0
    project_uplift_multiplier: float = R.UPLIFT

    def __post_init__(self):
        if not (math.isfinite(self.project_uplift_multiplier) and self.project_uplift_multiplier > 0):
            raise ValueError("project_uplift_multiplier must be a finite number above 0")
        if self.abstention_threshold is not None and not 0 <= self.abstention_threshold <= 1:
            raise ValueError("abstention_threshold must be from 0 to 1")
        if (self.reranker_model is None) != (self.rerank_budget == 0) or self.rerank_budget < 0 or self.reranker_model is not None and not self.reranker_model.strip():
            raise ValueError("reranker_model and rerank_budget are set together, the budget to 1 or more")

    @property
    def weights(self) -> dict[str, float]:
        return {"vector": self.semantic_weight, "keyword": self.keyword_weight, "graph": 1.0, "expansion": 1.0}


@dataclass(frozen=True)
class Chunking:
    strategy: str = "header_based"
    min_chunk_chars: int = C.LEAST
    max_chunk_chars: int = C.MOST
    overlap_chars: int = C.OVERLAP
    parent_chunk_min_chars: int = C.PARENT_LEAST
    parent_chunk_max_chars: int = C.PARENT_MOST


@dataclass(frozen=True)
class Commits:
    enabled: bool = True
    watch_enabled: bool = True
    poll_interval_seconds: float = 30.0


@dataclass(frozen=True)
class Project:
    name: str
    path: str

    def __post_init__(self):
        if not re.fullmatch("[A-Za-z0-9_-]+", self.name):
            raise ValueError(f"a project's name has letters, digits, _ and - alone: {self.name!r}")


@dataclass(frozen=True)
class Config:
    indexing: Indexing = field(default_factory=Indexing)
    search: Search = field(default_factory=Search)
    chunking: Chunking = field(default_factory=Chunking)
    git_indexing: Commits = field(default_factory=Commits)
    projects: tuple[Project, ...] = ()

    def __post_init__(self):
        for what in ("name", "path"):
            values = [getattr(p, what) for p in self.projects]
            if twice := sorted({v for v in values if values.count(v) > 1}):
                raise ValueError(f"several projects have the {what} {', '.join(twice)}")


def _section(kind, data: object):
    """An object of this kind; keys that it lacks are left out, so that older files still load."""
    known = {f.name for f in dataclasses.fields(kind)}
    data = data if isinstance(data, dict) else {}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items() if k in known})


def nearest(start: str | Path, home: str | Path | None = None) -> Path | None:
    """The first settings file in a folder, in those above it, or at home."""
    start = Path(start).resolve()
    for folder in (start, *start.parents, Path(home) if home else Path.home()):
        if (folder / NAME).is_file():
            return folder / NAME
    return None


def load(path: str | Path | None) -> Config:
    """Settings of a file, with defaults for what it does not tell; defaults alone without a file."""
    data = {}
    if path is not None:
        with open(path, "rb") as f:
            data = tomllib.load(f)
    projects = [_section(Project, p | {"path": str(Path(p["path"]).expanduser())}) for p in data.get("projects", [])]
    sections = {"indexing": Indexing, "search": Search, "chunking": Chunking, "git_indexing": Commits}
    return Config(**{name: _section(kind, data.get(name)) for name, kind in sections.items()}, projects=tuple(projects))


def registered(path: str | Path, name: str, root: str | Path) -> Config:
    """The settings after a project was added to a file, which is made if there is none; its other lines and comments stay.

    A name or path that the file has already changes nothing. A reader sees the file as it was or as it is."""
    path, new = Path(path), Project(name, str(root))
    text = path.read_text(encoding="utf-8") if path.exists() else ""
    have = load(path).projects if path.exists() else ()
    if any(p.name == new.name or Path(p.path) == Path(new.path).expanduser() for p in have):
        return load(path)
    # JSON's strings are TOML's, but for one sign that TOML wants written as a number.
    said = lambda v: json.dumps(v, ensure_ascii=False).replace("\x7f", "\\u007f")
    text += ("" if not text or text.endswith("\n") else "\n") + ("\n" if text else "") + f"[[projects]]\nname = {said(new.name)}\npath = {said(new.path)}\n"
    tomllib.loads(text)  # a list of projects on one line cannot be added to
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=path.parent, prefix=f".{path.name}-", delete=False) as f:
        f.write(text)
    os.chmod(f.name, path.stat().st_mode if path.exists() else 0o644)
    os.replace(f.name, path)
    return load(path)
