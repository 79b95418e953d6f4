"""Finding source files: file specs, globs, project scans and filters."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from astrolith.functions.compat import glob_to_regex

# File extensions and default filters.
SOURCE_EXTENSIONS = (".cpp", ".cc", ".cxx", ".c++", ".C", ".c", ".hpp", ".hh", ".hxx", ".h++", ".H", ".h")
DEFAULT_PATTERNS = ["*.c", "*.cpp", "*.cc", "*.cxx"]
DEFAULT_EXCLUDES = ["test", "tests", "build", "examples", "third_party"]


@dataclass
class ProjectConfig:
    """What to scan and how to parse it; given lists replace the defaults."""

    root_path: str
    patterns: list[str] = field(default_factory=lambda: list(DEFAULT_PATTERNS))
    exclude: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUDES))
    include_paths: list[str] = field(default_factory=list)
    defines: list[str] = field(default_factory=list)
    std_version: str = ""
    strict: bool = False

    def flags(self) -> list[str]:
        std = [f"-std={self.std_version}"] if self.std_version else []
        return [*(f"-I{p}" for p in self.include_paths), *(f"-D{d}" for d in self.defines), *std]


def parse_file_spec(spec: str) -> tuple[str, str | None]:
    """``path`` or ``path:schema``; the colon of a drive letter is none."""
    head, sep, tail = spec.rpartition(":")
    if not sep or (len(head) == 1 and head.isalpha()) or "/" in tail or "\\" in tail:
        return spec, None
    return head, tail


def is_source_file(arg: str) -> bool:
    return parse_file_spec(arg)[0].endswith(SOURCE_EXTENSIONS)


def is_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?")


def schema_from_path(path: str) -> str:
    base = re.split(r"[/\\]", path)[-1]
    return re.sub(r"[^A-Za-z0-9]", "_", base.rsplit(".", 1)[0] if "." in base else base)


def _walk(root: str):
    for folder, dirs, files in os.walk(root, onerror=lambda e: None):
        dirs.sort()
        for f in files:
            yield os.path.join(folder, f)


def expand_glob(pattern: str) -> list[str]:
    """Sorted files that match, whatever the case, below the last folder
    before the first wildcard."""
    if not is_glob(pattern):
        return [pattern] if os.path.isfile(pattern) else []
    first = re.search(r"[*?]", pattern).start()
    cut = max(pattern.rfind("/", 0, first), pattern.rfind("\\", 0, first))
    root, rest = (pattern[:cut] or "/", pattern[cut + 1 :]) if cut >= 0 else (".", pattern)
    want = re.compile(f"(?i){glob_to_regex(rest)}\\Z")
    return sorted(p for p in _walk(root) if want.match(os.path.relpath(p, root)))


def matches_any_basename(path: str, patterns: list[str]) -> bool:
    base = re.split(r"[/\\]", path)[-1]
    return any(re.match(f"(?i){glob_to_regex(p)}\\Z", base) for p in patterns)


def excluded(path: str, names: list[str], ignore_case: bool = False) -> bool:
    """A component of the path, as given and root included, is excluded."""
    parts = re.split(r"[/\\]", path)
    if ignore_case:
        parts, names = [p.lower() for p in parts], [n.lower() for n in names]
    return bool(set(parts) & set(names))


def project_files(config: ProjectConfig) -> list[str]:
    """Sorted files of a project scan; the order of its translation units."""
    return sorted({p for p in _walk(config.root_path) if matches_any_basename(p, config.patterns) and not excluded(p, config.exclude)})


def matches_filters(path: str, patterns: list[str], excludes: list[str]) -> bool:
    """Filter of compile-database files; empty lists filter nothing."""
    return not (excludes and excluded(path, excludes, ignore_case=True)) and (not patterns or matches_any_basename(path, patterns))
