"""Identifiers from JSON keys and paths."""

from __future__ import annotations

import re
from collections import Counter

MAX_BYTES = 63
HASHED_BASE = 55


def sanitize(key: str) -> str:
    """A lower-case identifier: other characters become single underscores; empty is `col`, a leading digit gets `c_`."""
    s = re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "_", key.lower())).strip("_")
    return "col" if not s else f"c_{s}" if s[0].isdigit() else s


def short_hash(s: str) -> str:
    """Seven hex digits of the 64-bit FNV-1a hash."""
    h = 0xCBF29CE484222325
    for b in s.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h & 0x0FFFFFFF:07x}"


def hashed(base: str, original: str) -> str:
    return f"{base.encode()[:HASHED_BASE].decode(errors='ignore')}_{short_hash(original)}"


def truncated(name: str, original: str | None = None) -> str:
    return name if len(name.encode()) <= MAX_BYTES else hashed(name, name if original is None else original)


class TableNames:
    """A name for each path, by its keys joined; a name taken by another path gets a hash of the path."""

    def __init__(self) -> None:
        self.by_path: dict[tuple[str, ...], str] = {}
        self.taken: set[str] = set()
        self.changed: list[tuple[str, str]] = []

    def name(self, path: tuple[str, ...]) -> str:
        if path not in self.by_path:
            full = "_".join(sanitize(p) for p in path)
            got = truncated(full, ".".join(path))
            if got in self.taken:
                got = hashed(full, ".".join(path))
            if got != full:
                self.changed.append((".".join(path), got))
            self.taken.add(got)
            self.by_path[path] = got
        return self.by_path[path]

    def free(self, name: str) -> str:
        """name, made unique, for a table that no path has."""
        got = truncated(name)
        k = 2
        while got in self.taken:
            got = truncated(f"{name}_{k}")
            k += 1
        self.taken.add(got)
        return got


def column_names(keys: list[str], reserved: set[str] = frozenset()) -> tuple[dict[str, str], list[str]]:
    """A column name for each key, and the keys whose names collide; each of these gets a hash of its key."""
    base = {k: truncated(sanitize(k), k) for k in keys}
    seen = Counter(base.values())
    clash = [k for k in keys if seen[base[k]] > 1 or base[k] in reserved]
    return base | {k: hashed(sanitize(k), k) for k in clash}, clash


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def parent_column(prefix: str, parent: str) -> str:
    return f"{prefix}{parent.encode()[:56].decode(errors='ignore')}_id"[:MAX_BYTES]
