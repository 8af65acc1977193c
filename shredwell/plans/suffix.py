"""Keys that share suffixes: energy, energy_100g, energy_unit are one name with several values."""

from __future__ import annotations

from ..naming import sanitize
from ..types import TEXT, Phys, widen

MIN_SHARE, MIN_BASES = 0.3, 2


def _type(keys: list[str], types: dict[str, Phys]) -> Phys:
    out = types[keys[0]]
    for k in keys[1:]:
        out = widen(out, types[k])
    return out


def column_of(suffix: str) -> str:
    name = sanitize(suffix.lstrip("_"))
    return "norm_value" if name in ("value", "name") else name


def detect(types: dict[str, Phys]) -> tuple[list[tuple[str, str, Phys]], Phys] | None:
    """Suffixes in order with their columns and types, and the type of bare names; None if no suffix is common enough."""
    bases: dict[str, set[str]] = {}
    for key in types:
        for i, c in enumerate(key):
            if c == "_" and 0 < i < len(key) - 1:
                bases.setdefault(key[i:], set()).add(key[:i])
    bases = {s: b for s, b in bases.items() if len(b) >= MIN_BASES}
    names = set().union(*bases.values()) if bases else set()
    kept = sorted(s for s, b in bases.items() if len(b) / len(names) >= MIN_SHARE)
    if not kept:
        return None
    bare = [k for k in sorted(types) if k in names and not any(k.endswith(s) and len(k) > len(s) for s in kept)]
    return [(s, column_of(s), _type(sorted(b + s for b in bases[s]), types)) for s in kept], _type(bare, types) if bare else TEXT


def explicit(types: dict[str, Phys], suffixes: list[str]) -> tuple[list[tuple[str, str, Phys]], Phys]:
    """The same for given suffixes; each gets a leading underscore if it has none."""
    suffixes = [s if s.startswith("_") else f"_{s}" for s in suffixes]
    out = []
    for s in suffixes:
        keys = [k for k in sorted(types) if k.endswith(s) and len(k) > len(s)]
        out.append((s, column_of(s), _type(keys, types) if keys else TEXT))
    bare = [k for k in sorted(types) if not any(k.endswith(s) and len(k) > len(s) for s in suffixes)]
    return out, _type(bare, types) if bare else TEXT
