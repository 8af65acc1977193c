"""Children of one table that are alike become one table with a key column."""

from __future__ import annotations

import re

from ..naming import column_names, truncated
from ..types import JSONB, TEXT, widen
from .catalog import Catalog, Column, Table, generated, with_parent

KEY_SHARE = 0.8
MANY = 200


def key_shape(keys: list[str]) -> str:
    """numeric, iso_lang, mixed or slug."""
    digits = sum(bool(re.fullmatch(r"[0-9]+", k)) for k in keys)
    lang = sum(bool(re.fullmatch(r"[A-Za-z]{2,3}", k)) for k in keys)
    n = max(len(keys), 1)
    return "numeric" if digits / n >= KEY_SHARE else "iso_lang" if lang / n >= KEY_SHARE else "mixed" if digits and lang else "slug"


KEY_COLUMN = {"numeric": "key_id", "iso_lang": "lang_code", "mixed": "key", "slug": "key"}


def jaccard_min(sets: list[set[str]]) -> float:
    """The least similarity of two of the column sets. Columns that few have don't count when all have some; very many sets are held against the first alone."""
    if len(sets) < 2 or not any(sets):
        return 1.0
    if all(sets):
        least = max(2, len(sets) // 20)
        count: dict[str, int] = {}
        for s in sets:
            for k in s:
                count[k] = count.get(k, 0) + 1
        sets = [{k for k in s if count[k] >= least} for s in sets]
    low = 1.0
    for i in range(1 if len(sets) > MANY else len(sets) - 1):
        for b in sets[i + 1 :]:
            union = len(sets[i] | b)
            low = min(low, len(sets[i] & b) / union if union else 1.0)
            if low == 0:
                return 0.0
    return low


def union_columns(tables: list[Table], reserved: set[str]) -> list[Column]:
    """Their columns by key, widened and nullable."""
    types: dict[str, object] = {}
    for t in tables:
        for c in t.data:
            types[c.key] = widen(types[c.key], c.type) if c.key in types else c.type
    keys = sorted(types, key=lambda k: k.encode())
    names, _ = column_names(keys, reserved)
    return [Column(names[k], k, types[k]) for k in keys]


def columns_for(catalog: Catalog, base: list[Column], key: str, members: list[Table], array: bool) -> list[Column]:
    o = catalog.options
    out = list(base)
    if array and not any(c.role == "order" for c in out):
        out.append(Column(f"{o.prefix}order", "", generated(o, "object_array", "x")[-1].type, "order", True))
    out.append(Column(key, key, TEXT, "key", True))
    out += union_columns(members, {c.name for c in out} | {f"{o.prefix}data"})
    return [*out, Column(f"{o.prefix}data", "", JSONB, "data")]


def merge_siblings(catalog: Catalog) -> Catalog:
    """Decided on the tables as they were before any merge, then applied; arrays and objects below one table never both merge into it."""
    o = catalog.options
    if not o.sibling_threshold:
        return catalog
    before, decisions = catalog.copy(), []
    below: dict[str, list[Table]] = {}
    for t in before:
        if t.parent and t.kind in ("object", "object_array"):
            below.setdefault(t.parent, []).append(t)
    for parent in before:
        if parent.layout != "columns":
            continue
        for kind in ("object", "object_array"):
            group = [t for t in below.get(parent.name, []) if t.kind == kind]
            if len(group) >= o.sibling_threshold and (d := decide(before, parent, group, kind == "object_array", below)):
                decisions.append((parent.name, d))
                break
    for name, d in decisions:
        apply(catalog, catalog[name], d)
    return catalog.sorted()


def similar(catalog: Catalog, group: list[Table]) -> bool:
    """Alike among those that have columns, where these are enough; else among all."""
    least = catalog.options.sibling_threshold
    bearing = [t for t in group if t.data]
    chosen = bearing if len(bearing) >= least else group
    return jaccard_min([{c.key for c in t.data} for t in chosen]) >= catalog.options.sibling_jaccard


def decide(catalog: Catalog, parent: Table, group: list[Table], array: bool, below: dict[str, list[Table]]) -> dict | None:
    least = catalog.options.sibling_threshold
    container = lambda t: not t.data and len(below.get(t.name, [])) >= least
    numeric = [t for t in group if re.fullmatch(r"[0-9]+", t.key)]
    other = [t for t in group if t not in numeric]
    if numeric and other:
        others = [t for t in other if not container(t)]
        strict = lambda g: len(g) >= least and jaccard_min([{c.key for c in t.data} for t in g]) >= catalog.options.sibling_jaccard
        parts = [("num", numeric)] * strict(numeric) + [("key", others)] * strict(others)
        if parts:
            return {"array": array, "parts": parts}
        if not parent.data and similar(catalog, group):
            return {"array": array, "whole": group, "key": "key"}
        return None
    members = group if not any(t.data for t in group) else [t for t in group if not container(t)]
    if len(members) < least or not similar(catalog, members):
        return None
    if parent.data or len(members) < len(group):
        if other and parent.data:
            return None
        return {"array": array, "parts": [("num" if numeric else "key", members)]}
    return {"array": array, "whole": members, "key": KEY_COLUMN[key_shape([t.key for t in members])]}


def apply(catalog: Catalog, parent: Table, d: dict) -> None:
    o = catalog.options
    if "whole" in d:
        parent.columns = columns_for(catalog, with_parent(catalog, parent), d["key"], d["whole"], d["array"])
        parent.layout, parent.params = "keyed_pivot", {"array": d["array"]}
        return
    groups = []
    for suffix, members in d["parts"]:
        shape = key_shape([t.key for t in members])
        key = "key_id" if suffix == "num" else "lang_code" if shape == "iso_lang" else "key"
        name = catalog.names_taken.free(truncated(f"{parent.name}_{suffix}"))
        t = Table(name, (*parent.path, name), "object_array" if d["array"] else "object", parent.depth + 1, parent.name, layout="group")
        t.columns = columns_for(catalog, generated(o, "object", parent.name), key, members, d["array"])
        t.params = {"numeric": suffix == "num", "array": d["array"], "kept": []}
        groups.append({"table": name, "absorbed": [m.name for m in members], "numeric": suffix == "num"})
        catalog.tables.append(t)
    parent.layout, parent.params = "multi_keyed_pivot", {"groups": groups}
    absorbed = {n for g in groups for n in g["absorbed"]}
    kept = [c.key for c in catalog.children(parent.name) if c.layout not in ("group", "wide") and c.name not in absorbed]
    for g in groups:
        catalog[g["table"]].params["kept"] = kept
