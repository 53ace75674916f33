"""Modules of declarations, their links, and packages with a lock. All of it is driver-side.

A module is a set of declarations with exports and imports; imports must not form a
cycle, and root names are unique in a universe. A package pins its dependencies
exactly, and its lock holds a SHA-256 over each module's text; anything that the lock
does not confirm is refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pactum.plans.subsume import Facts, subsumes


class LinkError(ValueError):
    pass


@dataclass
class Module:
    """declarations: name -> what it declares; roots: names of inputs and outputs; imports: module -> names."""

    name: str
    declarations: dict[str, object]
    exports: Sequence[str] = ()
    imports: Mapping[str, Sequence[str]] = field(default_factory=dict)
    roots: Sequence[str] = ()


def link(modules: Sequence[Module]) -> dict[str, dict[str, object]]:
    """Each module's names with what they stand for, its own and imported ones."""
    by_name = {m.name: m for m in modules}
    if len(by_name) < len(modules):
        raise LinkError("E3001: two modules of one name")
    roots: dict[str, str] = {}
    for m in modules:
        for r in m.roots:
            if r in roots:
                raise LinkError(f"E3007: root {r} of {roots[r]} and {m.name}")
            roots[r] = m.name
    done: dict[str, dict[str, object]] = {}

    def visit(name: str, path: tuple[str, ...]) -> dict[str, object]:
        if name in path:
            raise LinkError(f"E3004: {' -> '.join([*path[path.index(name):], name])}")
        if name not in by_name:
            raise LinkError(f"E3003: no module {name}")
        if name not in done:
            m = by_name[name]
            scope = dict(m.declarations)
            for other, names in m.imports.items():
                found = visit(other, (*path, name))
                for n in names:
                    if n not in by_name[other].exports:
                        raise LinkError(f"E3005: {other} does not export {n}")
                    if n in scope:
                        raise LinkError(f"E3006: {n} is declared twice in {name}")
                    scope[n] = found[n]
            done[name] = scope
        return done[name]

    for m in modules:
        visit(m.name, ())
    return done


def digest(files: Mapping[str, bytes]) -> str:
    """One SHA-256 over module files, by their sorted names and lengths."""
    h = hashlib.sha256()
    for name in sorted(files):
        h.update(f"{name}\0{len(files[name])}\0".encode())
        h.update(files[name])
    return h.hexdigest()


def lock(folder: Path, pins: Mapping[str, str]) -> str:
    """The text of a lock for the packages of a folder, at exactly the pinned versions."""
    entries = {}
    for name, version in sorted(pins.items()):
        if not version or not all(x.isdigit() for x in version.split(".")):
            raise LinkError(f"E3010: {name} needs an exact version, not {version!r}")
        files = {str(f.relative_to(folder / name)): f.read_bytes() for f in sorted((folder / name).rglob("*.py"))}
        entries[name] = {"version": version, "sha256": digest(files)}
    return json.dumps(entries, indent=2, sort_keys=True) + "\n"


def verify(folder: Path, pins: Mapping[str, str], locked: str) -> None:
    """Refuse a folder whose packages are not those of the lock."""
    if lock(folder, pins) != locked:
        raise LinkError("E3012: the lock does not confirm the packages")


def embedding(declared: Mapping[str, Facts], offered: Mapping[str, Facts]) -> None:
    """A record that declares its context fits a site whose owners offer it: E4090 if one is missing, E4094 if it is wider."""
    for name, bound in declared.items():
        if name not in offered:
            raise LinkError(f"E4090: the site offers no {name}")
        if not subsumes(offered[name], bound):
            raise LinkError(f"E4094: {name} is wider than declared")
