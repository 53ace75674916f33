"""Plan-time relations of types: subsumption, emptiness, and discriminability of unions.

Types are tuples: ("prim", kind), ("lits", values), ("range", lo, hi, open, kind),
("pattern", regex), ("array", element, least, most), ("map", key, value),
("record", {name: (kind, type)}, open), ("union", *arms), ("ref", name), ("null",),
("any",), and ("named", name) for a type that is looked up in `names`, which may be
recursive.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

Facts = tuple
INF = float("inf")
_SHAPE = {"bool": bool, "string": str}


def kind_of(t: Facts, names: Mapping[str, Facts] = {}) -> set[str]:
    """The kinds of value that a type admits."""
    tag = t[0]
    if tag == "named":
        return kind_of(names[t[1]], names)
    if tag == "union":
        return set().union(*(kind_of(a, names) for a in t[1:]))
    if tag == "lits":
        return {_value_kind(x) for x in t[1]}
    return {"prim": {t[1] if len(t) > 1 else ""}, "range": {t[4] if len(t) > 4 else "int"}, "pattern": {"string"}, "ref": {"ref"}}.get(tag, {tag})


def _value_kind(x) -> str:
    return "bool" if isinstance(x, bool) else "int" if isinstance(x, int) else "float" if isinstance(x, float) else "null" if x is None else "string"


def _bounds(t: Facts) -> tuple[float, float, bool]:
    """Lowest, highest, and whether the highest is left out; integer ranges are closed."""
    _, lo, hi, open_, kind = t
    return (lo, hi - 1, False) if open_ and kind == "int" else (lo, hi, open_)


def empty(t: Facts, names: Mapping[str, Facts] = {}, seen: frozenset = frozenset()) -> bool:
    """Whether no value has the type, as far as its structure shows."""
    tag = t[0]
    if tag == "named":
        return t[1] not in seen and empty(names[t[1]], names, seen | {t[1]})
    if tag == "union":
        return all(empty(a, names, seen) for a in t[1:])
    if tag == "lits":
        return not t[1]
    if tag == "range":
        lo, hi, open_ = _bounds(t)
        return lo > hi or (open_ and lo == hi)
    if tag == "array":
        least, most = t[2] or 0, INF if t[3] is None else t[3]
        return least > most or (least > 0 and empty(t[1], names, seen))
    if tag == "record":
        return any(kind == "required" and empty(x, names, seen) for kind, x in t[1].values())
    return False


def subsumes(a: Facts, b: Facts, names: Mapping[str, Facts] = {}, assumed: frozenset = frozenset()) -> bool:
    """Whether every value of a is one of b. Pairs of named types that are being compared are taken to hold."""
    if repr(a) == repr(b) or b == ("any",) or empty(a, names):  # 1 and 1.0 are equal, their texts are not
        return True
    if a[0] == "named" or b[0] == "named":
        pair = (repr(a), repr(b))
        if pair in assumed:
            return True
        look = lambda t: names[t[1]] if t[0] == "named" else t
        return subsumes(look(a), look(b), names, assumed | {pair})
    go = lambda x, y: subsumes(x, y, names, assumed)
    if a[0] == "union":
        return all(go(x, b) for x in a[1:])
    if a[0] == "lits":
        if b[0] == "union" and len(a[1]) > 1:
            return all(go(("lits", frozenset({x})), b) for x in a[1])
        if b[0] != "union":
            return all(admits(b, x) for x in a[1])
    if a == ("prim", "bool") and b[0] in ("union", "lits"):
        return all(go(("lits", frozenset({x})), b) for x in (True, False))
    if b[0] == "union":
        return any(go(a, y) for y in b[1:])
    tags = (a[0], b[0])
    if tags == ("range", "range"):
        (alo, ahi, aopen), (blo, bhi, bopen) = _bounds(a), _bounds(b)
        return a[4] == b[4] and alo >= blo and (ahi < bhi or (ahi == bhi and (aopen or not bopen)))
    if tags == ("range", "prim"):
        return a[4] == b[1]
    if tags == ("range", "lits"):
        lo, hi, _ = _bounds(a)
        return a[4] == "int" and hi - lo < 65536 and all(i in b[1] for i in range(int(lo), int(hi) + 1))
    if tags == ("pattern", "prim"):
        return b[1] == "string"
    if tags == ("array", "array"):
        size = lambda t: (t[2] or 0, INF if t[3] is None else t[3])
        (al, am), (bl, bm) = size(a), size(b)
        return al >= bl and am <= bm and (am == 0 or go(a[1], b[1]))
    if tags == ("map", "map"):
        return go(a[1], b[1]) and go(a[2], b[2])
    if tags == ("record", "map"):
        return not a[2] and all(go(("lits", frozenset({n})), b[1]) and go(t, b[2]) for n, (kind, t) in a[1].items() if kind != "hidden")
    if tags == ("record", "record"):
        mine, yours = a[1], b[1]
        for n, (kind, t) in yours.items():
            if n not in mine:
                if kind == "required" or a[2]:
                    return False
                continue
            own_kind, own = mine[n]
            if (kind == "required" and own_kind == "optional") or not go(own, t):
                return False
        return b[2] or (not a[2] and mine.keys() <= yours.keys())
    return False


def admits(t: Facts, x) -> bool:
    """Whether a scalar value has the type."""
    tag = t[0]
    if tag == "any":
        return True
    if tag == "union":
        return any(admits(a, x) for a in t[1:])
    if tag == "lits":
        return any(x == y and _value_kind(x) == _value_kind(y) for y in t[1])
    if tag == "prim":
        return _value_kind(x) == t[1]
    if tag == "range":
        lo, hi, open_ = _bounds(t)
        return _value_kind(x) == t[4] and lo <= x and (x < hi if open_ else x <= hi)
    if tag == "pattern":
        return isinstance(x, str) and re.fullmatch(t[1], x) is not None
    return tag == "null" and x is None


def discriminant(arms: Mapping[str, Facts]) -> str:
    """The member whose literals tell a union's record arms apart. E4013 if there is none; E4014 if two arms share a literal."""
    records = list(arms.values())
    shared = set.intersection(*(set(r[1]) for r in records))
    candidates = [n for n in shared if all(r[1][n][0] == "required" and r[1][n][1][0] == "lits" for r in records)]
    if not candidates:
        raise TypeError("E4013: no member tells the arms apart")
    for n in sorted(candidates):
        values = [v for r in records for v in r[1][n][1][1]]
        if len(values) == len(set(values)):
            return n
    raise TypeError(f"E4014: arms share a value of {sorted(candidates)}")


def breaking_changes(old: Mapping[str, tuple[str, Facts]], new: Mapping[str, tuple[str, Facts]], names: Mapping[str, Facts] = {}) -> list[str]:
    """For a closed record's next version: the members for which a document of the old one may be refused."""
    out = [n for n, (kind, _) in new.items() if kind == "required" and (n not in old or old[n][0] != "required")]
    out += [n for n in old if n not in new]
    return sorted(set(out) | {n for n in old.keys() & new.keys() if not subsumes(old[n][1], new[n][1], names)})
