"""The standard functions: arrays, mathematics, numbers, strings, maps and objects.

Each takes and gives expressions. A call outside a function's domain is error E5008.
Arrays keep their order; lambdas get and give expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactum.plans.expr import BEYOND, LIMIT, E, finite, lift, text_of

Fn = Callable[[E], E]


def _column(f: Fn, kind: str) -> Callable[[Column], Column]:
    return lambda x: lift(f(E(x, kind))).v


def map_(xs: E, f: Fn, kind: str = "any") -> E:
    """[f(x) for x in xs]"""
    return xs._with(F.transform(xs.v, _column(f, kind)), "array")


def filter_(xs: E, p: Fn, kind: str = "any") -> E:
    return xs._with(F.filter(xs.v, _column(p, kind)), "array")


def flat_map(xs: E, f: Fn, kind: str = "any") -> E:
    return xs._with(F.flatten(F.transform(xs.v, _column(f, kind))), "array")


def count(xs: E) -> E:
    return xs._with(F.size(xs.v).cast("long"), "int")


def sum_(xs: E, kind: str) -> E:
    """From left to right; the sum of nothing is a zero of the kind. Integers beyond 64 bits are an error."""
    if kind == "float":
        v = F.aggregate(xs.v, F.lit(0.0), lambda a, x: a + x)
        return xs._with(v, "float", fail=[("E5002", ~finite(v), "not finite")])
    v = F.aggregate(xs.v, F.lit(0).cast("long"), lambda a, x: F.try_add(a, x.cast("long")))
    return xs._with(v, "int", fail=[(LIMIT, v.isNull(), BEYOND)])


def fold(xs: E, init, f: Callable[[E, E], E], kind: str = "any", acc: str | None = None) -> E:
    start = lift(init)
    k = acc or start.kind
    return xs._with(F.aggregate(xs.v, start.v, lambda a, x: lift(f(E(a, k), E(x, kind))).v), k, start)


def all_(xs: E, p: Fn, kind: str = "any") -> E:
    return xs._with(F.forall(xs.v, _column(p, kind)), "bool")


def any_(xs: E, p: Fn, kind: str = "any") -> E:
    return xs._with(F.exists(xs.v, _column(p, kind)), "bool")


def all_distinct(xs: E) -> E:
    return xs._with(F.size(F.array_distinct(xs.v)) == F.size(xs.v), "bool")


def unique(xs: E) -> E:
    """First occurrences, in order."""
    return xs._with(F.array_distinct(xs.v), "array")


def sort(xs: E) -> E:
    """Ascending, strings by code point."""
    return xs._with(F.sort_array(xs.v), "array")


def sort_by(xs: E, key: Fn, kind: str = "any") -> E:
    """Stable: equal keys keep their order."""
    keyed = F.transform(xs.v, lambda x, i: F.struct(lift(key(E(x, kind))).v.alias("k"), i.alias("i"), x.alias("x")))
    return xs._with(F.transform(F.sort_array(keyed), lambda s: s["x"]), "array")


def reverse(xs: E) -> E:
    return xs._with(F.reverse(xs.v), "array")


# -- mathematics ---------------------------------------------------------------


def abs_(x: E) -> E:
    if x.kind == "int":
        least = x.v.cast("long") == F.lit(-(1 << 63))
        return x._with(F.when(~least, F.abs(F.when(~least, x.v.cast("long")))), "int", fail=[(LIMIT, least, BEYOND)])
    return x._with(F.abs(x.v), x.kind)


def _same(a: E, b) -> tuple[E, E]:
    o = lift(b)
    if a.kind != o.kind:
        raise TypeError(f"E4020: {a.kind} and {o.kind}")
    return a, o


def min_(a: E, b) -> E:
    a, o = _same(a, b)
    return a._with(F.least(a.v, o.v), a.kind, o)


def max_(a: E, b) -> E:
    a, o = _same(a, b)
    return a._with(F.greatest(a.v, o.v), a.kind, o)


def clog2(n: E) -> E:
    """The least k with 2**k >= n."""
    v = n.v.cast("long")
    return n._with(F.when(v == 1, F.lit(0)).otherwise(F.length(F.bin(F.greatest(v, F.lit(2)) - 1))).cast("long"), "int", fail=[("E5008", v < 1, "clog2 of less than one")])


_MOST = float(1 << 63)


def _whole(x: E, c: Column) -> E:
    fits = (c < _MOST) & (c >= -_MOST)
    return x._with(F.when(fits, c).cast("long"), "int", fail=[(LIMIT, ~fits, BEYOND)])


def floor(x: E) -> E:
    return _whole(x, F.floor(x.v).cast("double"))


def ceil(x: E) -> E:
    return _whole(x, F.ceil(x.v).cast("double"))


def round_(x: E) -> E:
    """Ties go to the even number."""
    return _whole(x, F.rint(x.v))


def int_of(x: E) -> E:
    """Exact: a fraction is outside its domain."""
    v = x.v.cast("double")
    good = (F.rint(v) == v) & (v < _MOST) & (v >= -_MOST)
    return x._with(F.when(good, v).cast("long"), "int", fail=[("E5008", ~good, "not an integer")])


def at_least(n) -> Fn:
    return lambda x: x >= n


def at_most(n) -> Fn:
    return lambda x: x <= n


def float_of(n: E) -> E:
    return n._with(n.v.cast("double"), "float")


# -- strings -------------------------------------------------------------------


def string_of(v: E) -> E:
    return v._with(text_of(v), "string")


def length(s: E) -> E:
    return s._with(F.char_length(s.v).cast("long"), "int")


def join(xs: E, sep: str) -> E:
    return xs._with(F.array_join(xs.v, sep), "string")


def starts_with(s: E, t) -> E:
    o = lift(t)
    return s._with(F.startswith(s.v, o.v), "bool", o)


def ends_with(s: E, t) -> E:
    o = lift(t)
    return s._with(F.endswith(s.v, o.v), "bool", o)


def contains(s: E, t) -> E:
    o = lift(t)
    return s._with(F.contains(s.v, o.v), "bool", o)


def split(s: E, sep) -> E:
    """By a literal separator; empty parts stay."""
    if isinstance(sep, str) and sep:
        return s._with(F.split(s.v, "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1), "array")
    o = lift(sep)
    quoted = F.concat(F.lit("\\Q"), F.regexp_replace(o.v, r"\\E", r"\\E\\\\E\\Q"), F.lit("\\E"))
    return s._with(F.when(o.v != "", F.split(s.v, quoted, -1)), "array", o, fail=[("E5008", o.v == "", "empty separator")])


# -- maps and objects ----------------------------------------------------------


def keys(m: E) -> E:
    return m._with(F.map_keys(m.v), "array")


def values(m: E) -> E:
    return m._with(F.map_values(m.v), "array")


def entries(m: E) -> E:
    return m._with(F.map_entries(m.v), "array")


def merge(base: dict[str, E | dict], patch: dict[str, E | dict]) -> dict[str, E | dict]:
    """Deep: records merge member by member; else the patch wins whole where it is there, and its null is a value."""
    out = dict(base)
    for name, p in patch.items():
        b = base.get(name)
        if isinstance(b, dict) and isinstance(p, dict):
            out[name] = merge(b, p)
        elif b is None or isinstance(b, dict) or isinstance(p, dict):
            out[name] = p
        else:
            out[name] = E(F.when(p.is_absent, b.v).otherwise(p.v), p.kind if p.kind != "any" else b.kind, None if b.absent is None else p.is_absent & b.absent, None, p.errors + b.errors, p.dim, p.reads | b.reads)
    return out


def concat(*parts) -> E:
    """[...a, x]: arrays are spliced, other values become elements."""
    es = [lift(p) for p in parts]
    arrays = [e.v if e.kind == "array" else F.array(e.v) for e in es]
    return es[0]._with(F.concat(*arrays), "array", *es[1:])


def spread(*parts: dict[str, E]) -> dict[str, E]:
    """{...a, ...b}: a member given twice is an error of the plan."""
    out: dict[str, E] = {}
    for p in parts:
        if twice := out.keys() & p.keys():
            raise ValueError(f"E5004: {sorted(twice)} given twice")
        out |= p
    return out


def record(members: dict[str, E | dict]) -> E:
    """A record value of its present members, in order."""
    cols = [(record(m).v if isinstance(m, dict) else m.v).alias(n) for n, m in members.items()]
    return E(F.struct(*cols), "record", reads=frozenset().union(*(m.reads for m in members.values() if isinstance(m, E))))
