"""Typed expressions that compile to Column bundles.

An expression carries its value and three conditions: `absent` (no value was given;
null is a value), `bad` (no value can be given), and its own `errors`, each a code, a
condition and a message. An error fires only where no operand is bad, so one defect
makes one report; what depends on a bad value is bad in silence. Every partial
operation is guarded inside a conditional, because Spark promises no order of
evaluation; branches conjoin their guard to the errors below them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A result that this engine cannot hold. It is no code of the language, whose integers have no bound.
LIMIT = "LIMIT"
BEYOND = "integer beyond 64 bits: declare a range that needs more"
#: Columns of integers by kind. A wide one is an int of up to 38 digits; int and wide give wide.
INTEGERS = {"int": "bigint", "wide": "decimal(38,0)"}


@dataclass(frozen=True)
class Error:
    code: str
    when: Column
    message: Column


def _or(*parts: Column | None) -> Column | None:
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out | p
    return out


def _and(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


def _false(c: Column | None) -> Column:
    return F.lit(False) if c is None else F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class E:
    """kind: int, wide, float, string, bool, array, map, record, range, quantity or any; dim: a quantity's exponents."""

    v: Column
    kind: str = "any"
    absent: Column | None = None
    bad: Column | None = None
    errors: tuple[Error, ...] = ()
    dim: tuple[tuple[str, int], ...] = ()
    reads: frozenset[str] = frozenset()
    parts: tuple = field(default=(), compare=False)

    # -- building ------------------------------------------------------------

    def _with(self, v: Column, kind: str, *others: E, fail: Sequence[tuple[str, Column, str]] = (), dim=()) -> E:
        """An expression of value v over self and others; fail: own errors, tested where no operand is bad."""
        operands = (self, *others)
        if unsure := [o for o in operands if o.absent is not None]:
            raise TypeError(f"E4050: {sorted(set().union(*(o.reads for o in unsure)))} may be absent: test it with present() and read it with known(), or use else_()")
        missing = _or(*[_or(o.bad, o.absent) for o in operands])
        own = [Error(code, ~_false(missing) & F.coalesce(cond, F.lit(False)), F.lit(text)) for code, cond, text in fail]
        bad = _or(missing, *[e.when for e in own])
        value = v if bad is None else F.when(~_false(bad), v)
        return E(value, kind, None, bad, tuple(e for o in operands for e in o.errors) + tuple(own), dim, frozenset().union(*(o.reads for o in operands)))

    def guarded(self, guard: Column) -> E:
        """self where guard holds; elsewhere its errors do not fire and it is not bad."""
        g = F.coalesce(guard, F.lit(False))
        return E(F.when(g, self.v), self.kind, self.absent, None if self.bad is None else g & self.bad, tuple(Error(e.code, g & e.when, e.message) for e in self.errors), self.dim, self.reads)

    @property
    def is_bad(self) -> Column:
        return _false(self.bad)

    @property
    def is_absent(self) -> Column:
        return _false(self.absent)

    @property
    def code(self) -> Column:
        """The code of the error that fires, or null."""
        return F.coalesce(*[F.when(e.when, F.lit(e.code)) for e in self.errors]) if self.errors else F.lit(None).cast("string")

    # -- arithmetic ----------------------------------------------------------

    def _arith(self, other, op: str) -> E:
        o = lift(other)
        if {self.kind, o.kind} & {"quantity"}:
            return _quantity(self, o, op)
        if self.kind == o.kind == "string" and op == "+":
            return self._with(F.concat(self.v, o.v), "string", o)
        if (kind := _integer(self, o)) is not None:
            a, b = (x.v.cast(INTEGERS[kind]) for x in (self, o))
            v = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b).cast(INTEGERS[kind])
            return self._with(v, kind, o, fail=[(LIMIT, a.isNotNull() & b.isNotNull() & v.isNull(), _beyond(kind))])
        if self.kind != o.kind or self.kind != "float":
            raise TypeError(f"E4020: {self.kind} {op} {o.kind}")
        v = {"+": self.v + o.v, "-": self.v - o.v, "*": self.v * o.v}[op]
        return self._with(v, "float", o, fail=[("E5002", ~finite(v), "not finite")])

    def __add__(self, o): return self._arith(o, "+")  # noqa: E704
    def __sub__(self, o): return self._arith(o, "-")  # noqa: E704
    def __mul__(self, o): return self._arith(o, "*")  # noqa: E704
    def __radd__(self, o): return lift(o) + self  # noqa: E704
    def __rsub__(self, o): return lift(o) - self  # noqa: E704
    def __rmul__(self, o): return lift(o) * self  # noqa: E704

    def __truediv__(self, other) -> E:
        """Integers: toward zero. Floats: must stay finite."""
        o = lift(other)
        if "quantity" in (self.kind, o.kind):
            return _quantity(self, o, "/")
        zero = ("E5001", o.v == 0, "division by zero")
        if self.kind == o.kind == "int":
            a, b = self.v.cast("long"), F.nullif(o.v.cast("long"), F.lit(0).cast("long"))
            least = (a == F.lit(-(1 << 63))) & (b == -1)
            return self._with(F.when(~least, F.call_function("div", a, b)), "int", o, fail=[zero, (LIMIT, least, BEYOND)])
        if _integer(self, o):  # what is left without the remainder is divided exactly
            a, b = self.v.cast(INTEGERS["wide"]), F.nullif(o.v.cast(INTEGERS["wide"]), F.lit(0).cast(INTEGERS["wide"]))
            v = F.when(F.abs(b) == 1, a * b).otherwise(F.try_divide(a - a % b, b)).cast(INTEGERS["wide"])
            return self._with(v, "wide", o, fail=[zero, (LIMIT, a.isNotNull() & b.isNotNull() & v.isNull(), _beyond("wide"))])
        if self.kind != o.kind or self.kind != "float":
            raise TypeError(f"E4020: {self.kind} / {o.kind}")
        v = self.v / F.nullif(o.v, F.lit(0.0))
        return self._with(v, "float", o, fail=[zero, ("E5002", ~finite(v), "not finite")])

    def __mod__(self, other) -> E:
        """The sign of the dividend; integers only."""
        o = lift(other)
        kind = _integer(self, o)
        if kind is None:
            raise TypeError(f"E4020: {self.kind} % {o.kind}")
        t = INTEGERS[kind]
        return self._with((self.v.cast(t) % F.nullif(o.v.cast(t), F.lit(0).cast(t))).cast(t), kind, o, fail=[("E5001", o.v == 0, "division by zero")])

    def __neg__(self) -> E:
        if self.kind in INTEGERS:
            return lift(0) - self
        return self._with(-self.v, self.kind, dim=self.dim)

    def __invert__(self) -> E:
        """! on a bool, ~ on an int."""
        if self.kind == "wide":
            return lift(-1) - self
        return self._with(~self.v, "bool") if self.kind == "bool" else self._with(F.bitwise_not(self.v.cast("long")), "int")

    def bits(self, op: str, other) -> E:
        o = lift(other)
        if "wide" in (self.kind, o.kind):
            raise TypeError(f"{LIMIT}: {op} of integers beyond 64 bits")
        a, b = self.v.cast("long"), o.v.cast("long")
        return self._with({"&": a.bitwiseAND, "|": a.bitwiseOR, "^": a.bitwiseXOR}[op](b), "int", o)

    def __lshift__(self, other) -> E:
        """n times two to the power k, exactly."""
        o = lift(other)
        if "wide" in (self.kind, o.kind):
            raise TypeError(f"{LIMIT}: a shift of integers beyond 64 bits")
        a, k = self.v.cast("long"), o.v.cast("int")
        v = F.when(a == 0, F.lit(0).cast("long")).when((k >= 0) & (k < 63), F.try_multiply(a, F.element_at(F.array(*[F.lit(1 << i) for i in range(63)]).cast("array<bigint>"), F.least(F.greatest(k, F.lit(0)), F.lit(62)) + 1)))
        return self._with(v, "int", o, fail=[("E5003", o.v < 0, "negative shift"), (LIMIT, (o.v >= 0) & v.isNull(), BEYOND)])

    def __rshift__(self, other) -> E:
        """Rounds down."""
        o = lift(other)
        if "wide" in (self.kind, o.kind):
            raise TypeError(f"{LIMIT}: a shift of integers beyond 64 bits")
        a, k = self.v.cast("long"), F.least(F.greatest(o.v.cast("int"), F.lit(0)), F.lit(63))
        return self._with(F.call_function("shiftright", a, k), "int", o, fail=[("E5003", o.v < 0, "negative shift")])

    def wide(self) -> E:
        """An int as one of up to 38 digits."""
        return self._with(self.v.cast(INTEGERS["wide"]), "wide")

    # -- comparison ----------------------------------------------------------

    def _compare(self, other, op: str) -> E:
        o = lift(other)
        if not _integer(self, o) and (self.kind != o.kind or self.kind not in ("float", "string", "quantity")) or self.dim != o.dim:
            raise TypeError(f"{'E4072' if self.kind == o.kind == 'quantity' else 'E4020'}: {self.kind} {op} {o.kind}")
        v = {"<": self.v < o.v, "<=": self.v <= o.v, ">": self.v > o.v, ">=": self.v >= o.v}[op]
        return self._with(v, "bool", o)

    def __lt__(self, o): return self._compare(o, "<")  # noqa: E704
    def __le__(self, o): return self._compare(o, "<=")  # noqa: E704
    def __gt__(self, o): return self._compare(o, ">")  # noqa: E704
    def __ge__(self, o): return self._compare(o, ">=")  # noqa: E704

    def __eq__(self, other) -> E:  # type: ignore[override]
        """Structural equality; null equals null. Maps are equal whatever the order of their entries."""
        o = lift(other)
        if self.kind == "map":
            entries = lambda m: F.array_sort(F.map_entries(m))
            return self._with(entries(self.v).eqNullSafe(entries(o.v)), "bool", o)
        return self._with(self.v.eqNullSafe(o.v), "bool", o)

    def __ne__(self, other) -> E:  # type: ignore[override]
        return ~(self == other)

    __hash__ = None  # type: ignore[assignment]

    def is_in(self, collection) -> E:
        """In an array, a range (inclusive pair, or Range), or the keys of a map."""
        if isinstance(collection, Range):
            upper = self.v < collection.hi.v if collection.open else self.v <= collection.hi.v
            return self._with((self.v >= collection.lo.v) & upper, "bool", collection.lo, collection.hi)
        o = lift(collection)
        if o.kind == "map":
            return self._with(F.coalesce(F.map_contains_key(o.v, self.v), F.lit(False)), "bool", o)
        return self._with(F.exists(o.v, lambda x: x.eqNullSafe(self.v)), "bool", o)

    def present(self) -> E:
        """Whether an optional member has a value (null is one)."""
        return E(~self.is_absent & ~self.is_bad, "bool", None, self.bad, self.errors, (), self.reads)

    def known(self) -> E:
        """self where a test has shown that it is present; elsewhere it is bad, which the test's guard keeps silent."""
        return E(self.v, self.kind, None, _or(self.bad, self.absent), self.errors, self.dim, self.reads)

    def matches(self, pattern: str) -> E:
        return self._with(self.v.rlike(whole(pattern)), "bool")

    # -- control -------------------------------------------------------------

    def and_(self, other) -> E:
        o = lift(other).guarded(~self.is_bad & F.coalesce(self.v, F.lit(False)))
        v = F.when(~self.v, F.lit(False)).otherwise(o.v)
        return E(v, "bool", None, _or(self.bad, o.bad), self.errors + o.errors, (), self.reads | o.reads)

    def or_(self, other) -> E:
        o = lift(other).guarded(~self.is_bad & ~F.coalesce(self.v, F.lit(True)))
        v = F.when(self.v, F.lit(True)).otherwise(o.v)
        return E(v, "bool", None, _or(self.bad, o.bad), self.errors + o.errors, (), self.reads | o.reads)

    def else_(self, other) -> E:
        """a ?? b: b where a is absent or null."""
        none = ~self.is_bad & (self.is_absent | self.v.isNull())
        o = lift(other).guarded(none)
        return E(F.coalesce(self.v, o.v), o.kind if self.kind == "any" else self.kind, _and(self.absent, o.absent), _or(self.bad, o.bad), self.errors + o.errors, self.dim, self.reads | o.reads)

    def pipe(self, f: Callable[..., E], *args) -> E:
        """x |> f(a): self becomes the first argument."""
        return f(self, *args)

    # -- access --------------------------------------------------------------

    def get(self, name: str, kind: str = "any") -> E:
        """e.m, which reads null through a null or absent record as e?.m does."""
        return E(self.v[name], kind, self.absent, self.bad, self.errors, (), self.reads)

    def at(self, index, kind: str = "any") -> E:
        """xs[i] fails beyond the array; m[k] is absent where the key is."""
        o = lift(index)
        if self.kind == "map":
            found = E(F.try_element_at(self.v, o.v), kind, ~F.coalesce(F.map_contains_key(self.v, o.v), F.lit(False)), _or(self.bad, o.bad), self.errors + o.errors, (), self.reads | o.reads)
            return found
        i = o.v.cast("int")
        return self._with(F.get(self.v, i), kind, o, fail=[("E5005", (i < 0) | (i >= F.size(self.v)), "index out of bounds")])


@dataclass(frozen=True)
class Range:
    lo: E
    hi: E
    open: bool = False

    def values(self) -> E:
        """The integers of the range, in order; none if it is empty."""
        top = self.hi.v.cast("long") - (1 if self.open else 0)
        low = self.lo.v.cast("long")
        return self.lo._with(F.when(low <= top, F.sequence(low, F.greatest(low, top))).otherwise(F.array().cast("array<bigint>")), "array", self.hi)


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def whole(pattern: str) -> str:
    r"""A pattern of the portable core that must match the whole text: \z, as $ would match before a last line end."""
    return rf"^(?:{pattern})\z"


_KINDS = {bool: "bool", int: "int", float: "float", str: "string"}


def _integer(a: E, b: E) -> str | None:
    """The kind of integers that a and b give, if both are integers."""
    kinds = {a.kind, b.kind}
    return None if not kinds <= INTEGERS.keys() else "wide" if "wide" in kinds else "int"


def _beyond(kind: str) -> str:
    return BEYOND if kind == "int" else "integer beyond 38 digits"


def wide_literal(x: int) -> Column:
    if abs(x) >= 10**38:
        raise OverflowError(f"{LIMIT}: {x} has more than 38 digits")
    return F.lit(str(x)).cast(INTEGERS["wide"])


def lift(x) -> E:
    """A Python value as an expression."""
    if isinstance(x, E):
        return x
    if x is None:
        return E(F.lit(None), "any")
    if isinstance(x, list | tuple):
        kinds = {_KINDS[type(i)] for i in x}
        return E(F.array(*[F.lit(i) if _KINDS[type(i)] != "int" else F.lit(i).cast("long") for i in x]), "array") if len(kinds) <= 1 else _mixed(kinds)
    kind = _KINDS[type(x)]
    if kind == "int" and not -(1 << 63) <= x < 1 << 63:
        return E(wide_literal(x), "wide")
    return E(F.lit(x).cast("long") if kind == "int" else F.lit(x), kind)


def _mixed(kinds):
    raise TypeError(f"E4020: an array of {sorted(kinds)}")


def col(name: str, kind: str) -> E:
    """A member that is always there."""
    return E(F.col(name), kind, reads=frozenset({name}))


def optional(name: str, kind: str, absent: Column | None = None) -> E:
    """A member that is absent where the condition holds; without one, where its column is null."""
    return E(F.col(name), kind, F.col(name).isNull() if absent is None else absent, reads=frozenset({name}))


def if_(cond, then, other) -> E:
    """Only the branch taken can fail."""
    c = lift(cond)
    yes = lift(then).guarded(~c.is_bad & F.coalesce(c.v, F.lit(False)))
    no = lift(other).guarded(~c.is_bad & ~F.coalesce(c.v, F.lit(True)))
    absent = _or(None if yes.absent is None else c.v & yes.absent, None if no.absent is None else ~c.v & no.absent)
    bad = _or(c.bad, yes.bad, no.bad)
    v = F.when(c.v, yes.v).otherwise(no.v)
    return E(v if bad is None else F.when(~_false(bad), v), yes.kind if yes.kind != "any" else no.kind, absent, bad, c.errors + yes.errors + no.errors, yes.dim, c.reads | yes.reads | no.reads)


def match(subject, arms: Sequence[tuple[object, object]], default=None) -> E:
    """Arms of (literal or literals, result), tried in order; without a default the arms must cover the subject."""
    s = lift(subject)
    known: set = set()
    out = None if default is None else lift(default)
    for labels, result in reversed(list(arms)):
        labels = labels if isinstance(labels, list | tuple | set) else [labels]
        if known & set(labels):
            raise ValueError(f"E4101: arms overlap at {sorted(known & set(labels))}")
        known |= set(labels)
        here = lift(result)
        out = here.guarded(s.v.isin(*labels)) if out is None else if_(E(s.v.isin(*labels), "bool", None, s.bad, (), (), s.reads), here, out)
    return out._with(out.v, out.kind, s) if out.bad is None else E(out.v, out.kind, out.absent, _or(out.bad, s.bad), s.errors + out.errors, out.dim, s.reads | out.reads)


def template(*parts) -> E:
    """A string template: strings, integers, floats and bools in one text."""
    es = [lift(p) for p in parts]
    texts = [text_of(e) for e in es]
    return es[0]._with(F.concat(*texts), "string", *es[1:])


def text_of(e: E) -> Column:
    if e.kind == "float":
        return float_text(e.v)
    return e.v.cast("string")


def float_text(c: Column) -> Column:
    """A double as text: the shortest digits that read back, plain between 1e-6 and 1e21, and .0 on whole numbers."""
    spelt = c.cast("string")
    digits = F.regexp_replace(F.regexp_extract(spelt, r"^-?([0-9.]+)E", 1), r"\.|0+$", "")
    power = F.regexp_extract(spelt, r"E(-?[0-9]+)$", 1).try_cast("int")
    sign = F.when(c < 0, "-").otherwise("")
    count = F.length(digits)
    large = F.when(count <= power + 1, F.concat(F.rpad(digits, power + 1, "0"), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, count)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    spread = F.concat(digits.substr(F.lit(1), F.lit(1)), F.when(count > 1, F.concat(F.lit("."), digits.substr(F.lit(2), count))).otherwise(""), F.lit("e"), F.when(power > 0, "+").otherwise(""), power.cast("string"))
    moved = F.when((power >= 0) & (power < 21), large).when((power < 0) & (power >= -6), small).otherwise(spread)
    return F.when(c == 0, F.when(spelt.startswith("-"), "-0.0").otherwise("0.0")).when(spelt.contains("E"), F.concat(sign, moved)).otherwise(spelt)


# -- quantities --------------------------------------------------------------


def _quantity(a: E, b: E, op: str) -> E:
    """Dimensions are added, subtracted or compared at plan time; an empty one leaves a float."""
    if op in "+-":
        if a.dim != b.dim or a.kind != b.kind:
            raise TypeError(f"E4072: {dict(a.dim)} {op} {dict(b.dim)}")
        v = a.v + b.v if op == "+" else a.v - b.v
        return a._with(v, "quantity", b, fail=[("E5002", ~finite(v), "not finite")], dim=a.dim)
    sign = 1 if op == "*" else -1
    powers = dict(a.dim)
    for d, n in b.dim:
        powers[d] = powers.get(d, 0) + sign * n
    dim = tuple(sorted((d, n) for d, n in powers.items() if n))
    left, right = a.v.cast("double"), b.v.cast("double")
    v = left * right if op == "*" else left / F.nullif(right, F.lit(0.0))
    fail = [("E5002", ~finite(v), "not finite")]
    if op == "/":
        fail.insert(0, ("E5001", right == 0, "division by zero"))
    return a._with(v, "quantity" if dim else "float", b, fail=fail, dim=dim)
