"""Record models: types, members, asserts, and their evaluation to values and diagnostics.

A record type is declared once, in Python, and compiled against a DataFrame of
instances: one select gives the completed values, and one array of guarded reports,
exploded, gives the diagnostics. Nothing is collected, and nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.plans.expr import E, Range, lift, template, whole, wide_literal

Check = Callable[[E], list[tuple[str, Column, object]]]

CODES = {"error": "E6001", "warn": "W6001", "info": "I6001"}


# -- types -----------------------------------------------------------------------


@dataclass(frozen=True)
class Type:
    """name, the kind of its values, and the conditions under which a value is refused."""

    name: str
    kind: str
    checks: tuple[Callable[[Column], Column], ...] = ()
    nullable: bool = False
    message: str | None = None  # an else clause: in place of the general message
    facts: tuple = ()  # what subsumption knows of it, see pactum.plans.subsume
    predicates: tuple[str, ...] = ()  # the names of those among the conditions that facts do not tell

    def refuses(self, v: Column) -> Column:
        out = F.lit(False) if self.nullable else v.isNull()
        for c in self.checks:
            out = out | (v.isNotNull() & F.coalesce(c(v), F.lit(True)))
        return out

    def else_(self, message: str) -> Type:
        return replace(self, message=message)

    def opt(self) -> Type:
        """T?"""
        return replace(self, name=f"{self.name}?", nullable=True, facts=("union", self.facts, ("null",)))

    def where(self, name: str, predicate: Callable[[E], E]) -> Type:
        """T(p): a predicate that fails or errs refuses the value."""
        return replace(self, name=f"{self.name}({name})", predicates=(*self.predicates, name), checks=(*self.checks, lambda v: ~F.coalesce(predicate(E(v, self.kind)).v, F.lit(False))))

    def __and__(self, other: Type) -> Type:
        if self.kind != other.kind:
            raise TypeError(f"E4012: {self.name} & {other.name} is empty")
        return Type(f"{self.name} & {other.name}", self.kind, self.checks + other.checks, self.nullable and other.nullable, self.message or other.message)


def prim(kind: str) -> Type:
    if kind == "float":
        return Type("float", "float", (lambda v: F.isnan(v) | (F.abs(v) == float("inf")),), facts=("prim", "float"))
    return Type(kind, kind, facts=("prim", kind))


def literal(*values) -> Type:
    kind = {bool: "bool", int: "int", float: "float", str: "string"}[type(values[0])]
    return Type(" | ".join(map(repr, values)), kind, (lambda v: ~v.isin(*values),), facts=("lits", frozenset(values)))


def rng(lo, hi, open: bool = False, kind: str = "int") -> Type:
    """lo..hi, or lo..<hi. Also integers of a width: int<N> and uint<N> are ranges. Values beyond 64 bits are of the kind wide, with 38 digits at most."""
    top = hi - 1 if open and kind == "int" else hi
    if kind == "int" and not (-(1 << 63) <= lo and top < 1 << 63):
        least, most = wide_literal(lo), wide_literal(top)
        return Type(f"{lo}..{'<' if open else ''}{hi}", "wide", (lambda v: (v < least) | (v > most),), facts=("range", lo, hi, open, kind))
    return Type(f"{lo}..{'<' if open else ''}{hi}", kind, (lambda v: (v < lo) | ((v >= hi) if open else (v > hi)),), facts=("range", lo, hi, open, kind))


def width(bits: int, signed: bool = True) -> Type:
    return replace(rng(-(1 << bits - 1), (1 << bits - 1) - 1) if signed else rng(0, (1 << bits) - 1), name=f"{'' if signed else 'u'}int<{bits}>")


def pattern(regex: str) -> Type:
    return Type(f"/{regex}/", "string", (lambda v: ~v.rlike(whole(regex)),), facts=("pattern", regex))


def interpolate(regex: str, **parts: Type) -> str:
    """A pattern's text with ${name} holes filled by string-shaped types."""
    for name, t in parts.items():
        kind = t.facts[0]
        if kind == "pattern":
            inner = t.facts[1]
        elif kind == "lits":
            inner = "|".join("".join(f"\\{c}" if c in r"\.[]{}()*+?^$|/-" else c for c in str(x)) for x in sorted(t.facts[1], key=str))
        elif kind == "range" and t.facts[2] - t.facts[1] < 65536:
            inner = "|".join(str(i) for i in range(t.facts[1], t.facts[2] + (not t.facts[3])))
        else:
            raise TypeError(f"E4117: {t.name} does not go into a pattern")
        regex = regex.replace("${" + name + "}", f"(?:{inner})")
    return regex


def array(element: Type, least: int | None = None, most: int | None = None) -> Type:
    sized = () if least is None else (lambda v: (F.size(v) < least) | (F.size(v) > most),)
    return Type(f"{element.name}[{'' if least is None else f'{least}..{most}'}]", "array", (*sized, lambda v: F.exists(v, element.refuses)), facts=("array", element.facts, least, most))


def map_of(key: Type, value: Type) -> Type:
    return Type(f"{{ [{key.name}]: {value.name} }}", "map", (lambda v: F.exists(F.map_entries(v), lambda e: key.refuses(e["key"]) | value.refuses(e["value"])),), facts=("map", key.facts, value.facts))


def generic(name: str, bounds: dict[str, Type | None], build: Callable[..., Type]) -> Callable[..., Type]:
    """A type with parameters: equal arguments give one type, and an argument must lie within its parameter's bound (E4027). Values are arguments, too."""
    made: dict[tuple, Type] = {}

    def apply(**args) -> Type:
        if args.keys() != bounds.keys():
            raise TypeError(f"E4026: {name} takes {sorted(bounds)}")
        for n, bound in bounds.items():
            given = args[n] if isinstance(args[n], Type) else literal(args[n])
            if bound is not None and not narrows(given, bound):
                raise TypeError(f"E4027: {given.name} is not within {bound.name}")
        key = tuple((n, x.name if isinstance(x, Type) else x) for n, x in sorted(args.items()))
        if key not in made:
            made[key] = build(**args)
        return made[key]

    return apply


def one_of(subject: Column, arms: dict[object, Column], default: Column | None = None) -> Column:
    """A discriminated union's routing: by the subject's literal, the arm's condition; no arm refuses."""
    out = F.lit(True) if default is None else default
    for label, cond in arms.items():
        out = F.when(subject == F.lit(label), cond).otherwise(out)
    return out


# -- records ---------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    """kind: required, optional, defaulted, derived or hidden; supplied: the input column, if not its own name."""

    kind: str
    type: Type | None = None
    expr: Callable[[dict[str, E]], object] | None = None
    supplied: str | None = None
    is_absent: Column | None = None


@dataclass(frozen=True)
class Assert:
    """A constraint. What its message or its template's arguments read is worked out only where it fails."""

    name: str
    holds: Callable[[dict[str, E]], E]
    message: object = None  # text, or a function of the members giving an expression
    severity: str = "error"
    when: Callable[[dict[str, E]], E] | None = None
    template: Diagnostic | None = None  # in place of message and severity
    args: Callable[[dict[str, E]], Sequence] = lambda m: ()


@dataclass(frozen=True)
class Diagnostic:
    """A declared diagnostic: its severity, and a text of which only its parameters are in scope."""

    name: str
    text: Callable[..., E]
    severity: str = "error"


REPORT = T.StructType([T.StructField(n, T.StringType()) for n in ("code", "id", "severity", "message", "path")])


@dataclass
class Record:
    name: str
    members: dict[str, Member]
    asserts: Sequence[Assert] = ()
    open: bool = False
    doc: dict = field(default_factory=dict)

    def extend(self, name: str, members: dict[str, Member] | None = None, asserts: Sequence[Assert] = ()) -> Record:
        """P { … }: members are narrowed or added; a kind may only become stricter, and a type must lie below the one that it narrows."""
        order = ["optional", "defaulted", "required", "derived", "hidden"]
        for m, new in (members or {}).items():
            if m not in self.members:
                continue
            old = self.members[m]
            if order.index(new.kind) < order.index(old.kind):
                raise TypeError(f"E4032: {name}.{m} weakens {old.kind} to {new.kind}")
            if old.type is not None and (new.type is None or not narrows(new.type, old.type)):
                raise TypeError(f"E4031: {name}.{m}: {new.type.name if new.type else 'any'} is not within {old.type.name}")
        return Record(name, {**self.members, **(members or {})}, (*self.asserts, *asserts), self.open)

    def __and__(self, other: Record) -> Record:
        """A & B: all members; both types where both have one; closed if either is; the asserts of both."""
        members = dict(self.members)
        for n, m in other.members.items():
            mine = members.get(n)
            if mine is None:
                members[n] = m
            elif mine.type and m.type:
                members[n] = replace(mine if mine.kind == "required" else m, type=mine.type & m.type)
        return Record(f"{self.name} & {other.name}", members, (*self.asserts, *other.asserts), self.open and other.open)

    def order(self) -> list[str]:
        """Members after what they read; a cycle is E4113."""
        return list(self.needs())

    def needs(self) -> dict[str, set[str]]:
        """What each member reads, members after what they read.

        A member is worked out when another one asks for it, so all that it reads is found, whatever it does with it.
        """
        done: dict[str, set[str]] = {}
        path: list[str] = []
        reads: dict[str, set[str]] = {n: set() for n in self.members}
        record = self

        class Asked(dict):
            def __getitem__(self, n: str) -> E:
                if path and n in record.members:
                    reads[path[-1]].add(n)
                return super().__getitem__(n)

            def __missing__(self, n: str) -> E:
                if n not in record.members:
                    raise KeyError(n)
                if n in path:
                    raise ValueError(f"E4113: {' -> '.join([*path[path.index(n) :], n])}")
                path.append(n)
                m = record.members[n]
                kind, dim = m.type.kind if m.type else "any", ()
                if m.expr is not None:
                    e = lift(m.expr(self))
                    kind, dim = e.kind if kind == "any" else kind, e.dim
                path.pop()
                done[n] = reads[n]
                self[n] = E(F.col(f"`{n}`"), kind, F.lit(False) if m.kind == "optional" else None, None, (), dim, frozenset({n}))
                return self[n]

        asked = Asked(self._scope())
        for n in self.members:
            asked[n]
        return done

    def _scope(self) -> dict[str, E]:
        """Names that members may read beside each other: text that stands for the place of the instance."""
        return {n: E(F.lit(""), "string") for n in ("$path", "$key")}

    def compile(self, df: DataFrame, path: Column) -> tuple[DataFrame, dict[str, E], list[Column]]:
        """df with a column for each member that is worked out, the members' expressions, and the reports of binding and evaluation.

        A member that others read is a column of its own, so that its expression is worked out once.
        """
        columns = df.columns
        values: dict[str, E] = {"$path": E(path, "string")}
        reports: list[Column] = []
        own = lambda n: F.concat(path, F.lit(f".{n}"))

        def settle(n: str, e: E) -> None:
            nonlocal df
            made = {f"_v_{n}": e.v} | ({f"_b_{n}": e.is_bad} if e.bad is not None else {}) | ({f"_a_{n}": e.is_absent} if e.absent is not None else {})
            df = df.withColumns(made)
            values[n] = E(F.col(f"_v_{n}"), e.kind, F.col(f"_a_{n}") if e.absent is not None else None, F.col(f"_b_{n}") if e.bad is not None else None, (), e.dim, frozenset({n}))

        def report(code: str | Column, cond: Column, text: object, where: Column, id_: str | None = None, severity: str = "error") -> None:
            message = text if isinstance(text, Column) else F.lit(str(text))
            reports.append(F.when(F.coalesce(cond, F.lit(False)), F.struct((code if isinstance(code, Column) else F.lit(code)).alias("code"), F.lit(id_).cast("string").alias("id"), F.lit(severity).alias("severity"), message.alias("message"), where.alias("path"))))

        for n in self.order():
            m = self.members[n]
            column = m.supplied or n
            given = column in columns
            raw = F.col(column) if given else F.lit(None)
            absent = F.lit(True) if not given else m.is_absent if m.is_absent is not None else raw.isNull()
            wrong = F.lit(False) if m.type is None or not given else ~absent & m.type.refuses(raw)
            kind = m.type.kind if m.type else "any"
            if m.type is not None and given and m.kind != "hidden":
                report("E4001", wrong, m.type.message or f"not a value of {m.type.name}", own(n))
            if m.kind == "required":
                report("E4002", absent, f"missing member {n}", own(n))
                values[n] = E(F.when(~(absent | wrong), raw), kind, None, absent | wrong, (), (), frozenset({n}))
            elif m.kind == "optional":
                values[n] = E(F.when(~(absent | wrong), raw), kind, absent, wrong, (), (), frozenset({n}))
            else:
                e = lift(m.expr(values))
                if e.errors:  # evaluation stops at the first
                    found = F.coalesce(*[F.when(x.when, F.struct(F.lit(x.code).alias("code"), x.message.alias("message"))) for x in e.errors])
                    fires = found.isNotNull() if m.kind != "defaulted" else absent & found.isNotNull()
                    report(found["code"], fires, found["message"], own(n))
                if m.kind == "defaulted":
                    filled = e.guarded(absent)
                    settle(n, E(F.when(absent, filled.v).otherwise(F.when(~wrong, raw)), kind if kind != "any" else e.kind, None, wrong | filled.is_bad, (), e.dim))
                    continue
                if given and m.kind == "derived":
                    report("E4005", ~absent & ~e.is_bad & ~wrong & ~raw.eqNullSafe(e.v), "restated value differs", own(n))
                if given and m.kind == "hidden":
                    report("E4006", ~absent, f"hidden member {n} supplied", own(n))
                if m.type is not None:
                    out = ~e.is_bad & m.type.refuses(e.v)
                    report("E4001", out, m.type.message or f"not a value of {m.type.name}", own(n))
                    e = E(F.when(~out, e.v), e.kind, None, e.is_bad | out, (), e.dim, e.reads)
                settle(n, e)
        return df, values, reports

    def evaluate(self, df: DataFrame, path: Column, keep: Sequence[str] = ()) -> DataFrame:
        """Completed values: `keep`, then every member that is not hidden; a bad or absent one is null."""
        df, values, _ = self.compile(df, path)
        return df.select(*keep, *[values[n].v.alias(n) for n, m in self.members.items() if m.kind != "hidden"])

    def update(self, df: DataFrame, changes: dict[str, object], path: Column, keep: Sequence[str] = ()) -> DataFrame:
        """base with { … }: the instances of df with settable members replaced; derived and hidden ones are worked out again.

        changes: for each member a value, or a function of the base's members.
        """
        settable = [n for n, m in self.members.items() if m.kind in ("required", "optional", "defaulted")]
        if wrong := sorted(changes.keys() - set(settable)):
            raise TypeError(f"E4034: {wrong} cannot be set")
        done, values, _ = self.compile(df, path)
        new = {n: lift(f(values) if callable(f) else f) for n, f in changes.items()}
        base = done.select(*keep, path.alias("_path"), *[new.get(n, values[n]).v.alias(n) for n in settable])
        plain = replace(self, members={n: replace(m, supplied=None, is_absent=None) for n, m in self.members.items()})
        return plain.evaluate(base, F.col("_path"), keep)

    def diagnostics(self, df: DataFrame, path: Column, unknown: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """A row for each report. unknown: an array of undeclared member names, refused by a closed record."""
        df, values, reports = self.compile(df, path)
        for a in self.asserts:
            guard = a.when(values) if a.when else None
            cond = a.holds(values)
            fires = ~cond.is_bad & ~cond.is_absent & ~F.coalesce(cond.v, F.lit(True))
            ready = F.lit(True)
            if guard is not None:
                ready = ~guard.is_bad & F.coalesce(guard.v, F.lit(False))
            severity = a.template.severity if a.template else a.severity
            if a.template:
                text = a.template.text(*[lift(x) for x in a.args(values)]).v
            else:
                text = a.message(values).v if callable(a.message) else F.lit(a.message or f"{a.name} does not hold")
            entry = lambda code, t, sev: F.struct(F.lit(code).alias("code"), F.lit(f"{self.name}.{a.name}").alias("id"), F.lit(sev).alias("severity"), t.alias("message"), path.alias("path"))  # noqa: B023, E731
            reports.append(F.when(F.coalesce(ready & fires, F.lit(False)), entry(CODES[severity], text, severity)))
            if cond.errors:
                reports.append(F.coalesce(*[F.when(F.coalesce(ready & x.when, F.lit(False)), entry(x.code, x.message, "error").cast(REPORT)) for x in cond.errors]))
        found = F.filter(F.array(*[r.cast(REPORT) for r in reports]), lambda r: r.isNotNull())
        if unknown is not None and not self.open:
            extra = F.transform(F.array_except(unknown, F.array(*[F.lit(n) for n in self.members])), lambda n: F.struct(F.lit("E4003").alias("code"), F.lit(None).cast("string").alias("id"), F.lit("error").alias("severity"), F.concat(F.lit("undeclared member "), n).alias("message"), F.concat(path, F.lit("."), n).alias("path")).cast(REPORT))
            found = F.concat(found, extra)
        return df.select(*keep, F.posexplode(found).alias("seq", "r")).select(*keep, "r.*", "seq")


def narrows(new: Type, old: Type) -> bool:
    """Whether every value of new is one of old, by their facts; where those do not tell, by kind and by the checks that new has kept."""
    from pactum.plans import subsume

    if new.facts and old.facts:
        return subsume.subsumes(new.facts, old.facts) and set(old.predicates) <= set(new.predicates)
    return new.kind == old.kind and (new.nullable <= old.nullable) and set(old.checks) <= set(new.checks)


def in_order(diagnostics: DataFrame) -> DataFrame:
    """Reports by path, then id, then the order in which their rules stand."""
    from pactum.operators.paths import path_key

    return diagnostics.orderBy(path_key(F.col("path")), F.col("id").asc_nulls_first(), "seq")


def numbered(diagnostics: DataFrame, name: str = "n") -> DataFrame:
    """Reports in order, with their place from 1 on: ranges are sorted side by side, and each adds the number of reports in those before it."""
    from pactum.storage import materialize

    local = in_order(diagnostics).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    done = materialize(local, "reports")
    sizes = sorted((r._part, r["count"]) for r in done.groupBy("_part").count().collect())  # one for each range
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    before = done.sparkSession.createDataFrame(starts, "_part int, _before long")
    return done.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def unique(df: DataFrame, by: Sequence[str], id_: str, path: Column) -> DataFrame:
    """A report for each value of `by` that several rows have: by, n, code, id, severity, message and the path that stands first."""
    found = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(path).alias("path")).filter("n > 1")
    return found.withColumns({"code": F.lit("E6001"), "id": F.lit(id_), "severity": F.lit("error"), "message": F.concat(F.col("n").cast("string"), F.lit(f" values of {', '.join(by)}"))})


__all__ = ["Assert", "Diagnostic", "Member", "Range", "Record", "Type", "array", "generic", "in_order", "interpolate", "literal", "map_of", "narrows", "numbered", "one_of", "pattern", "prim", "rng", "template", "unique", "width"]
