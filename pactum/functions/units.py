"""Dimensions, units and their catalogue.

A dimension is a set of base dimensions with exponents; a unit is a factor to its
dimension's base unit. Quantities are doubles in base units; the dimension is known
at plan time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.plans.expr import E, finite

# The twenty SI prefixes, base units and named units, and the binary ones.
PREFIXES = {"y": -24, "z": -21, "a": -18, "f": -15, "p": -12, "n": -9, "u": -6, "m": -3, "c": -2, "d": -1, "da": 1, "h": 2, "k": 3, "M": 6, "G": 9, "T": 12, "P": 15, "E": 18, "Z": 21, "Y": 24}
BASE = {"s": "Time", "m": "Length", "kg": "Mass", "A": "Current", "K": "Temperature", "mol": "Amount", "cd": "LuminousIntensity"}
NAMED = {
    "Hz": {"Time": -1},
    "N": {"Mass": 1, "Length": 1, "Time": -2},
    "Pa": {"Mass": 1, "Length": -1, "Time": -2},
    "J": {"Mass": 1, "Length": 2, "Time": -2},
    "W": {"Mass": 1, "Length": 2, "Time": -3},
    "C": {"Current": 1, "Time": 1},
    "V": {"Mass": 1, "Length": 2, "Time": -3, "Current": -1},
    "Ohm": {"Mass": 1, "Length": 2, "Time": -3, "Current": -2},
    "F": {"Mass": -1, "Length": -2, "Time": 4, "Current": 2},
}
BINARY = {"Ki": 1, "Mi": 2, "Gi": 3, "Ti": 4, "Pi": 5, "Ei": 6}
BYTES = {"k": 3, "M": 6, "G": 9, "T": 12, "P": 15, "E": 18}

Dim = tuple[tuple[str, int], ...]


def dimension(**powers: int) -> Dim:
    return tuple(sorted((d, n) for d, n in powers.items() if n))


def catalogue() -> dict[str, tuple[Dim, float]]:
    """symbol -> (dimension, factor to the base unit), from the prefixes' rule."""
    out: dict[str, tuple[Dim, float]] = {s: (((d, 1),), 1.0) for s, d in BASE.items()}
    out["g"] = (((("Mass", 1),)), 1e-3)
    out |= {s: (dimension(**p), 1.0) for s, p in NAMED.items()}
    for symbol in [s for s in out if s != "kg"]:
        dim, factor = out[symbol]
        for prefix, power in PREFIXES.items():
            # a base or named symbol never gives way to a prefixed one
            out.setdefault(prefix + symbol, (dim, float(f"1e{power}") * factor))
    data = (("DataSize", 1),)
    for symbol, bits in (("bit", 1.0), ("B", 8.0)):
        out[symbol] = (data, bits)
        out |= {p + symbol: (data, bits * 1024.0**n) for p, n in BINARY.items()}
        out |= {p + symbol: (data, bits * 10.0**n) for p, n in BYTES.items()}
    return out


def table(spark: SparkSession) -> DataFrame:
    """The catalogue as (symbol, dimension, factor): a few hundred rows."""
    rows = [(s, " ".join(f"{d}^{n}" for d, n in dim), f) for s, (dim, f) in sorted(catalogue().items())]
    return spark.createDataFrame(rows, "symbol string, dimension string, factor double")


def unit(number: float, symbol: str) -> E:
    """10ms: a literal in base units."""
    dim, factor = catalogue()[symbol]
    return E(F.lit(float(number) * factor), "quantity", dim=dim)


def quantity(value: E, symbol: str) -> E:
    """A number of units as a quantity in base units."""
    dim, factor = catalogue()[symbol]
    v = value.v.cast("double") * F.lit(factor)
    return value._with(v, "quantity", fail=[("E5002", ~finite(v), "not finite")], dim=dim)


def bind(value: Column, symbol: Column, dim: Dim) -> E:
    """A document's {value, unit}: the unit must exist and have the dimension, else E4001."""
    known = {s: f for s, (d, f) in catalogue().items() if d == dim}
    factors = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    factor = F.try_element_at(factors, symbol)
    v = value.cast("double") * factor
    return E(v, "quantity", dim=dim)._with(v, "quantity", fail=[("E4001", factor.isNull() | value.isNull(), "no unit of this dimension"), ("E5002", ~finite(v), "not finite")], dim=dim)


def in_unit(q: E, symbol: str) -> E:
    """A quantity's number of units, for writing."""
    dim, factor = catalogue()[symbol]
    if dim != q.dim:
        raise TypeError(f"E4072: {dict(q.dim)} in {symbol}")
    return q._with(q.v / F.lit(factor), "float")
