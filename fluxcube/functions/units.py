"""Emission units and global warming potentials; all of it runs on the driver and ends in a scalar factor.

A unit is a factor and exponents of base dimensions. Masses are counted in gigagrams of a substance, times in years.
`Gg CO2 / yr`, `CO2 Gg / year`, `CO2 * gigagram / year` and `kt CO2 / a` are one unit. Carbon (`C`) and CO2 are the same
dimension (44/12), nitrogen (`N`) is a substance of its own. A warming-potential context makes the gases in its table
convertible to CO2.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field


class UnitError(ValueError):
    """A unit can't be read, or two units are not convertible."""


# SI prefixes.
PREFIXES = {"": 1.0, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15, "h": 1e2, "m": 1e-3, "u": 1e-6, "n": 1e-9}
PREFIX_NAMES = {"kilo": 1e3, "mega": 1e6, "giga": 1e9, "tera": 1e12, "peta": 1e15, "milli": 1e-3, "micro": 1e-6}
# Times in Julian years of 365.25 days.
TIMES = {"yr": 1.0, "year": 1.0, "years": 1.0, "a": 1.0, "month": 1 / 12, "day": 1 / 365.25, "d": 1 / 365.25, "h": 1 / 8766, "hour": 1 / 8766, "s": 1 / 31557600, "second": 1 / 31557600}
# 100-year global warming potentials from the IPCC assessment reports (second, fourth, fifth, sixth).
GASES = ("CO2", "CH4", "N2O", "SF6", "NF3", "CF4", "C2F6", "C3F8", "HFC23", "HFC32", "HFC125", "HFC134a", "HFC143a", "HFC152a", "HFC227ea")
GWP = {
    "SARGWP100": (1, 21, 310, 23900, None, 6500, 9200, 7000, 11700, 650, 2800, 1300, 3800, 140, 2900),
    "AR4GWP100": (1, 25, 298, 22800, 17200, 7390, 12200, 8830, 14800, 675, 3500, 1430, 4470, 124, 3220),
    "AR5GWP100": (1, 28, 265, 23500, 16100, 6630, 11100, 8900, 12400, 677, 3170, 1300, 4800, 138, 3350),
    "AR5CCFGWP100": (1, 34, 298, 26087, 17885, 7349, 12340, 9878, 13856, 817, 3691, 1549, 5508, 167, 3860),
    "AR6GWP100": (1, 27.9, 273, 25200, 17400, 7380, 12400, 9290, 14600, 771, 3740, 1530, 5810, 164, 3600),
}


@dataclass(frozen=True)
class Unit:
    factor: float = 1.0
    dims: tuple[tuple[str, int], ...] = ()

    def exponents(self) -> dict[str, int]:
        return dict(self.dims)


@dataclass
class UnitRegistry:
    """Known substances and potentials; both can be added to."""

    substances: set[str] = field(default_factory=lambda: {*GASES, "C", "N", "CO", "NOx", "NMVOC", "SO2", "NH3", "BC", "OC"})
    potentials: dict[str, dict[str, float]] = field(default_factory=lambda: {k: {g: float(x) for g, x in zip(GASES, v) if x is not None} for k, v in GWP.items()})

    def define_gas(self, name: str, **potentials: float) -> None:
        self.substances.add(name)
        for context, x in potentials.items():
            self.potentials.setdefault(context, {"CO2": 1.0})[name] = x

    def _atom(self, name: str) -> tuple[float, str | None]:
        if name in self.substances:
            return (44 / 12, "CO2") if name == "C" else (1.0, name)
        if name in TIMES:
            return TIMES[name], "time"
        for base, grams in (("gram", 1.0), ("g", 1.0), ("tonne", 1e6), ("metric_ton", 1e6), ("t", 1e6)):
            if name.endswith(base):
                prefix = name[: -len(base)]
                scale = PREFIXES.get(prefix, PREFIX_NAMES.get(prefix))
                if scale is not None:
                    return scale * grams / 1e9, "mass"
        raise UnitError(f"unknown unit {name!r}")

    def parse(self, text: str) -> Unit:
        factor, dims = 1.0, defaultdict(int)
        sign = 1
        for token in re.findall(r"\*\*|[*/]|\^|-?[0-9.]+|[^\s*/^]+", text.strip()):
            if token == "/":
                sign = -1
            elif token == "*":
                sign = 1
            elif token in ("**", "^"):
                raise UnitError(f"powers are not used in emission units: {text!r}")
            elif re.fullmatch(r"-?[0-9.]+", token):
                factor *= float(token) ** sign
                sign = 1
            else:
                x, dim = self._atom(token)
                factor *= x**sign
                dims[dim] += sign
                sign = 1
        return Unit(factor, tuple(sorted((k, v) for k, v in dims.items() if v)))

    def factor(self, source: str, target: str, context: str | None = None) -> float:
        """What a value in `source` is multiplied by to be in `target`."""
        a, b = self.parse(source), self.parse(target)
        da, db = a.exponents(), b.exponents()
        factor = a.factor / b.factor
        if da != db and context is not None:
            if context not in self.potentials:
                raise UnitError(f"unknown context {context!r}; known: {sorted(self.potentials)}")
            table = self.potentials[context]
            for dims, way in ((da, 1), (db, -1)):
                for gas in [g for g in dims if g in table and g != "CO2"]:
                    n = dims.pop(gas)
                    dims["CO2"] = dims.get("CO2", 0) + n
                    factor *= table[gas] ** (n * way)
        if {k: v for k, v in da.items() if v} != {k: v for k, v in db.items() if v}:
            raise UnitError(f"can't convert {source!r} to {target!r}" + (f" in {context}" if context else ""))
        return factor

    def convertible(self, source: str, target: str, context: str | None = None) -> bool:
        try:
            self.factor(source, target, context)
        except UnitError:
            return False
        return True


registry = UnitRegistry()


def split_variable(name: str) -> tuple[str, str | None]:
    """`CH4 (AR4GWP100)` -> (`CH4`, `AR4GWP100`); `CH4` -> (`CH4`, None)."""
    m = re.fullmatch(r"(.+?) \((.+)\)", name)
    return (m[1], m[2]) if m else (name, None)
