"""What a cube knows about itself; it lives on the driver and never in the rows."""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field


class DimensionNotExistingError(ValueError):
    """A name that is no dimension, no long name of one and no alias."""

    def __init__(self, name: str, known: Iterable[str]) -> None:
        super().__init__(f"Dimension {name!r} does not exist; there are {', '.join(map(repr, known))}.")


class CubeError(ValueError):
    """Data or arguments that an operator can't accept."""


ALIASES = {"cat": "category", "scen": "scenario"}


@dataclass(frozen=True)
class VariableMeta:
    entity: str
    unit: str | None = None  # "" is dimensionless, None has no unit at all
    gwp_context: str | None = None
    dims: tuple[str, ...] | None = None  # None: all dimensions of the cube
    dtype: str = "float"


@dataclass(frozen=True)
class CubeMeta:
    """`dims` are column names besides `time` and `variable`; `long_names` has `area` -> `area (ISO3)`."""

    dims: tuple[str, ...]
    variables: Mapping[str, VariableMeta]
    long_names: Mapping[str, str] = field(default_factory=dict)
    attrs: Mapping[str, object] = field(default_factory=dict)
    domains: Mapping[str, tuple] = field(default_factory=dict)
    #: additional coordinates: name -> (dimension, value -> label)
    coords: Mapping[str, tuple[str, Mapping[str, str]]] = field(default_factory=dict)

    @property
    def axes(self) -> tuple[str, ...]:
        return (*self.dims, "time")

    def resolve(self, name: str, extra: tuple[str, ...] = ()) -> str:
        """Column of a dimension by column name, long name or alias."""
        known = (*self.axes, *extra)
        if name in known:
            return name
        if ALIASES.get(name) in known:
            return ALIASES[name]
        for column, long in self.long_names.items():
            if name == long and column in known:
                return column
        raise DimensionNotExistingError(name, known)

    def resolve_all(self, names: str | Iterable[str] | None, extra: tuple[str, ...] = ()) -> tuple[str, ...]:
        if names is None:
            return ()
        return tuple(self.resolve(n, extra) for n in ([names] if isinstance(names, str) else names))

    def dims_of(self, variable: str) -> tuple[str, ...]:
        own = self.variables[variable].dims if variable in self.variables else None
        return self.dims if own is None else own

    def alias_translations(self) -> dict[str, str]:
        out = {c: self.long_names.get(c, c) for c in self.axes}
        out |= {a: out[c] for a, c in ALIASES.items() if c in out}
        return out

    def with_(self, **changes: object) -> CubeMeta:
        return dataclasses.replace(self, **changes)

    def without(self, dims: Iterable[str]) -> CubeMeta:
        gone = set(dims)
        return self.with_(
            dims=tuple(d for d in self.dims if d not in gone),
            variables={k: dataclasses.replace(v, dims=None if v.dims is None else tuple(d for d in v.dims if d not in gone)) for k, v in self.variables.items()},
            long_names={k: v for k, v in self.long_names.items() if k not in gone},
            domains={k: v for k, v in self.domains.items() if k not in gone},
            coords={k: v for k, v in self.coords.items() if v[0] not in gone},
            attrs={k: v for k, v in self.attrs.items() if k not in gone and ALIASES.get(k) not in gone},
        )

    # attributes that every data set may have
    def _attr(name: str):  # noqa: N805
        return property(lambda self: self.attrs.get(name))

    entity_terminology = _attr("entity_terminology")
    references = _attr("references")
    rights = _attr("rights")
    contact = _attr("contact")
    title = _attr("title")
    comment = _attr("comment")
    institution = _attr("institution")
    publication_date = _attr("publication_date")
    del _attr

    def with_attrs(self, **attrs: object) -> CubeMeta:
        """Set attributes; None removes one."""
        merged = {**self.attrs, **attrs}
        return self.with_(attrs={k: v for k, v in merged.items() if v is not None})

    def to_json(self) -> str:
        return json.dumps(
            {"dims": self.dims, "variables": {k: dataclasses.asdict(v) for k, v in self.variables.items()}, "long_names": dict(self.long_names), "attrs": dict(self.attrs), "coords": {k: [d, dict(m)] for k, (d, m) in self.coords.items()}},
            default=str,
            sort_keys=True,
        )

    @staticmethod
    def from_json(text: str) -> CubeMeta:
        raw = json.loads(text)
        variables = {k: VariableMeta(**{**v, "dims": None if v["dims"] is None else tuple(v["dims"])}) for k, v in raw["variables"].items()}
        return CubeMeta(tuple(raw["dims"]), variables, raw["long_names"], raw["attrs"], {}, {k: (d, m) for k, (d, m) in raw["coords"].items()})


def split_long_name(name: str) -> tuple[str, str | None]:
    """`area (ISO3)` -> (`area`, `ISO3`)."""
    m = re.fullmatch(r"(.+?) \((.+)\)", name)
    return (m[1], m[2]) if m else (name, None)
