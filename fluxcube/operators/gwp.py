"""Units of variables, warming-potential contexts and gas baskets. Conversions are scalars that fold into the plan."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import functions as F

from fluxcube.cube import Cube
from fluxcube.functions.missing import sum_rule
from fluxcube.functions.units import UnitError, registry, split_variable
from fluxcube.meta import CubeError, VariableMeta
from fluxcube.operators.aggregate import fill_all_na, levels
from fluxcube.operators.align import fillna, merge
from fluxcube.operators.select import select_no_scalar_dimension

log = logging.getLogger(__name__)
BASKET_UNIT = "Gg CO2 / yr"


def quantify(cube: Cube, units: Mapping[str, str]) -> Cube:
    """Give variables units; metadata only."""
    return replace(cube, meta=cube.meta.with_(variables={k: replace(v, unit=units.get(k, v.unit)) for k, v in cube.meta.variables.items()}))


def dequantify(cube: Cube) -> tuple[Cube, dict[str, str | None]]:
    """Take the units off; metadata only."""
    units = {k: v.unit for k, v in cube.meta.variables.items()}
    return replace(cube, meta=cube.meta.with_(variables={k: replace(v, unit=None) for k, v in cube.meta.variables.items()})), units


def _scaled(cube: Cube, variable: str, factor: float, name: str, meta: VariableMeta) -> Cube:
    is_it = F.col("variable") == variable
    df = cube.df.withColumns({"value": F.when(is_it, F.col("value") * F.lit(factor)).otherwise(F.col("value")), "variable": F.when(is_it, F.lit(name)).otherwise(F.col("variable"))})
    return cube.with_df(df, cube.meta.with_(variables={(name if k == variable else k): (meta if k == variable else v) for k, v in cube.meta.variables.items()}))


def convert_unit(cube: Cube, variable: str, unit: str) -> Cube:
    m = cube.meta.variables[variable]
    return _scaled(cube, variable, registry.factor(m.unit, unit, m.gwp_context), variable, replace(m, unit=unit))


def convert_to_gwp(cube: Cube, variable: str, gwp_context: str, unit: str = BASKET_UNIT) -> Cube:
    """A gas in CO2 equivalents of a context; it is then named `gas (context)`."""
    m = cube.meta.variables[variable]
    if m.gwp_context not in (None, gwp_context):
        raise CubeError(f"{variable!r} is in {m.gwp_context} already; convert it to mass first.")
    return _scaled(cube, variable, registry.factor(m.unit, unit, gwp_context), f"{m.entity} ({gwp_context})", replace(m, unit=unit, gwp_context=gwp_context))


def convert_to_gwp_like(cube: Cube, variable: str, like: VariableMeta) -> Cube:
    if like.gwp_context is None:
        raise CubeError("The variable to follow has no warming-potential context.")
    if like.unit is None:
        raise CubeError("The variable to follow has no unit.")
    return convert_to_gwp(cube, variable, like.gwp_context, like.unit)


def convert_to_mass(cube: Cube, variable: str, gwp_context: str | None = None, entity: str | None = None) -> Cube:
    """The inverse of `convert_to_gwp`: the gas in the same mass unit as its equivalents were."""
    m = cube.meta.variables[variable]
    context, gas = gwp_context or m.gwp_context, entity or m.entity
    if context is None:
        raise CubeError(f"{variable!r} has no warming-potential context; give one.")
    unit = m.unit.replace("CO2", gas)
    return _scaled(cube, variable, registry.factor(m.unit, unit, context), gas, replace(m, entity=gas, unit=unit, gwp_context=None))


def gwp_context(cube: Cube, variable: str) -> str | None:
    return cube.meta.variables[variable].gwp_context


def _basket_meta(cube: Cube, basket: str, unit: str | None) -> VariableMeta:
    if basket in cube.meta.variables:
        m = cube.meta.variables[basket]
        return replace(m, unit=unit or m.unit)
    entity, context = split_variable(basket)
    return VariableMeta(entity, unit or BASKET_UNIT, context)


def factors_to(cube: Cube, contents: Sequence[str], basket: VariableMeta) -> dict[str, float]:
    out = {}
    for v in contents:
        m = cube.meta.variables[v]
        if m.gwp_context is not None and m.gwp_context != basket.gwp_context:
            raise CubeError(f"{v!r} is in {m.gwp_context}, the basket in {basket.gwp_context}.")
        out[v] = registry.factor(m.unit, basket.unit, basket.gwp_context)
    return out


def scaled_by_variable(factors: Mapping[str, float], inverse: bool = False):
    """value * factor of its variable, as a column."""
    out = F.lit(None).cast("double")
    for v, x in factors.items():
        out = F.when(F.col("variable") == v, F.col("value") / F.lit(x) if inverse else F.col("value") * F.lit(x)).otherwise(out)
    return out


def gas_basket_contents_sum(
    cube: Cube,
    basket: str,
    basket_contents: Sequence[str],
    *,
    basket_units: str | None = None,
    skipna: bool | None = None,
    skipna_evaluation_dims: str | Sequence[str] | None = None,
    min_count: int | None = None,
) -> Cube:
    """The sum of gases in a basket's context, as a cube with that one variable; one pass over the cube."""
    cube.require_no_processing_info()
    missing = [v for v in basket_contents if v not in cube.meta.variables]
    if missing:
        raise KeyError(f"{missing} not in the cube")
    meta = _basket_meta(cube, basket, basket_units)
    part = cube.variable(*basket_contents)
    if skipna_evaluation_dims is not None:
        if skipna is not None:
            raise CubeError("Only one of 'skipna' and 'skipna_evaluation_dims' may be supplied, not both.")
        part, skipna = fill_all_na(part, skipna_evaluation_dims), False
    scaled = scaled_by_variable(factors_to(cube, basket_contents, meta))
    keys = [*part.meta.dims, "time"]
    df = part.df.groupBy(*keys).agg(sum_rule(scaled, skipna, min_count, len(basket_contents)).alias("value"))
    return part.with_df(df.select(*keys, F.lit(basket).alias("variable"), "value"), part.meta.with_(variables={basket: meta}))


def fill_na_gas_basket_from_contents(cube: Cube, basket: str, basket_contents: Sequence[str], *, sel: Mapping[str, Any] | None = None, **rule: Any) -> Cube:
    """Missing cells of a basket from its contents, perhaps within a selection only."""
    total = gas_basket_contents_sum(select_no_scalar_dimension(cube, sel), basket, basket_contents, **rule)
    return fillna(cube, total)


@dataclass(frozen=True)
class Basket:
    target: str
    sources: Sequence[str]
    sel: Mapping[str, Any] = field(default_factory=dict)
    tolerance: float | None = None
    skipna: bool = True
    min_count: int = 1


def add_aggregates_variables(cube: Cube, gas_baskets: Sequence[Basket], tolerance: float = 0.01, check: bool = True) -> Cube:
    """Add baskets one after another, later ones may use earlier ones; a basket that exists is filled and checked."""
    cube.require_no_processing_info()
    for level in levels(gas_baskets):
        for b in level:
            present = [s for s in b.sources if s in cube.meta.variables]
            if len(present) < len(b.sources):
                log.info("%s: not in the cube: %s", b.target, sorted({*b.sources} - {*present}))
            if not present:
                continue
            part = select_no_scalar_dimension(cube, b.sel)
            total = gas_basket_contents_sum(part, b.target, present, skipna=b.skipna or None, min_count=b.min_count)
            total = total.with_df(total.df.where("value is not null"))
            cube = merge(cube, total, tolerance=tolerance if b.tolerance is None else b.tolerance, check=check and b.target in cube.meta.variables)
    return cube


__all__ = ["Basket", "UnitError", "add_aggregates_variables", "convert_to_gwp", "convert_to_gwp_like", "convert_to_mass", "convert_unit", "dequantify", "fill_na_gas_basket_from_contents", "gas_basket_contents_sum", "quantify"]
