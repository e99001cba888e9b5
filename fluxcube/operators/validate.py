"""The rules that a cube must obey. Most look at metadata only; those on rows share one aggregation."""

from __future__ import annotations

import datetime
import logging
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxcube.cube import Cube
from fluxcube.functions.units import UnitError, registry, split_variable

log = logging.getLogger(__name__)
KNOWN_ATTRS = ("area", "cat", "scen", "entity_terminology", "references", "rights", "contact", "title", "comment", "institution", "publication_date")
PROVENANCE = ("projected", "measured", "derived")


class ValidationError(ValueError):
    """A cube breaks a rule."""


def findings(cube: Cube) -> list[tuple[str, str, str]]:
    """All findings of the metadata rules: (level, rule, text) with level error, warning or info."""
    m, out = cube.meta, []
    add = lambda *x: out.append(x)
    for dim in ("source", "area"):
        if dim not in m.dims:
            add("error", "required_dimension", f"{dim!r} is no dimension")
    for dim in m.dims:
        if dim not in cube.df.columns:
            add("error", "dimension_column", f"{dim!r} has no column")
    if "time" not in cube.df.columns:
        add("error", "required_dimension", "'time' is no dimension")
    for short in ("area", "cat", "scen"):
        name = m.attrs.get(short)
        if name is not None:
            if not re.fullmatch(r".+ \(.+\)", str(name)):
                add("error", "attribute_format", f"{short!r} is not in the format 'dim (category set)': {name!r}")
            elif name not in m.long_names.values():
                add("error", "attribute_dimension", f"{name!r} defined as {short!r}, but is no dimension")
    for name in m.coords:
        if " " in name:
            add("error", "coordinate_name", f"additional coordinate name {name!r} contains a space")
    for name, v in m.variables.items():
        if not v.entity:
            add("error", "entity", f"{name!r} has no entity")
        if v.dtype == "float" and v.unit is None:
            add("error", "unit", f"{name!r} has no unit")
            continue
        context_in_name = split_variable(name)[1]
        if v.gwp_context is not None:
            if v.gwp_context not in registry.potentials:
                add("error", "gwp_context", f"{name!r}: {v.gwp_context!r} is not known")
            elif not registry.convertible(v.unit, "Gg CO2 / yr"):
                add("error", "gwp_unit", f"{name!r} has a context, but {v.unit!r} is no CO2 emission rate")
            if context_in_name is None:
                add("warning", "gwp_name", f"{name!r} has a context that is missing from its name")
            elif context_in_name != v.gwp_context:
                add("info", "gwp_name", f"{name!r} and its context {v.gwp_context!r} disagree")
        elif context_in_name is not None and "GWP" in context_in_name:
            add("warning", "gwp_missing", f"{name!r} looks like a warming potential, but has no context")
        if v.unit and v.entity in registry.substances and v.gwp_context is None:
            try:
                if registry.parse(v.unit).exponents().get("mass") != 1 or registry.parse(v.unit).exponents().get("time") != -1:
                    add("warning", "emission_unit", f"{name!r} has unit {v.unit!r}, which is no emission rate")
            except UnitError as e:
                add("warning", "emission_unit", f"{name!r}: {e}")
    a = m.attrs
    if "references" in a and "doi" not in str(a["references"]):
        add("info", "references", "'references' is not a DOI")
    if "contact" in a and "@" not in str(a["contact"]):
        add("info", "contact", "'contact' is no e-mail address")
    if "publication_date" in a and not isinstance(a["publication_date"], datetime.date):
        add("error", "publication_date", "'publication_date' is no date")
    for name in set(a) - set(KNOWN_ATTRS):
        add("warning", "unknown_attribute", f"unknown attribute {name!r}")
    return out


def row_report(cube: Cube) -> DataFrame:
    """Row rules as one aggregation: NaN values, unknown variables, duplicate cells, times that are missing."""
    known = list(cube.meta.variables)
    cells = cube.df.groupBy(*cube.keys).agg(F.count("*").alias("n"), F.count_if(F.isnan("value")).alias("nan"))
    bad_provenance = F.count_if(~F.col("provenance").isin(*PROVENANCE)) if "provenance" in cube.meta.dims else F.lit(0)
    return cells.agg(
        F.coalesce(F.sum("nan"), F.lit(0)).alias("nan_values"),
        F.count_if(~F.col("variable").isin(*known)).alias("unknown_variables"),
        F.count_if(F.col("n") > 1).alias("duplicate_cells"),
        F.count_if(F.col("time").isNull()).alias("missing_times"),
        bad_provenance.cast("long").alias("bad_provenance"),
    )


def ensure_valid(cube: Cube, rows: bool = False) -> None:
    """Raise on errors, log the rest. `rows`: check the rows, too, which runs one action."""
    errors = []
    for level, rule, text in findings(cube):
        if level == "error":
            errors.append(text)
        else:
            log.log(logging.WARNING if level == "warning" else logging.INFO, "%s: %s", rule, text)
    if rows:
        counts = row_report(cube).first().asDict()
        errors += [f"{n} x {k}" for k, n in counts.items() if n]
    if errors:
        raise ValidationError("; ".join(errors))
