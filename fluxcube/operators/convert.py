"""Re-expressing a dimension in another categorization by weighted rules.

A rule says `sum(f * source) = sum(g * target)`, perhaps for some values of another dimension only. Which rule writes
which category depends on the rules and on the order of the target categories, not on the data: the driver decides it,
and the cube is converted in one join-free pass.
"""

from __future__ import annotations

import csv
import functools
import logging
import operator
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import functions as F

from fluxcube.cube import Cube
from fluxcube.meta import CubeError

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class ConversionRule:
    sources: Mapping[str, int]
    targets: Mapping[str, int]
    #: auxiliary dimension -> values for which the rule holds
    only: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    comment: str = ""


@dataclass(frozen=True)
class Conversion:
    source: str
    target: str
    rules: tuple[ConversionRule, ...]
    target_order: tuple[str, ...] = ()


def parse_formula(text: str) -> dict[str, int]:
    """`2.B + 2.E` -> {2.B: 1, 2.E: 1}; `-3+4` -> {3: -1, 4: 1}; `2*1.A` has a factor."""
    out: dict[str, int] = {}
    pieces = re.findall(r"([+-]?)\s*((?:\"[^\"]*\"|[^+\-\s\"]|\s(?![+-]))+)", text.strip())
    for sign, term in pieces:
        term = term.strip()
        m = re.fullmatch(r"(\d+)\s*\*\s*(.+)", term)
        factor, code = (int(m[1]), m[2]) if m else (1, term)
        code = code.strip().strip('"')
        if code:
            out[code] = out.get(code, 0) + (-factor if sign == "-" else factor)
    if not out:
        raise CubeError(f"no categories in {text!r}")
    return out


def read_conversion(path: str | Path, target_order: Sequence[str] = ()) -> Conversion:
    """Rules from a CSV file: a header with both categorizations, perhaps auxiliary dimensions between, perhaps a comment;
    lines that start with # are skipped. Auxiliary cells list values with spaces between; empty means any."""
    with Path(path).open(newline="") as f:
        rows = [r for r in csv.reader(x for x in f if not x.lstrip().startswith("#")) if r and any(r)]
    head = [h.strip() for h in rows[0]]
    comment = head.index("comment") if "comment" in head else len(head)
    names = head[:comment]
    rules = []
    for r in rows[1:]:
        r = [*r, *[""] * (len(head) - len(r))]
        only = {names[k]: tuple(r[k].split()) for k in range(1, len(names) - 1) if r[k].strip()}
        rules.append(ConversionRule(parse_formula(r[0]), parse_formula(r[len(names) - 1]), only, r[comment].strip() if comment < len(r) else ""))
    return Conversion(names[0], names[-1], tuple(rules), tuple(target_order))


def category_name(targets: Mapping[str, int]) -> str:
    """`{3: -1, 4: 1}` -> `A_(-3+4)`, the name for a sum that can't be split."""
    text = "".join(f"{'-' if f < 0 else '+'}{'' if abs(f) == 1 else f'{abs(f)}*'}{c}" for c, f in targets.items())
    return f"A_({text.removeprefix('+')})"


@dataclass(frozen=True)
class _Step:
    """`target` = `scale` * sum(f * source) where `only` holds; later steps of one target replace earlier ones' cells there,
    with missing values too."""

    target: str
    sources: Mapping[str, int]
    scale: float
    only: Mapping[str, tuple[str, ...]]
    order: int


def plan(conversion: Conversion) -> list[_Step]:
    """The steps that give each target category, in order.

    A rule serves a category if it names it as a target and all its targets have positive factors. A rule with several
    targets gives one new category, with the sum of what each target would get, and ends all of them, restricted or not;
    a restricted rule with one target lets the next rules write, too.
    """
    order = list(conversion.target_order) or list(dict.fromkeys(c for r in conversion.rules for c in r.targets))
    done: set[str] = set()
    steps: list[_Step] = []
    for category in order:
        if category in done:
            continue
        for rule in conversion.rules:
            if category not in rule.targets or any(f <= 0 for f in rule.targets.values()):
                continue
            if done.intersection(rule.targets):
                log.warning("rule for %s skipped: part of its output is converted already", sorted(rule.targets))
                continue
            several = len(rule.targets) > 1
            scale = sum(1.0 / f for f in rule.targets.values())
            steps.append(_Step(category_name(rule.targets) if several else category, rule.sources, scale, rule.only, len(steps)))
            if several or not rule.only:
                done.update(rule.targets)
                break
    return steps


def convert(cube: Cube, dim: str, conversion: Conversion, auxiliary_dimensions: Mapping[str, str] | None = None, steps: Iterable[_Step] | None = None) -> Cube:
    """The cube with `dim` in the target categorization. Missing sources are skipped unless all are.

    `auxiliary_dimensions`: categorization of a rule's restriction -> dimension of the cube (or `entity`).
    """
    dim = cube.meta.resolve(dim)
    steps = list(plan(conversion) if steps is None else steps)
    needed = {a for s in steps for a in s.only}
    aux = dict(auxiliary_dimensions or {})
    if needed - set(aux):
        raise CubeError(f"The conversion uses auxiliary categorizations without a dimension: {sorted(needed - set(aux))}")
    column = {a: "variable" if aux[a] in ("entity", "variable") else cube.meta.resolve(aux[a]) for a in needed}
    holds = lambda step: F.lit(True) if not step.only else functools.reduce(operator.and_, [F.col(column[a]).isin(*values) for a, values in step.only.items()])
    hits = []
    for k, s in enumerate(steps):
        weight = F.lit(None).cast("double")
        for code, f in s.sources.items():
            weight = F.when(F.col(dim) == code, F.lit(float(f))).otherwise(weight)
        # the last step that holds for a cell writes it; restrictions are on dimensions that all sources of a cell share
        writes = holds(s)
        for later in steps[k + 1 :]:
            if later.target == s.target:
                writes = writes & ~holds(later)
        hits.append(F.when(weight.isNotNull() & writes, F.struct(F.lit(s.target).alias("t"), (weight * F.lit(s.scale)).alias("w"))))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.lit(None).cast("array<struct<t:string,w:double>>")
    exploded = cube.df.where("value is not null").withColumn("_h", F.explode(found))
    df = exploded.withColumn(dim, F.col("_h.t")).groupBy(*cube.keys).agg(F.sum(F.col("value") * F.col("_h.w")).alias("value"))
    meta = cube.meta.with_(
        long_names={**cube.meta.long_names, dim: f"{dim} ({conversion.target})"},
        domains={**{k: v for k, v in cube.meta.domains.items() if k != dim}, dim: tuple(sorted({s.target for s in steps}))},
        coords={k: v for k, v in cube.meta.coords.items() if v[0] != dim},
    )
    return cube.with_df(df, meta)
