"""Cell codes, category codes, entity and unit spellings of emission tables.

Spellings are translated once for each distinct value, on the driver, and reach the rows by a broadcast map of that size.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# What table readers take for a missing cell, and the notation keys that mean zero or missing.
BLANKS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
ZERO_CODES = ("IE", "NO")
MISSING_CODES = ("NE", "NA", "FX")
SPECIAL_CODES = {"C": None, "CC": None, "CH4": None, "nan": None, "NaN": None, "-": 0.0, "NE0": None, "NE(1)": None, "FX": None}


#: What counts as a number; digits may be grouped by single underscores.
NUMBER = r"[+-]?((([0-9](_?[0-9])*)\.?([0-9](_?[0-9])*)?|\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?|(?i:inf(inity)?))"


class CodeError(ValueError):
    """A cell that is neither a number nor a known notation key."""


def parse_code(code: str) -> float | None:
    """Value of a text cell: a number (perhaps with a footnote), 0 for IE and NO, None for NE, NA and FX."""
    text = code.strip()
    if text in SPECIAL_CODES:
        return SPECIAL_CODES[text]
    if text in BLANKS:
        return None
    number = re.sub(r"\s*\([0-9]+\)$", "", text)
    if re.fullmatch(NUMBER, number):
        return float(number)
    parts = {p.strip().replace(".", "").upper() for p in text.split(",")}
    if "FX" in parts:
        return None
    if parts & set(ZERO_CODES):
        return 0.0
    if parts & set(MISSING_CODES):
        return None
    raise CodeError(f"can't read {code!r} as a number or notation key")


def parse_code_column(c: Column) -> tuple[Column, Column]:
    """`parse_code` as column expressions: the value, and whether the cell could not be read."""
    text = F.trim(c)
    plain = F.regexp_replace(text, r"\s*\([0-9]+\)$", "")
    number = F.when(plain.rlike(f"^{NUMBER}$"), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))
    parts = F.transform(F.split(text, ","), lambda p: F.upper(F.replace(F.trim(p), F.lit("."), F.lit(""))))
    has = lambda codes: F.arrays_overlap(parts, F.array(*[F.lit(x) for x in codes]))
    blank = text.isin(*BLANKS, *[k for k, v in SPECIAL_CODES.items() if v is None]) | c.isNull()
    zero = text.isin(*[k for k, v in SPECIAL_CODES.items() if v == 0])
    value = F.when(blank, F.lit(None).cast("double")).when(zero, 0.0).when(number.isNotNull(), number).when(has(["FX"]), F.lit(None).cast("double")).when(has(ZERO_CODES), 0.0)
    bad = ~(blank | zero | number.isNotNull() | has([*ZERO_CODES, *MISSING_CODES]))
    return value, F.coalesce(bad, F.lit(False))


# Memo items outside the hierarchy.
MEMO_CODES = {
    "MAG": "M.AG", "MAGELV": "M.AG.ELV", "MBK": "M.BK", "MBKA": "M.BK.A", "MBKM": "M.BK.M", "MLULUCF": "M.LULUCF", "MMULTIOP": "M.MULTIOP", "M0EL": "M.0.EL", "MBIO": "M.BIO",
    "M3B4APF": "M.3.B.4.APF", "M3B4APD": "M.3.B.4.APD", "M3CAG": "M.3.C.AG", "M3C1AG": "M.3.C.1.AG", "M3C1AGSAV": "M.3.C.1.AG.SAV", "M3C1AGRES": "M.3.C.1.AG.RES", "M3D2LU": "M.3.D.2.LU",
}
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")
#: What each level of a code looks like and how it is written out.
LEVELS: tuple[tuple[str, Callable[[str], str]], ...] = (
    ("[0-9]", str),
    ("[A-Za-z]", str.upper),
    ("[0-9]", str),
    ("[A-Za-z]", str.lower),
    ("[1-9]|(?i:ix|iv|vi{0,3}|i{1,3})", lambda t: ROMAN[int(t) - 1] if t.isdigit() else t.lower()),
    ("[0-9]+", str),
)


def ipcc_code(code: str) -> str:
    """`IPC1A1B23`, `1A1Bii3`, `CATM0EL` and the like -> `1.A.1.b.ii.3`, `M.0.EL`; anything else -> `error_<code>`."""
    text = code.strip()
    if text[:3] in ("IPC", "CAT"):
        text = text[3:].removeprefix("_")
    text = text.replace(".", "")
    if text in MEMO_CODES:
        return MEMO_CODES[text]
    memo = text.startswith("M")
    rest, out = text[memo:], ["M"] * memo
    for pattern, written in LEVELS:
        if not rest:
            break
        m = re.match(pattern, rest)
        if m is None:
            return _invalid(code)
        out.append(written(m[0]))
        rest = rest[m.end() :]
    return _invalid(code) if rest or len(out) == memo else ".".join(out)


def _invalid(code: str) -> str:
    log.warning("category code %r fits no level of the hierarchy", code)
    return f"error_{code}"


# Units of CO2 equivalents.
EQUIVALENTS = ("CO2eq", "CO2e", "CO2-eq", "CO\u2082eq")
#: Potentials by the suffix of an entity; without one it is the second assessment report.
_GWP_SUFFIXES = {"SAR": "SARGWP100", "AR4": "AR4GWP100", "AR5CCF": "AR5CCFGWP100", "AR5": "AR5GWP100", "AR6": "AR6GWP100"}
# Baskets that are given in CO2 equivalents.
BASKETS = ("KYOTOGHG", "FGASES", "HFCS", "PFCS", "OTHERHFCS", "UNKHFCS", "UNKPFCS")


def entity_name(entity: str) -> str:
    """`KYOTOGHGAR4` -> `KYOTOGHG (AR4GWP100)`; gases and names that carry a context stay as they are."""
    for basket in BASKETS:
        if entity == basket:
            return f"{basket} (SARGWP100)"
        for suffix, context in _GWP_SUFFIXES.items():
            if entity == basket + suffix:
                return f"{basket} ({context})"
    return entity


def unit_name(unit: str, entity: str) -> str:
    """`Gg` of CH4 -> `Gg CH4 / yr`; `GgCO2eq` -> `Gg CO2 / yr`; `MtC` -> `Mt C / yr`; `GgN2ON` of N2O -> `Gg N / yr`."""
    text = unit.replace(" ", "")
    if not entity or not text:
        log.warning("no unit for %r of %r: one of them is empty", unit, entity)
        return f"error_{unit}_{entity}"
    m = re.match(r"(?:k|M|G|T|P|m)?[gt]", text)
    if m is None:
        log.warning("no unit for %r of %r: it starts with no mass", unit, entity)
        return f"error_{unit}_{entity}"
    mass, what = m[0], text[m.end() :]
    basis = entity.split(" (")[0]
    if what in EQUIVALENTS:
        return f"{mass} CO2 / yr"
    if what == "C":
        return f"{mass} C / yr"
    if what == f"{basis}N":
        return f"{mass} N / yr"
    return f"{text} {basis} / yr"


#: Distinct spellings that are translated on the driver and broadcast; more go through a join of their own.
MOST_BROADCAST = 100_000


def map_distinct(df: DataFrame, columns: list[str], target: list[str], rule: Callable[..., object] | Mapping) -> DataFrame:
    """Replace `target` columns by `rule(*columns)` for each row. The rule runs once for each distinct combination."""
    names = [f"_k{i}" for i in range(len(columns))] + [f"_v{i}" for i in range(len(target))]
    schema = ", ".join(f"{n} string" for n in names)

    def translated(rows: Iterable[tuple]) -> list[tuple]:
        pairs = []
        for r in rows:
            if any(x is None for x in r):
                continue
            out = (rule.get(r[0], r[0]) if len(r) == 1 else rule.get(r)) if isinstance(rule, Mapping) else rule(*r)
            pairs.append((*r, *(out if isinstance(out, tuple) else (out,))))
        return pairs

    distinct = df.select(*columns).distinct()
    rows = [tuple(r) for r in distinct.limit(MOST_BROADCAST + 1).collect()]
    if len(rows) <= MOST_BROADCAST:
        pairs = translated(rows)
        if not pairs:
            return df
        table = F.broadcast(df.sparkSession.createDataFrame(pairs, schema))
    else:

        def step(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame(translated(frame.itertuples(index=False, name=None)), columns=names)

        table = distinct.dropna().mapInPandas(step, schema)
    cond = [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(columns)]
    joined = df.join(table, cond, "left")
    new = {t: F.coalesce(F.col(f"_v{i}"), F.col(t)) if t in df.columns else F.col(f"_v{i}") for i, t in enumerate(target)}
    return joined.withColumns(new).drop(*names)
