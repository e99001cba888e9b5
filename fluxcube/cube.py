"""A cube: one long DataFrame `(dimensions..., time, variable, value)` and its metadata. Absent rows and NULLs are the same."""

from __future__ import annotations

import datetime
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxcube.meta import CubeMeta


@dataclass(frozen=True)
class Cube:
    df: DataFrame
    meta: CubeMeta
    #: (dims..., variable, steps array<struct<time, function, description, source>>), or nothing
    processing: DataFrame | None = None

    @property
    def keys(self) -> list[str]:
        """What identifies a cell."""
        return [*self.meta.dims, "time", "variable"]

    def with_df(self, df: DataFrame, meta: CubeMeta | None = None) -> Cube:
        return replace(self, df=df, meta=meta or self.meta)

    def facts(self) -> DataFrame:
        """The cells that hold data."""
        return self.df.where("value is not null")

    def variable(self, *names: str) -> Cube:
        """The cube of some variables only; unknown ones raise."""
        for n in names:
            if n not in self.meta.variables:
                raise KeyError(n)
        meta = self.meta.with_(variables={k: v for k, v in self.meta.variables.items() if k in names})
        return self.with_df(self.df.where(F.col("variable").isin(*names)), meta)

    def has_processing_info(self) -> bool:
        return self.processing is not None

    def remove_processing_info(self) -> Cube:
        return replace(self, processing=None)

    def require_no_processing_info(self) -> None:
        if self.processing is not None:
            raise NotImplementedError("The cube has processing information; remove it first with remove_processing_info().")

    def with_domains(self, *dims: str) -> Cube:
        """Learn the values of dimensions (all if none are named) that aren't known yet, in one aggregation.

        A domain is a list on the driver: meant for dimensions such as areas, categories and years.
        """
        missing = [d for d in (self.meta.resolve_all(dims) or self.meta.axes) if d not in self.meta.domains]
        if not missing:
            return self
        row = self.df.agg(*[F.sort_array(F.collect_set(d)).alias(d) for d in missing]).first()
        return replace(self, meta=self.meta.with_(domains={**self.meta.domains, **{d: tuple(row[d]) for d in missing}}))

    def axis(self, dim: str) -> DataFrame:
        """The domain of a dimension as a one-column DataFrame."""
        dim = self.meta.resolve(dim)
        if dim in self.meta.domains:
            kind = self.df.schema[dim].dataType.simpleString()
            values = [(v,) for v in self.meta.domains[dim]]
            return self.df.sparkSession.createDataFrame(values, f"`{dim}` {kind}")
        return self.df.select(dim).where(F.col(dim).isNotNull()).distinct()

    def densify(self, *dims: str) -> Cube:
        """All cells along `dims` for every series that exists, missing ones with NULL: the axes are joined to the series.

        On demand only: its size is series times domains, which is what a dense cube has anyway.
        """
        self_ = self.with_domains(*dims)
        names = self_.meta.resolve_all(dims)
        rest = [k for k in self.keys if k not in names]
        full = self.df.select(*rest).distinct()
        for d in names:
            kind = f"array<{self.df.schema[d].dataType.simpleString()}>"
            values = F.array(*[F.lit(v) for v in self_.meta.domains[d]]).cast(kind)
            without = [v for v in self.meta.variables if d != "time" and d not in self.meta.dims_of(v)]
            if without:  # variables that lack the dimension keep their one NULL
                values = F.when(F.col("variable").isin(*without), F.array(F.lit(None)).cast(kind)).otherwise(values)
            full = full.withColumn(d, F.explode(values))
        joined = full.alias("a").join(self.df.alias("b"), same_keys("a", "b", self.keys), "left")
        return replace(self_, df=joined.select(*[F.col(f"a.{k}").alias(k) for k in self.keys], F.col("b.value").alias("value")))


def same_keys(a: str, b: str, keys: Iterable[str]) -> Column:
    """Null-safe equality of all keys: a dimension that a variable lacks is NULL on both sides."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def to_date(value: object) -> datetime.date:
    """A date from a date, a year, or text such as `2002`, `2002-05` and `2002-05-31`."""
    if isinstance(value, datetime.datetime):
        return value.date()
    if isinstance(value, datetime.date):
        return value
    parts = [int(x) for x in str(value).split("-")]
    return datetime.date(*(parts + [1, 1])[:3])
